"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each round hangs the larger neighbours of every node onto the least of its neighbourhood, then does the same
    among the smaller ones; the links shrink to stars in a number of rounds about the logarithm of the longest path.
    A round is two aggregates and two joins on 16-byte rows, written to the shared folder, which cuts the lineage.
    Links with a null end or to the node itself are ignored.
    """
    ends = F.col(left), F.col(right)
    pairs = links.filter(ends[0] != ends[1]).select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct()
    pairs, seen = materialize(pairs, "links"), None
    while True:
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if mark == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        # A node's least neighbour; the second join key keeps the aggregate's partitioning from being taken over, so
        # that adaptive execution may split the rows of a node that a large part of all rows hangs on.
        both = pairs.select(F.col("v").alias("n"), F.col("u").alias("o")).unionByName(
            pairs.select(F.col("u").alias("n"), F.col("v").alias("o"))
        )
        least = both.groupBy("n").agg(F.min("o").alias("m"))
        least = least.select(F.col("n").alias("v"), F.xxhash64("n").alias("h"), F.least("n", "m").alias("m"))
        large = pairs.withColumn("h", F.xxhash64("v")).join(least, ["v", "h"]).select("u", F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        keyed = low.withColumn("h", F.xxhash64("u"))
        small = large.withColumn("h", F.xxhash64("u")).join(keyed, ["u", "h"]).filter("v != m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
