"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .order import in_order

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size that the mix may take from it
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The sources with ``target`` (one input row each: source, source_size and what else is carried along).

    Sources take the weights in turn, by code point with null last, and share the whole size.  A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is above.  That is the level
    at which the targets, each the lesser of its cap and level * weight, add up to the whole: sorted by cap / weight,
    the capped sources come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    rows = sizes.select(
        "*",
        F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("double").alias("_w"),
        (F.col("source_size") * most).cast("double").alias("_cap"),
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(after))
    free = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    rows = rows.withColumn("_level", F.first(free, ignorenulls=True).over(everything))
    return rows.withColumn("target", F.least("_cap", F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_level")


def offset_of(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source; the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), source))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(
    docs: DataFrame,
    size: str,
    *,
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = 6,
) -> DataFrame:
    """The rows with ``source_size``, ``target`` (their source's) and ``copies`` (times the mix takes the row).

    Every row of a source has the same expected copies, target / size of the source.  Along the source, ordered by
    size and key so that neighbours are alike, the expected copies are summed up from one random offset, and a row
    is taken once for each whole number that the sum passes: ``most`` times at most.  Null sources form one source;
    rows of size 0 are sampled like any other; null sizes count as 0; an empty table gives no rows.  Further columns
    stay, whatever their names, but a column named like the three that are added is an error.
    """
    if clash := {"source_size", "target", "copies"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have columns {sorted(clash)} already")
    # All columns wait in one struct, so that no name can clash with those worked with.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(source).alias("source"), F.col(size).alias("size"), F.col(key).alias("key"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("key").asc_nulls_first()]
    rows, row = in_order(packed, order)
    sizes = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"), F.min(row).alias("first")
    )
    # Written, so that its size is known before the rows are joined: few sources are sent to them, none of the rows moves.
    targets = materialize(source_targets(sizes, weights, most).withColumnRenamed("source", "of_source"), "targets")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, start = F.col(row) - F.col("first"), offset_of(F.col("of_source"), seed)
    copies = F.floor(start + (rank + 1) * rate) - F.floor(start + rank * rate)
    return rows.select("doc.*", "source_size", "target", copies.cast("int").alias("copies"))
