"""Contiguous shards of nearly equal byte size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order import in_order, sums_before

SHARDS = 16


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes and one for the line end; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_by_bytes(docs: DataFrame, size: str, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """The rows with ``shard`` and ``slot``: runs in ascending ``key``, cut at equal targets of the summed ``size``.

    A row goes to the shard in which its middle byte lies, so a shard is off its target by one row at most.  Nulls
    come first in the order, equal keys stay next to each other in any order; slots are gapless from 0; a null size counts
    as 0.  An empty table gives no rows.  Further columns stay, whatever their names, but one named shard or slot is an error.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have columns {sorted(clash)} already")
    # All columns wait in one struct, so that no name can clash with those worked with.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"), F.col(size).alias("size")
    )
    rows, row = in_order(packed, [F.col("key").asc_nulls_first()])
    sums = sums_before(rows, row, "size")
    total = rows.agg(F.sum("size")).first()[0] or 1  # one number
    middle = 2 * F.col("before") + F.col("size")
    shard = F.least(F.floor(middle * F.lit(shards) / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    # Middles ascend, so a shard is a run of rows: where each begins is all that the rows themselves have to know.
    firsts = sums.groupBy(shard.alias("shard")).agg(F.min(row).alias("first")).collect()  # one row for each shard
    begins = [F.struct(F.lit(f).cast("bigint").alias("first"), F.lit(s).alias("shard")) for s, f in sorted(firsts)]
    if not begins:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).limit(0)
    run = F.element_at(F.filter(F.array(*begins), lambda b: b["first"] <= F.col(row)), -1)
    rows = rows.withColumn("run", run)
    return rows.select("doc.*", F.col("run.shard").alias("shard"), (F.col(row) - F.col("run.first")).alias("slot"))
