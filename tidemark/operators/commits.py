"""The chained commit cadence: each commit is the first arrival at least ``every`` after the previous commit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.clock import to_micros
from ..functions.ladder import running, time_widths
from ..session import materialize

BROADCAST_COMMITS = 500_000
BLOCK = 1 << 18  # arrivals that one task walks through at once
WALKED_ROWS = 50_000_000


def commit_chain(
    log: DataFrame,
    every: int,
    first: int | None,
    last: int | None,
    rows: int | None = None,
    block: int = BLOCK,
    walked: int = WALKED_ROWS,
) -> DataFrame:
    """(commit_us): commit times over the arrivals of a log, from the first arrival ``first`` to ``last``.

    ``rows`` is an upper bound of the log's rows, if known.

    The chain is the only rule where a step depends on the one before.  The distinct arrivals are put in order and
    stored in blocks.  A block does not know at which time the next commit is due when the chain reaches it, but that
    is less than ``every`` after its own first arrival; so it follows the chains from all arrivals up to there, which
    soon run into each other, and says at which due time each of them leaves.  One walk over these few rows finds the
    due time at which the real chain enters each block, and each block then lists its own commits.

    Where ``every`` spans whole blocks, chains leave without having met, and there may be too many rows for one walk
    (more than ``walked``).  The chain is then short, and composed hops find it (see ``_by_hops``).
    """
    spark = log.sparkSession
    arrivals = log.filter(F.col("arrival_time").isNotNull()).select(to_micros("arrival_time").alias("commit_us"))
    if first is None:
        return arrivals.limit(0)
    if every <= 0:
        return arrivals.distinct()
    longest = (last - first) // every  # hops the chain can have at most
    if longest == 0:
        return spark.range(1).select(F.lit(first).cast("bigint").alias("commit_us"))
    blocks = materialize(_in_blocks(arrivals, block), "arrivals")
    exits = materialize(_exits(blocks, every), "exits")
    if exits.count() > walked:
        return _by_hops(arrivals, every, first, longest, rows)
    return _commits(blocks, _entries(exits, first), every, longest)


def _in_blocks(arrivals: DataFrame, size: int) -> DataFrame:
    """(block, values): distinct arrivals in order, at most ``size`` in a block; block numbers ascend with time."""
    ordered = arrivals.distinct().repartitionByRange("commit_us").sortWithinPartitions("commit_us")
    numbered = ordered.select((F.spark_partition_id().cast("bigint") * (1 << 33)).alias("part"), "commit_us")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = 0, np.empty(0, np.int64)

        def blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(values), size):
                row = pa.array([values[at : at + size]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), row], names=["block", "values"])
                number += 1

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                waiting = np.concatenate([waiting, batch.column("commit_us").to_numpy()])
                whole = len(waiting) // size * size
                yield from blocks(waiting[:whole])
                waiting = waiting[whole:]
        yield from blocks(waiting)

    return numbered.mapInArrow(cut, "block bigint, values array<bigint>")


def _rows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.asarray(row.values) for row in batch.column("values"))


def _exits(blocks: DataFrame, every: int) -> DataFrame:
    """(block, upto, due): a commit due at ``upto`` or earlier, but after the row before, leaves the block as ``due``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), _rows_of(batch)):
                onward = np.searchsorted(values, values + every)
                last = np.where(onward < len(values), onward, np.arange(len(values)))
                while (last[last] != last).any():  # follow twice as far each time
                    last = last[last]
                asked = np.searchsorted(values, values[0] + every) + 1
                upto, due = values[:asked], values[last[:asked]] + every
                kept = np.r_[due[1:] != due[:-1], True]
                columns = [np.full(kept.sum(), block), upto[kept], due[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "upto", "due"])

    return blocks.select("block", "values").mapInArrow(run, "block bigint, upto bigint, due bigint")


def _entries(exits: DataFrame, first: int) -> DataFrame:
    """(block, due) for each block in which the chain has a commit: when the first one is due.  One walk in order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due, left = first, None
        for batch in batches:
            entered = []
            for block, upto, onward in zip(*(batch.column(c).to_pylist() for c in ("block", "upto", "due"))):
                if block != left and due <= upto:
                    entered.append((block, due))
                    due, left = onward, block
            columns = zip(*entered) if entered else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "due"])

    return exits.repartition(1).sortWithinPartitions("block", "upto").mapInArrow(walk, "block bigint, due bigint")


def _commits(blocks: DataFrame, entries: DataFrame, every: int, longest: int) -> DataFrame:
    if longest < BROADCAST_COMMITS:
        entries = F.broadcast(entries)  # a block that the chain enters has a commit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for due, values in zip(batch.column("due").to_pylist(), _rows_of(batch)):
                at = np.searchsorted(values, due)
                while at < len(values):
                    found.append(int(values[at]))
                    at = np.searchsorted(values, values[at] + every)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["commit_us"])

    entered = blocks.join(entries, "block").select("values", "due").mapInArrow(run, "commit_us bigint")
    return materialize(entered, "commits")


def _by_hops(arrivals: DataFrame, every: int, first: int, longest: int, rows: int | None) -> DataFrame:
    """The chain by doubling: a hop table gives the next commit for *any* arrival, hops of length 1, 4, 16, ... are
    composed, and the chain from the first arrival is filled in from the longest hops to the shortest.  Only arrivals
    that some hop lands on stay in the longer tables, so they shrink from round to round.
    """
    reached = arrivals.sparkSession.range(1).select(F.lit(first).cast("bigint").alias("commit_us"))
    hops = [materialize(_single_hops(arrivals, every, rows), "hops")]
    while 4 ** len(hops) <= longest:
        hops.append(materialize(_composed(_composed(hops[-1], first), first), "hops"))
    for table in reversed(hops):  # each table adds up to three hops of its length
        found, landed = [reached], reached
        for _ in range(3):
            landed = _landed(table, landed, longest + 1)
            found.append(landed)
        reached = materialize(reduce(DataFrame.unionByName, found), "commits")
    return reached


def _landed(table: DataFrame, commits: DataFrame, bound: int) -> DataFrame:
    """Where the hops of a table lead from some commits, of which there are at most ``bound``."""
    if bound <= BROADCAST_COMMITS:
        commits = F.broadcast(commits)  # the hop table is scanned, not shuffled
    return table.join(commits, table["a"] == commits["commit_us"]).select(F.col("b").alias("commit_us"))


def _single_hops(arrivals: DataFrame, every: int, rows: int | None) -> DataFrame:
    """(a, b): b is the first arrival at or after a + every."""
    at, arrival = F.col("commit_us"), F.col("_arrival")
    marked = arrivals.select(at.alias("_at"), at.alias("_arrival")).unionByName(
        arrivals.select((at + every).alias("_at"), at.alias("_from")), allowMissingColumns=True
    )
    nearest = running(
        marked,
        F.col("_at"),
        {"b": ("min", arrival)},
        at={"a": F.max("_from")},
        reverse=True,
        widths=time_widths(None if rows is None else 2 * rows),
    )
    return nearest.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")


def _composed(hops: DataFrame, first: int) -> DataFrame:
    """Hops of twice the length, for the first arrival and the arrivals that are landed on."""
    landed = hops.select(F.col("b").alias("a")).distinct()
    starts = hops.join(landed, "a", "left_semi").unionByName(hops.filter(F.col("a") == first))
    onward = hops.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return starts.join(onward, "b").select("a", F.col("c").alias("b"))


