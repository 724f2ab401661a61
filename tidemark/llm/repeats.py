"""Removal of long repeated byte strings: content-chosen anchors, then suffix arrays over what surrounds them.

Of the grams (half the length asked for) that start in a window one is chosen by the least hash, so two equal strings
choose the same grams in the same places.  Where a gram was chosen is an anchor.  A string is repeated just when another
anchor with the same gram has the same bytes around it; so anchors meet by gram, with the bytes on both sides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .suffixes import common_prefixes, suffix_array
from .text import byte_texts, id_filter, mixed, passing

LENGTH = 400
LARGE = 256  # different surroundings of one gram from which on they are grouped by half of them as well
CELL = 1024  # surroundings handled in one group, which no group exceeds: grams with more of them go by their windows

_STEP = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Hashes of all substrings of a text, from prefix sums; powers are kept for the longest text so far."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            size = 2 * len(data) + 1024
            self.up, self.down = _powers(_STEP, size), _powers(pow(_STEP, -1, 2**64), size)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=sums[1:], dtype=np.uint64)
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, in three passes."""
    n = len(x)
    tiles = np.concatenate((x, np.full((-n) % width, x[-1], x.dtype))).reshape(-1, width)
    ahead = pick.accumulate(tiles, axis=1).ravel()
    behind = pick.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, rolling: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, prefix sums): every window of ``length`` bytes holds an anchor's gram."""
    gram = length // 2
    width = length - gram + 1
    sums = rolling.prefixes(data)
    starts = np.arange(len(data) - gram + 1)
    hashes = rolling.between(sums, starts, starts + gram)
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)
    return chosen, hashes[chosen], sums


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def branchings(strings: list[bytes]) -> tuple[list[int], dict[bytes, list[int]]]:
    """Depths of the nodes of the strings' compact trie, and the nodes on each string's path, from the root on."""
    depth, parent, stack = [0], [0], [0]

    def close(to: int) -> None:
        last = -1
        while depth[stack[-1]] > to:
            if last >= 0:
                parent[last] = stack[-1]
            last = stack.pop()
        if last < 0:
            return
        if depth[stack[-1]] < to:
            depth.append(to)
            parent.append(0)
            stack.append(len(depth) - 1)
        parent[last] = stack[-1]

    leaves, before = {}, b""
    for s in sorted(set(strings)):
        close(_shared(before, s))
        depth.append(len(s))
        parent.append(stack[-1])
        stack.append(len(depth) - 1)
        leaves[s], before = stack[-1], s
    close(0)
    paths = {}
    for s, node in leaves.items():
        path = []
        while node:
            path.append(node)
            node = parent[node]
        paths[s] = path[::-1]
    return depth, paths


def extents(lefts: list[bytes], rights: list[bytes], needed: int) -> list[tuple[int, int] | None]:
    """How far repeats reach to both sides of each occurrence of a gram; None where none is long enough.

    lefts (read backwards) and rights are the bytes around different occurrences.  Repeated is what is common to the
    left and the right of two occurrences, if it adds up to ``needed``.  Each occurrence becomes a short string: the
    edges of its path in the trie of the lefts, deepest first, a mark, the edges of its path in the trie of the rights.
    A suffix that starts with a left edge stands for all occurrences that share that much to the left; among those, its
    neighbours in the suffix array share most to the right.
    """
    left_depth, left_paths = branchings(lefts)
    right_depth, right_paths = branchings(rights)
    mark = len(left_depth) + 1  # left edges are 2 to mark - 1, right edges come after it, 1 ends a string
    symbols: list[int] = []
    owner: list[int] = []
    offsets: list[int] = []
    for k, (left, right) in enumerate(zip(lefts, rights)):
        string = [*(e + 1 for e in reversed(left_paths[left])), mark, *(mark + e for e in right_paths[right]), 1]
        symbols += string
        owner += [k] * len(string)
        offsets += range(len(string))
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order) + [0]
    found: list[tuple[int, int] | None] = [None] * len(lefts)
    for at, i in enumerate(order):
        k, offset = owner[i], offsets[i]
        path = left_paths[lefts[k]]
        to_mark = len(path) - offset
        if to_mark < 0:
            continue
        beyond = max(shared[at], shared[at + 1]) - to_mark - 1  # right edges in common
        if beyond < 0:
            continue
        right = right_paths[rights[k]]
        beyond = min(beyond, len(right))
        to_left = left_depth[path[to_mark - 1]] if to_mark else 0
        to_right = right_depth[right[beyond - 1]] if beyond else 0
        if to_left + to_right >= needed:
            best = found[k] or (0, 0)
            found[k] = max(best[0], to_left), max(best[1], to_right)
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:  # sorted
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def shared_windows(bodies: DataFrame, length: int) -> DataFrame:
    """row, start, end: what is repeated around the anchors of grams with many surroundings; no group of rows is formed.

    Each string of ``length`` bytes around an anchor becomes a row (gram, window hash), at the first of its least grams
    only, so no place comes twice.  The hashes are counted, partly before the shuffle; what is found once goes back to
    its anchor, which takes it from its strings: nothing is joined, and no hash brings its places together.  All strings
    of an anchor hold its gram, so the repeated ones together are one span.
    """
    gram = length // 2
    width = length - gram + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            took, froms, hashes = [], [], []
            for k, (left, body) in enumerate(zip(batch.column("left").to_pylist(), byte_texts(batch, "body"))):
                if len(body) < length:
                    continue
                sums = rolling.prefixes(np.frombuffer(body, np.uint8))
                at = np.arange(len(body) - gram + 1)
                grams = rolling.between(sums, at, at + gram)
                least = sliding(grams, width, np.minimum)
                same = np.flatnonzero(grams[:left] == grams[left])
                first = max(same[-1] + 1 if len(same) else 0, left - width + 1)
                start = first + np.flatnonzero(least[first : left + 1] == grams[left])
                took.append(np.full(len(start), k))
                froms.append(start - left)
                hashes.append(rolling.between(sums, start, start + length).view(np.int64))
            if not took:
                continue
            chosen = batch.select(["gram", "n", "row", "at"]).take(pa.array(np.concatenate(took)))
            start = chosen.column("at").to_numpy() + np.concatenate(froms)
            columns = [*chosen.columns, pa.array(start.astype(np.int32)), pa.array(np.concatenate(hashes))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "n", "row", "at", "start", "window"])

    found = bodies.mapInArrow(windows, "gram bigint, n bigint, row bigint, at int, start int, window bigint")
    found = materialize(found, "windows")
    # Surroundings that come more than once (n above 1) are repeated as a whole already.
    first = [F.first(c).alias(c) for c in ("n", "row", "at", "start")]
    alone = found.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("places"), *first).filter("places = 1 AND n = 1")
    none = F.lit(None).cast("int")
    ours = found.filter("n = 1").select("row", "at", "start", none.alias("alone"))
    ours = ours.unionByName(alone.select("row", "at", none.alias("start"), F.col("start").alias("alone")))
    # An anchor's strings start one after another, fewer than ``length`` of them; what is left of these is repeated.
    ours = ours.groupBy("row", "at").agg(F.min("start").alias("low"), F.max("start").alias("high"), F.collect_list("alone").alias("alone"))
    ours = ours.filter(F.size("alone") <= F.col("high") - F.col("low"))
    left = F.array_except(F.sequence("low", "high"), "alone")
    return ours.select("row", F.array_min(left).alias("start"), (F.array_max(left) + length).cast("int").alias("end"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """row, start, end: covered by strings of ``length`` bytes that start elsewhere as well; they overlap, unmerged."""
    gram = length // 2
    most = length - gram  # bytes that count on either side of a gram

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in batches:
            for row, content in zip(batch.column("row").to_pylist(), byte_texts(batch, "data")):
                if len(content) < length:
                    continue
                at, grams, sums = anchors(np.frombuffer(content, np.uint8), length, rolling)
                low, high = np.maximum(at - most, 0), np.minimum(at + length, len(content))
                around = rolling.between(sums, low, high) + (at - low).astype(np.uint64) * np.uint64(_STEP)
                columns = [grams.view(np.int64), around.view(np.int64), np.full(len(at), row), at, at - low, high - at - gram]
                names = ["gram", "around", "row", "at", "left", "right"]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names).cast(
                    pa.schema([(n, pa.int64() if n in names[:3] else pa.int32()) for n in names])
                )

    found = docs.mapInArrow(find, "gram bigint, around bigint, row bigint, at int, left int, right int")
    found = materialize(found, "anchors")
    kinds = found.groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("row", "at", "left", "right")]
    )
    # The same gram with the same bytes on both sides, more than once: everything around it is repeated.
    # Written, so that both sides of the join are plain shuffles: one that a common text makes large can be split.
    alike = materialize(kinds.filter("n > 1").select("gram", "around"), "alike")
    whole = found.filter(F.col("left") + F.col("right") >= length - gram).join(alike, ["gram", "around"], "left_semi")
    whole = whole.select("row", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + gram + F.col("right")).alias("end"))

    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("_least")).filter("kinds > 1 AND _least = 1")
    open_ = materialize(kinds.join(grams.select("gram", "kinds"), "gram"), "surroundings")

    def with_bodies(rows: DataFrame, bits: bytes) -> DataFrame:
        low = F.col("at") - F.col("left")
        return rows.join(passing(docs, "row", bits), "row").select(
            "gram", "kinds", "n", "row", "at", "left",
            F.substring("data", low + 1, F.col("left") + F.lit(gram) + F.col("right")).alias("body"),
        )

    many, few = open_.filter(F.col("kinds") > CELL), open_.filter(F.col("kinds") <= CELL)
    bits = id_filter(many, "row")
    if any(bits):
        whole = whole.unionByName(shared_windows(with_bodies(many, bits), length))
    bodies = with_bodies(few, id_filter(few, "row"))
    # Two surroundings that repeat enough share half of what is needed on one side: large groups are cut by that.
    half = -(-(length - gram) // 2)
    left_part = F.when(F.col("left") >= half, F.xxhash64(F.lit("left"), F.substring("body", F.col("left") - half + 1, F.lit(half))))
    rest = F.length("body") - F.col("left") - gram
    right_part = F.when(rest >= half, F.xxhash64(F.lit("right"), F.substring("body", F.col("left") + gram + 1, F.lit(half))))
    part = F.when(F.col("kinds") > LARGE, F.array_compact(F.array(left_part, right_part))).otherwise(F.array(F.lit(0).cast("bigint")))
    bodies = bodies.withColumn("part", F.explode(part)).withColumn("group", F.xxhash64("gram", "part"))
    sizes = few.agg(F.count(F.lit(1))).first()[0]  # one number
    cells = F.lit(max(1, math.ceil(sizes / CELL)))

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in cell.groupby(["group", "gram"], sort=False):
            if len(group) < 2 or group["n"].min() > 1:
                continue
            lefts = [b[:k][::-1] for b, k in zip(group["body"], group["left"])]
            rights = [b[k + gram :] for b, k in zip(group["body"], group["left"])]
            reached = extents(lefts, rights, length - gram)
            for n, row, at, e in zip(group["n"], group["row"], group["at"], reached):
                if e is not None and n == 1:
                    out.append((row, at - e[0], at + gram + e[1]))
        return pd.DataFrame(out, columns=["row", "start", "end"])

    cell = F.pmod("group", cells)
    partly = bodies.groupBy(cell.alias("cell")).applyInPandas(solve, "row bigint, start int, end int")
    return whole.unionByName(partly)


def without_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary): one row for each document.

    Removes every byte that lies in a string of ``length`` bytes which also starts at another place, of the same or
    another document; judged on the input.  Null texts count as empty, shorter ones lose nothing.  Every row is a
    document of its own, whatever its key.  ``docs`` is read several times and must come in the same partitions each
    time, as a table scan does.  Texts travel only where an anchor's surroundings differ from others of the same gram, and
    where a part is lost; 64-bit hashes find what is compared.  Very long texts are taken whole.  An empty table gives
    no rows; other columns do not matter.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")
    )
    plain = rows.select("row", "data")
    spans = repeated_spans(plain, length).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = materialize(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, found in zip(byte_texts(batch, "data"), batch.column("spans").to_pylist()):
                runs = _merged([(s["start"], s["end"]) for s in found])
                keep, at = [], 0
                for s, e in runs:
                    keep.append(content[at:s])
                    at = e
                kept = b"".join([*keep, content[at:]])
                out.append((len(content) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                names=["row", "n_removed", "n_spans", "sha", "cut"],
            )

    losing = passing(plain, "row", id_filter(spans, "row")).join(spans, "row")
    losing = losing.mapInArrow(cut, "row bigint, n_removed bigint, n_spans bigint, sha string, cut binary")
    facts = rows.select(
        "row", "key", F.length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("whole"), *(["data"] if with_text else [])
    )
    return facts.join(losing, "row", "left").select(
        F.col("key").alias(key),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        *([F.coalesce("cut", "data").alias("kept")] if with_text else []),
    )
