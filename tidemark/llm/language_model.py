"""Language-model scores from a weighted backoff automaton over smoothed word n-grams.

States are contexts (the last words read).  An arc of a state is an n-gram that was seen in training; where a word
has no arc, the failure arc leads to the shorter context and costs its backoff weight.  No task ever holds the whole
automaton: the documents are read in blocks, each block asks for the n-grams that occur in it, and gets the part of the
automaton that its traversal can touch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .text import WordHash, byte_texts, mixed, space_words

ORDER = 2
PRIOR = 30.0  # weight of the shorter context's estimate, in counts
BLOCK_TOKENS = 1 << 18
BUCKET_BYTES = 12_000_000  # of text for each bucket of n-gram hashes
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # no word's hash but by a chance of 2**-64


def packed(hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of all: the leading zeros compress to nothing."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def fingerprint(tokens: list[np.ndarray]) -> int:
    """The same for the same documents in any order."""
    return sum(xxhash.xxh3_64_intdigest(t.tobytes()) for t in tokens) % 2**63


class Block:
    """The tokens of some documents, each led by a start mark, and their distinct n-grams of every order."""

    def __init__(self, tokens: list[np.ndarray], order: int):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        sizes = self.lengths + 2
        self.first = np.cumsum(sizes) - sizes  # the start mark of each document
        self.tokens = np.empty(int(sizes.sum()), np.uint64)
        place = np.arange(len(self.tokens)) - np.repeat(self.first, sizes)
        self.tokens[self.first] = START
        self.tokens[self.first + sizes - 1] = END
        words = (place > 0) & (place < np.repeat(sizes - 1, sizes))
        self.tokens[words] = np.concatenate(tokens) if tokens else []
        self.document = np.repeat(np.arange(len(tokens)), sizes)
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # positions, distinct hashes, index of each
        for k in range(1, order + 1):
            at = np.flatnonzero((place >= 1) & (place >= k - 1))
            hashes = self.tokens[at]
            if k > 1:
                hashes = self.tokens[at - k + 1] + np.uint64(k)
                for i in range(k - 2, -1, -1):
                    hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + self.tokens[at - i])
            self.grams.append((at, *np.unique(hashes, return_inverse=True)))

    def learned(self, k: int, learn: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct (k + 1)-gram in the documents to learn from."""
        at, distinct, index = self.grams[k]
        return np.bincount(index[learn[self.document[at]]], minlength=len(distinct))


def bucket_edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the leading bits of a hash) begins in the sorted hashes."""
    return np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))


EMPTY, AT_START = 0, 1  # states: no context, and the start mark as context
UNSEEN = 1.0  # no logarithm of a probability


class Automaton:
    """The part of the weighted backoff automaton that a block's traversal can touch.

    A state is a context of the block: nothing, the start mark, or the last 1 to order - 1 tokens.  An n-gram that was
    seen in training is an arc from the state of its context, with the log10 of
    (count + prior * shorter) / (count of the context + prior); shorter is the estimate from the context without its
    first token.  Where a word has no arc, the failure arc leads to that shorter context and costs
    log10(prior / (count of the context + prior)).  The empty context has an arc for every word, seen or not.

    A state and the word after it are an n-gram of the block, so arcs have the numbers of the block's n-grams, one
    order after the other, and the number at each place is known without a search.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        self.order, start = len(block.grams), np.full(len(block.tokens), -1, np.int64)
        read = block.grams[0][0]  # places of all tokens but the start marks
        arcs, states = 0, 2  # numbered so far
        failure, backoff = [np.zeros(2, np.int64)], [np.zeros(2)]
        weights, targets, self.arc_at = [], [], []
        for k, (at, distinct, index) in enumerate(block.grams, 1):
            shown = np.zeros(len(distinct), np.int64)
            shown[index] = at  # a place of each n-gram
            if k == 1:
                # A text starts as often as one ends.
                starts = float(counts[0][np.searchsorted(distinct, END)])
                backoff[0][AT_START] = math.log10(prior / (starts + prior))
                estimates, seen = (counts[0] + 1.0) / (tokens + types + 1), np.ones(len(distinct), bool)
                shorter = np.full(len(distinct), EMPTY)
                self.single = estimates
            else:
                before = ended[shown - 1]  # the context, by its number; none: the start mark
                context = np.where(before >= 0, counts[k - 2][before], starts)
                estimates = (counts[k - 1] + prior * estimates[ended[shown]]) / (context + prior)
                seen, shorter = counts[k - 1] > 0, first_state + ended[shown]
            weights.append(np.where(seen, np.log10(estimates), UNSEEN))
            ended = start.copy()
            ended[at] = index
            self.arc_at.append((arcs + ended[read]).tolist())  # meaningless where the text is too short, and not asked
            arcs += len(distinct)
            if k < self.order:
                first_state, states = states, states + len(distinct)
                targets.append(first_state + np.arange(len(distinct)))
                failure.append(shorter)
                backoff.append(np.log10(prior / (counts[k - 1] + prior)))
            else:
                targets.append(shorter)
        self.weights, self.targets, self.failure, self.backoff = (
            np.concatenate(x).tolist() for x in (weights, targets, failure, backoff)
        )

    def traverse(self, lengths: list[int]) -> list[float]:
        """The log-probability of each text: one pass from left to right that carries the state."""
        weights, targets, failure, backoff = self.weights, self.targets, self.failure, self.backoff
        order, arc_at, place, out = self.order, [[], *self.arc_at], 0, []
        for length in lengths:
            state, k, total = (AT_START, 2, 0.0) if order > 1 else (EMPTY, 1, 0.0)  # k: the tokens of state and word
            for place in range(place, place + length):
                arc = arc_at[k][place]
                while (weight := weights[arc]) > 0:
                    total += backoff[state]
                    state, k = failure[state], k - 1
                    arc = arc_at[k][place]
                total += weight
                state = targets[arc]
                if k < order:
                    k += 1
            place += 1
            out.append(total)
        return out


def block_scores(block: Block, counts: list[np.ndarray], tokens: int, types: int, prior: float):
    """(n_known, base_score, score) of each document.  counts: by order, those of the block's distinct n-grams."""
    if not len(block.lengths):
        return np.empty(0, np.int64), np.empty(0), np.empty(0)
    index = block.grams[0][2]
    automaton = Automaton(block, [np.asarray(c) for c in counts], tokens, types, prior)
    sizes = block.lengths + 1
    begins = np.cumsum(sizes) - sizes
    known = np.add.reduceat((np.asarray(counts[0])[index] > 0).astype(np.int64), begins)
    base = np.add.reduceat(np.log10(automaton.single)[index], begins)
    return known, base, np.array(automaton.traverse(sizes.tolist()))


def held_out(key: str, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id as text falls into the fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int):
    """(number, batches of rows, token hashes) of runs of documents with about ``limit`` tokens, in the order of the input."""
    hashes, number, size = WordHash(), TaskContext.get().partitionId() << 32, 0
    rows: list[pa.RecordBatch] = []
    tokens: list[np.ndarray] = []
    for batch in batches:
        begin = 0
        for i, text in enumerate(byte_texts(batch)):
            tokens.append(hashes.of(space_words(text)))
            size += len(tokens[-1]) + 1
            if size >= limit:
                yield number, [*rows, batch.slice(begin, i + 1 - begin)], tokens
                rows, tokens, size, begin, number = [], [], 0, i + 1, number + 1
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if tokens:
        yield number, rows, tokens


def scores(
    docs: DataFrame,
    learn: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    prior: float = PRIOR,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """key, learned, n_tokens, n_known, train_tokens, base_score, score of every document, in log10.

    Learns from all rows where ``learn`` is true, whole, without a cut-off.  Tokens are words and one end mark.
    1. Every block sends its distinct n-grams with their training counts, as packed arrays, to buckets by hash.  A
       frequent word travels once for each block, so no bucket is hot.
    2. A bucket adds up the counts and sends each block those of its own n-grams.
    3. The texts of a block meet these counts, and one traversal scores them.
    ``docs`` is read twice and must come in the same partitions both times, as a table scan does; a block that differs
    is an error, never a wrong score.  Null and empty texts have one token, the end.  Null ids are kept; rows that
    repeat an id are documents of their own.  Very long texts are blocks of their own.  An empty table gives no rows;
    other columns do not matter.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), learn.alias("learn"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    bits = max(3, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, tokens in _blocks(batches, block_tokens):
            block = Block(tokens, order)
            use = np.array([bool(x) for b in rows for x in b.column("learn").to_pylist()])
            grams = [(distinct, block.learned(k, use), bucket_edges(distinct, bits)) for k, (_, distinct, _) in enumerate(block.grams)]
            mark = fingerprint(tokens)
            for bucket in range(2**bits):
                cut = [slice(e[bucket], e[bucket + 1]) for _, _, e in grams]
                if any(c.stop > c.start for c in cut):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([bucket], pa.int32()),
                            "block": pa.array([number], pa.int64()),
                            "mark": pa.array([mark], pa.int64()),
                            "hashes": pa.array([[packed(h[c]) for (h, _, _), c in zip(grams, cut)]], pa.list_(pa.binary())),
                            "counts": pa.array([[packed_counts(n[c]) for (_, n, _), c in zip(grams, cut)]], pa.list_(pa.binary())),
                        }
                    )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list[bytes]] = [[] for _ in range(len(rows))]
        stats = (0, 0)
        for k in range(order):
            hashes = [unpacked(h[k]) for h in rows["hashes"]]
            ends = np.cumsum([len(h) for h in hashes])
            _, index = np.unique(np.concatenate(hashes), return_inverse=True)
            summed = np.bincount(index, np.concatenate([unpacked_counts(c[k]) for c in rows["counts"]])).astype(np.int64)
            if k == 0:
                stats = int(summed.sum()), int((summed > 0).sum())
            for i, part in enumerate(np.split(summed[index], ends[:-1])):
                out[i].append(packed_counts(part))
        found = pd.DataFrame({"block": rows["block"], "mark": rows["mark"], "bucket": rows["bucket"], "counts": out, "tokens": 0, "types": 0})
        found["tokens"] = [stats[0], *[0] * (len(rows) - 1)]  # once for each bucket
        found["types"] = [stats[1], *[0] * (len(rows) - 1)]
        return found

    asked = docs.select("text", "learn").mapInArrow(ask, "bucket int, block bigint, mark bigint, hashes array<binary>, counts array<binary>")
    answered = asked.groupBy("bucket").applyInPandas(
        answer, "block bigint, mark bigint, bucket int, counts array<binary>, tokens bigint, types bigint"
    )
    answered = materialize(answered, "ngram-counts")
    tokens, types = (x or 0 for x in answered.agg(F.sum("tokens"), F.sum("types")).first())  # one row

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, parts in _blocks(batches, block_tokens):
            mark = fingerprint(parts)
            for batch in rows:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([number] * batch.num_rows, pa.int64()), pa.array([mark] * batch.num_rows, pa.int64())],
                    names=[*batch.schema.names, "block", "mark"],
                )

    def score(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["bucket"].notna()].sort_values("bucket")
        texts = group[group["bucket"].isna()]
        hashes = WordHash()
        block = Block([hashes.of(space_words(t)) for t in texts["text"]], order)
        counts = [np.concatenate([unpacked_counts(c[k]) for c in known["counts"]]) if len(known) else [] for k in range(order)]
        if group["mark"].nunique() > 1 or any(len(c) != len(g[1]) for c, g in zip(counts, block.grams)):
            raise RuntimeError("the documents came in other partitions the second time; write them to a table first")
        n_known, base, value = block_scores(block, counts, tokens, types, prior)
        return pd.DataFrame(
            {
                "id": texts["id"].to_numpy(), "learn": texts["learn"].to_numpy(), "n_tokens": block.lengths + 1,
                "n_known": n_known, "base_score": base, "score": value,
            }
        )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", F.col("text").cast("binary").alias("text"), "learn")
    rows = rows.mapInArrow(numbered, f"id {kind}, text binary, learn boolean, block bigint, mark bigint")
    rows = rows.unionByName(answered.select("block", "mark", "bucket", "counts"), allowMissingColumns=True)
    found = rows.groupBy("block").applyInPandas(
        score, f"id {kind}, learn boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return found.select(
        F.col("id").alias(key), F.col("learn").alias("learned"), "n_tokens", "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
