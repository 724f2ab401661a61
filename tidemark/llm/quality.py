"""Quality classifier: histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import byte_texts, with_column

SAMPLE = 20_000  # labelled rows the trees are fitted on: those with the smallest hashes of their ids
BINS, DEPTH, TREES, RATE, L2, LEAST_ROWS = 64, 4, 80, 0.12, 1.0, 10
THRESHOLD = 0.3

_KIND = np.full(256, 5, np.int64)  # 0 lower case, 1 upper case, 2 digits, 3 white space, 4 punctuation, 5 other, 6 not ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 4
_KIND[128:] = 6
SYMBOLS = [ord(c) for c in "!$%&*#|<>{}@=+/_"]


def text_statistics(text: bytes | None) -> list[float]:
    """Numbers about a text's shape; those of a null or empty text are all 0."""
    if not text:
        return [0.0] * (7 + len(SYMBOLS) + 12)
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 7) / size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = text.split(b"\n")
    different = set(lines)
    return [
        *kinds,
        *(counts[SYMBOLS] / size),
        np.log1p(size),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        pairs / max(len(words) - 1, 1),
        np.log1p(len(lines)),
        size / len(lines),
        len(different) / len(lines),
        sum(map(len, different)) / size,
    ]


FEATURES = len(text_statistics(None))


@dataclass
class Trees:
    """Complete trees as flat arrays: node k of a tree has the children 2k + 1 and 2k + 2; ``leaf`` starts after them."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # a row goes right when its value is above
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:  # all leaves are equally deep
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting with logistic loss over quantile bins; without rows of both labels, a constant (1/2 without any rows)."""
    inner, n = 2**depth - 1, len(y)
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(n, model.base)
    rows = np.arange(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        edge = np.full(inner, BINS)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f, c in enumerate(cuts):
                cell = (at - first) * BINS + binned[:, f]
                g, h, k = (
                    np.cumsum(np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS), axis=1)
                    for w in (gradient, weight, np.ones(n))
                )
                G, H, K = g[:, -1:], h[:, -1:], k[:, -1:]
                gain = g**2 / (h + L2) + (G - g) ** 2 / (H - h + L2) - G**2 / (H + L2)
                gain[(k < LEAST_ROWS) | (K - k < LEAST_ROWS)] = 0
                gain[:, len(c) :] = 0
                b = gain.argmax(axis=1)
                found = gain[np.arange(nodes), b]
                for m in np.flatnonzero(found > best):
                    best[m], feature[first + m], cut[first + m], edge[first + m] = found[m], f, c[b[m]], b[m]
            at = 2 * at + 1 + (binned[rows, feature[at]] > edge[at])
        leaf = RATE * np.bincount(at - inner, gradient, inner + 1) / (np.bincount(at - inner, weight, inner + 1) + L2)
        score += leaf[at - inner]
        model.feature = np.vstack((model.feature, feature))
        model.cut = np.vstack((model.cut, cut))
        model.leaf = np.vstack((model.leaf, leaf))
    return model


def remainder(key: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def training_rows(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, labels) of at most ``sample`` labelled rows outside the held-out fold, the same in every run.

    Where more rows are labelled, those with the smallest hashes of their ids are taken; so the list sent to the
    executors and the numbers that come back are bounded by ``sample``.
    """
    usable = labels.filter((remainder(key) != 0) & F.col(label).isin(0, 1)).select(key, label)
    picked = usable.orderBy(F.xxhash64(key), label).limit(sample)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_statistics(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(stats, pa.list_(pa.float64())), batch.column("label"), batch.column("order")], names=["x", "label", "order"]
            )

    rows = rows.select("text", F.col(label).cast("int").alias("label"), F.xxhash64(key, "text").alias("order"))
    # Rows that share an id could be more than the sample; the same bound holds for them.
    found = rows.mapInArrow(run, "x array<double>, label int, order bigint").orderBy("order", "label").limit(sample).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), FEATURES)
    return x, found["label"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, **options) -> Trees:
    """The trees fitted on ``training_rows``; without any, or without documents, every text scores 1/2."""
    return fit(*training_rows(docs, labels, **options))


def with_score(docs: DataFrame, model: Trees, name: str, text: str = "text") -> DataFrame:
    """The documents with a column ``name``: the probability of label 1, from the text alone.

    Null and empty texts score as a text whose statistics are all 0.  No shuffle; each text is read once, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_statistics(t) for t in byte_texts(batch, text)], np.float64).reshape(-1, FEATURES)
            yield with_column(batch, name, pa.array(model.score(x)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
