"""MinHash near-duplicates of documents: banded candidates, odd sketches, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import connected_components
from .text import WordHash, byte_texts, id_filter, mixed, passing, space_words, window_hashes

SHINGLE = 5
SIMILARITY = 80  # percent
SAMPLES, BAND = 256, 4
BANDED = 128  # samples in bands, 32 of 4: a pair at 0.8 shares none with probability 5e-8
SKETCH_BITS = 1024
MARGIN = 0.13  # below the similarity, 5 deviations of the estimate from 256 samples
BLOCK = 1024  # rows of a bucket compared in one group
BLOCK_BYTES = 1 << 23
CELL = 4096  # rows of small buckets handled in one group
SIGNATURE_BYTES = 500  # of a row's bands and sketch

_RNG = np.random.default_rng(8)
SALTS = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
FACTORS = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes | None, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one shingle as a whole."""
    words = hashes.of(space_words(text))
    return np.unique(window_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima, each under its own hash function."""
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):  # a block of hash values stays in the cache
        values = (short[i : i + 512, None] ^ SALTS) * FACTORS
        np.minimum(low, values.min(axis=0), out=low)
    return low


def band_keys(minima: np.ndarray) -> np.ndarray:
    wide = minima.astype(np.uint64).reshape(-1, BAND)
    keys = np.arange(len(wide), dtype=np.uint64)
    for i in range(BAND):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, i])
    return keys.view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Each (sample number, minimum) flips one bit: the bits of two sketches differ where their samples do."""
    numbered = minima.astype(np.uint64) | (np.arange(len(minima), dtype=np.uint64) << np.uint64(32))
    flips = np.bincount((mixed(numbered) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def unsigned(sketches) -> np.ndarray:
    """Stacked sketches as unsigned words: numpy counts the bits of a negative number's absolute value."""
    return np.stack([np.asarray(s) for s in sketches]).view(np.uint64)


def most_differing_bits(similarity: float) -> int:
    """Sketch bits that differ at an estimated similarity: the odd-sketch estimate solved for the XOR count."""
    differing = 2 * SAMPLES * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


SIGNATURE = "id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows: list[tuple] = []
            for content in byte_texts(batch):
                shingles = shingle_set(content, size, hashes)
                if not len(shingles):
                    rows.append((0, None, None, None))
                    continue
                minima = minhash(shingles)
                rows.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), band_keys(minima[:BANDED]), odd_sketch(minima)))
            longs = pa.list_(pa.int64())
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), longs, longs))]],
                names=["id", "n_shingles", "digest", "bands", "sketch"],
            )

    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, SIGNATURE)


def differing_bits(a: str, b: str) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def _texts_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of some documents.  Before the join, a filter by hash leaves out the others where they are read."""
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return passing(texts, "id", id_filter(ids, "id")).join(ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Only the texts of documents in pairs are kept; those of b travel once for each pair, those of a once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, first = WordHash(), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), byte_texts(batch, "x"), byte_texts(batch, "y")):
                if (a, x) != last:
                    last, first = (a, x), shingle_set(x, size, hashes)
                second = shingle_set(y, size, hashes)
                common = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * common >= similarity * (len(first) + len(second) - common) > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = materialize(ends, "ends")
    texts = materialize(_texts_of(docs, ends, key, text), "texts")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def _similar_sketches(pairs: DataFrame, signed: DataFrame, most: int) -> DataFrame:
    sketches = signed.select("id", "sketch")
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a")
    both = both.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b")
    return both.filter(differing_bits("s", "t") <= most).select("a", "b").distinct()


def _slices(rows: np.ndarray, at: np.ndarray, size: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size], at[i : i + size]


Compare = Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame]


def _compare_in_blocks(members: DataFrame, payload: DataFrame, compare: Compare, schema: str) -> DataFrame:
    """``compare(bucket, left, right)`` for the rows of each bucket, all with all.

    ``members``: bucket, id, component, weight (bytes that the row will bring); ``payload``: id and what is compared.
    Rows are dealt while they are narrow; what is compared joins them last.  Small buckets share a group.  Large ones
    are cut into blocks of BLOCK rows or BLOCK_BYTES at most, and a group holds two of them, so no group grows with
    the bucket; left is right where a block meets itself.
    """

    def group_of(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        if i < 0:
            return pd.concat([compare(key, bucket, bucket) for key, bucket in rows.groupby("bucket", sort=False)])
        left = rows[rows["mine"] == i]
        return compare(rows["bucket"].iloc[0], left, left if i == j else rows[rows["mine"] == j])

    weights = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("bytes")), "weights")
    rows, size = weights.agg(F.sum("n"), F.sum("bytes")).first()  # two numbers
    cells = F.lit(max(1, math.ceil((rows or 0) / CELL), math.ceil((size or 0) / (4 * BLOCK_BYTES))))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = members.join(weights.select("bucket", blocks.alias("blocks")), "bucket").drop("weight")
    small = F.col("blocks") == 1
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = placed.withColumns({"small": small, "mine": F.when(small, -1).otherwise(mine)})
    others = F.when(F.col("small"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", F.explode(others))
    placed = placed.select(
        F.when(F.col("small"), F.pmod("bucket", cells)).otherwise(F.col("bucket")).alias("cell"),
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        *[c for c in placed.columns if c not in ("small", "other", "blocks")],
    )
    return placed.join(payload.hint("merge"), "id").groupBy("cell", "i", "j").applyInPandas(group_of, schema).distinct()


def _frame(columns: dict[str, np.ndarray | list]) -> pd.DataFrame:
    return pd.DataFrame({name: np.asarray(values, np.int64) for name, values in columns.items()})


def _differing(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Parts of left, and the sketch bits in which they differ from all of right; within a component all of them."""
    theirs, component = unsigned(right["sketch"]), right["component"].to_numpy()
    for i in range(0, len(left), 128):
        part = left.iloc[i : i + 128]
        bits = np.bitwise_count(unsigned(part["sketch"])[:, None] ^ theirs).sum(axis=2, dtype=np.int32)
        bits[part["component"].to_numpy()[:, None] == component] = SKETCH_BITS
        yield part, bits


def _nearest(most: int) -> Compare:
    """Pairs (a, b): each row with the nearest one of another component."""

    def compare(bucket: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, others = [np.empty((0, 2), np.int64)], right["id"].to_numpy()
        for part, bits in _differing(left, right) if len(left) and len(right) else ():
            at = bits.argmin(axis=1)
            rows = np.flatnonzero(bits[np.arange(len(part)), at] <= most)
            out.append(np.column_stack((part["id"].to_numpy()[rows], others[at[rows]])))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return _frame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compare


def _alike(bucket: int, left: pd.DataFrame, right: pd.DataFrame, most: int, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and of right that are alike by the sketch and by size; only in the first bucket that they share.

    Sets of which one is smaller than ``similarity`` percent of the other cannot be that similar.
    """
    if not len(left) or not len(right):
        return
    ids, others = left["id"].to_numpy(), right["id"].to_numpy()
    sizes, their_sizes = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
    keys, theirs = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
    begin = 0
    for part, bits in _differing(left, right):
        own = sizes[begin : begin + len(part), None]
        fits = (bits <= most) & (100 * np.minimum(own, their_sizes) >= similarity * np.maximum(own, their_sizes))
        rows, at = np.nonzero(fits & (ids[begin : begin + len(part), None] < others if left is right else True))
        rows = rows + begin
        begin += len(part)
        for r, t in _slices(rows, at):
            first = keys[r, (keys[r] == theirs[t]).argmax(axis=1)] == bucket
            yield r[first], t[first]


def _with_partner(most: int, similarity: int) -> Compare:
    """(bucket, id) of the rows that have one alike in another component."""

    def compare(bucket: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for r, t in _alike(bucket, left, right, most, similarity):
            mine[r] = theirs[t] = True
        ids = np.unique(np.concatenate([left["id"].to_numpy()[mine], right["id"].to_numpy()[theirs]]))
        return _frame({"bucket": np.full(len(ids), bucket), "id": ids})

    return compare


def _spanning(most: int, similarity: int) -> Compare:
    """Links (a, b) that join what is linked among the rows, confirmed on full sets: fewer than there are rows.

    Pairs that other links have joined already are not looked at.
    """

    def compare(bucket: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := parent.get(x, x)) != x:
                parent[x] = parent.get(above, above)
                x = above
            return x

        links = []
        sets, others = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
        ids, their_ids = left["id"].tolist(), right["id"].tolist()
        components, their_components = left["component"].tolist(), right["component"].tolist()
        for rows, at in _alike(bucket, left, right, most, similarity):
            for r, t in zip(rows.tolist(), at.tolist()):
                one, other = root(components[r]), root(their_components[t])
                x, y = sets[r], others[t]
                if one == other:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= similarity * (len(x) + len(y) - common):
                    links.append((ids[r], their_ids[t]))
                    parent[max(one, other)] = min(one, other)
        return _frame({"a": [a for a, _ in links], "b": [b for _, b in links]})

    return compare


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, digest, shingles): the sorted sets of some documents as 64-bit hashes, one for each id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(content, size, hashes).tobytes() for content in byte_texts(batch)]
            digests = [xxhash.xxh3_128_digest(x) for x in sets]
            columns = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "shingles"])

    return _texts_of(docs, ids, key, text).mapInArrow(run, "id bigint, digest binary, shingles binary").dropDuplicates(["id", "digest"])


def _remaining_links(
    members: DataFrame, chosen: DataFrame, docs: DataFrame, key: str, text: str, size: int, most: int, similarity: int
) -> DataFrame:
    """Links between components within buckets (bucket, id, component): none that matters is missing.

    First the rows are found that have anyone alike in another component; their sets then travel once for each of
    their buckets, and are compared where they meet.  Neither step gives a row for a pair that is no link.
    """
    signatures = chosen.select("id", "digest", "sketch", "bands", "n_shingles")
    plain = members.withColumn("weight", F.lit(SIGNATURE_BYTES).cast("bigint"))
    alike = _compare_in_blocks(plain, signatures.drop("digest"), _with_partner(most, similarity), "bucket bigint, id bigint")
    alike = materialize(alike, "alike")
    ids = materialize(alike.select("id").distinct(), "ids")
    sets = shingle_sets(docs, ids, key, text, size).join(signatures, ["id", "digest"]).drop("digest")
    sets = materialize(sets, "sets")
    sizes = sets.groupBy("id").agg(F.sum(8 * F.col("n_shingles") + SIGNATURE_BYTES).alias("weight"))
    rows = members.join(alike, ["bucket", "id"]).join(sizes, "id")
    return _compare_in_blocks(materialize(rows, "compared"), sets, _spanning(most, similarity), "a bigint, b bigint")


def _mixed_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, id, component of the rows of buckets that hold several components."""
    members = shared.join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    members = materialize(members.select("bucket", "id", F.coalesce("component", "id").alias("component")), "members")
    several = members.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    several = several.filter("_low < _high").select("bucket")
    return materialize(members.join(several, "bucket"), "mixed-buckets")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links."""
    links = materialize(links, "links")
    if links.isEmpty():
        return found
    tied = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return materialize(connected_components(tied, "a", "b"), "components")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """doc id, n_shingles, component_id and kept, one row for each document.

    1. Each text gives its shingle set's size, digest, MinHash bands and an odd sketch of its samples.
    2. Documents with equal sets form a class; its smallest id stands for it.  Copies never meet in pairs.
    3. In each band bucket every class is paired with the smallest id; sketches sort out the unlike, full sets confirm
       the rest, and components are formed.
    4. In buckets that still hold several components each class is paired with the nearest one of another component,
       by the sketches, confirmed and joined.
    5. Buckets that even then hold several components are compared whole, in blocks, across components only, by the
       sketches and then on full sets: after this no link is missing.  Only joining links come out of a block, so texts
       that are alike but not linked cost comparisons, not rows.

    Linked are documents with 100 * intersection >= similarity * union.  Null and empty texts have the empty set and
    link with nothing; their component is their own id.  Rows that share an id are one node.  Rows with a null id
    follow their class; if no row of it has an id, component_id is null and they are kept.  Very long texts are taken
    whole, with 8 bytes in memory for each shingle.  An empty table gives no rows; other columns do not matter.
    """
    most = most_differing_bits(similarity / 100 - MARGIN)
    signed = materialize(signatures(docs, key, text, shingle), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"))
    chosen = materialize(
        full.join(classes.filter("rep IS NOT NULL").select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi"),
        "classes",
    )
    buckets = chosen.select(F.explode("bands").alias("bucket"), "id")

    sizes = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Both sides grow with the corpus: a merge join at every size, so that cost grows as the corpus does.
    shared = materialize(buckets.join(sizes.hint("merge"), "bucket"), "buckets")
    tried = shared.filter("low < id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    tried = materialize(_similar_sketches(tried, chosen, most), "stars")
    links = materialize(_confirmed(tried, docs, key, text, shingle, similarity), "links")
    found = materialize(connected_components(links, "a", "b"), "components")

    rest = _mixed_buckets(shared, found).withColumn("weight", F.lit(SIGNATURE_BYTES).cast("bigint"))
    pairs = _compare_in_blocks(rest, chosen.select("id", "sketch"), _nearest(most), "a bigint, b bigint")
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = _joined(found, _confirmed(pairs, docs, key, text, shingle, similarity))

    rest = _mixed_buckets(shared, found)
    found = _joined(found, _remaining_links(rest, chosen, docs, key, text, shingle, most, similarity))

    named = classes.join(found, F.col("rep") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("_component"))
    rows = signed.join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("id"))
    rows = rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
