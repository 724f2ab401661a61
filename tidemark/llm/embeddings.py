"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import connected_components

COSINE = 0.93
MISS = 1e-4  # chance that a pair right at the threshold shares no bucket
BLOCK = 512  # rows of a large bucket compared in one group
CELL = 4096  # rows of small buckets handled in one group


def hash_shape(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits): buckets stay about equally full whatever the row count, and so does the recall."""
    bits = min(31, max(8, math.ceil(math.log2(max(rows, 1))) - 8))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - together)), bits


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that squares neither overflow nor vanish."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def sign_hashes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One number of ``bits`` signs for each row and table."""
    planes = np.random.default_rng((5, vectors.shape[1])).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def linked_pairs(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    similar = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1)))
    return np.nonzero(similar >= cosine)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _links(ids, copies, table, hashes, i, j) -> pd.DataFrame:
    """id, root, n of the rows with links; a pair counts in the first table in which its rows meet."""
    new = ~(hashes[i, :table] == hashes[j, :table]).any(axis=1)
    i, j = i[new], j[new]
    n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    root, linked = local_roots(len(ids), i, j), n > 0
    return pd.DataFrame({"id": ids[linked], "root": ids[root[linked]], "n": n[linked].astype(np.int64)})


FOUND = "id bigint, root bigint, n bigint"


def _unpacked(group: pd.DataFrame):
    group = group.sort_values("id", kind="stable")
    hashes = np.stack([np.frombuffer(h, np.uint32) for h in group["hashes"]])
    return group, group["id"].to_numpy(), group["copies"].to_numpy(), hashes, scaled(np.stack(group["vector"].to_numpy()))


def valid_vector(vector: str) -> Column:
    """Not null, every component a finite number, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """key, n_links, component_id, kept: one row for each vector.

    Equal vectors of one label are one class; the smallest id stands for it.  Each class falls into one bucket a
    table; classes of a bucket are compared exactly, in double precision, so no link below the threshold is made and
    one right at it is missed with a chance of 1e-4, at any size.  Small buckets share a group; large ones are cut
    into blocks and each group compares two of them.  Groups return counts and local components, not pairs.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, link with
    nothing: n_links 0, their own component (null for a null id), kept.  Vectors of unlike lengths do not link.  Rows
    that repeat an id are one node; each counts as a copy.  An empty table gives no rows; other columns do not matter.
    """
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    usable = rows.filter(valid_vector("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    tables, bits = hash_shape(usable.count(), cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            hashes: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                found = sign_hashes(scaled(np.array([vectors[k] for k in at])), tables, bits)
                for k, h in zip(at, found):
                    hashes[k] = h.tobytes()
            digests = [xxhash.xxh3_128_digest((np.array(v, np.float64) + 0.0).tobytes()) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.binary()), pa.array(hashes, pa.binary())],
                names=[*batch.schema.names, "digest", "hashes"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema.fields)
    signed = materialize(usable.mapInArrow(run, f"{fields}, digest binary, hashes binary"), "signed-vectors")
    classes = signed.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    of_rep = classes.select("label", "digest", F.col("rep").alias("id"), "copies")
    chosen = materialize(signed.join(of_rep, ["label", "digest", "id"]).dropDuplicates(["label", "digest"]), "vector-classes")

    table = F.col("table")
    own = F.substring(F.hex("hashes"), 8 * table + 1, F.lit(8))
    members = chosen.withColumn("table", F.explode(F.array(*[F.lit(t) for t in range(tables)])))
    members = members.withColumn("bucket", F.xxhash64("label", F.size("vector"), "table", own))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = members.select("bucket", "table", "id", "copies", "hashes", "vector").join(sizes, "bucket")
    small, large = members.filter(F.col("rows") <= BLOCK), members.filter(F.col("rows") > BLOCK)

    def within(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, bucket in group.groupby("bucket", sort=False):
            bucket, ids, copies, hashes, vectors = _unpacked(bucket)
            i, j = linked_pairs(vectors, vectors, cosine)
            i, j = i[i < j], j[i < j]
            if len(i):
                out.append(_links(ids, copies, int(bucket["table"].iloc[0]), hashes, i, j))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "root": [], "n": []}, dtype="int64")

    def across(group: pd.DataFrame) -> pd.DataFrame:
        first, second = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group, ids, copies, hashes, vectors = _unpacked(group)
        left, right = (np.flatnonzero(group["mine"].to_numpy() == b) for b in (first, second))
        i, j = linked_pairs(vectors[left], vectors[right], cosine)
        i, j = left[i], right[j]
        if first == second:
            i, j = i[i < j], j[i < j]
        return _links(ids, copies, int(group["table"].iloc[0]), hashes, i, j)

    cells = F.lit(max(1, math.ceil(chosen.count() * tables / CELL)))
    found = small.withColumn("cell", F.pmod("bucket", cells)).groupBy("cell").applyInPandas(within, FOUND)
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    large = large.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    found = found.unionByName(large.groupBy("bucket", "i", "j").applyInPandas(across, FOUND))

    found = found.groupBy("id", "root").agg(F.sum("n").alias("n"))  # the roots of a row are few
    found = materialize(found, "vector-links")
    components = connected_components(found, "id", "root")
    counts = found.groupBy("id").agg(F.sum("n").alias("others")).withColumnRenamed("id", "rep")
    named = classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    named = named.select(
        "label", "digest",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = signed.select("id", "label", "digest").join(named, ["label", "digest"])
    unusable = rows.filter(~(valid_vector("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()))
    out = linked.select("id", "n_links", "component_id").unionByName(
        unusable.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))
