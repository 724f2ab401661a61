"""A Merkle manifest of a data set: one tree for each group of rows, one tree over their roots, a proof for each row.

Nodes of a level are rows (tree, index, digest).  A node's siblings have indices that follow from its own: each level
is an equijoin with itself by computed index, and the nodes in slot 0 emit the parents.  The way back down hands each
node the digests beside its path to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .order import in_groups
from .text import fresh

ARITY = 3


def field(column: Column | str) -> Column:
    """A value as hashed text: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column | str) -> Column:
    """The digest of a row: of its fields one after the other."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def text_of(digests: Column | str) -> Column:
    """Digests one after the other as lower-case hexadecimal text."""
    return F.lower(F.hex(digests))


def joined(digests: Column | str) -> Column:
    """The digest of digests one after the other, each as text."""
    return F.unhex(F.sha2(text_of(digests), 256))


@dataclass(frozen=True)
class Level:
    """Nodes (tree, at, digest, left, right): the siblings' digests before and after the node's own, joined.

    ``left`` and ``right`` are null for a root: a node alone at its level.
    """

    nodes: DataFrame

    @staticmethod
    def of(nodes: DataFrame, arity: int, name: str) -> Level:
        slot = F.col("at") % arity
        others = nodes.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "digest")
        rows, before, after = nodes, F.lit(b""), F.lit(b"")
        for shift in range(1, arity):
            # A pair's other one is at the index with its last bit turned; else slots shift round.
            index = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + shift) % arity
            other, tree, at = f"_other{shift}", f"_tree{shift}", f"_at{shift}"
            beside = others.toDF(tree, at, other)
            rows = rows.join(beside, (F.col("tree") == F.col(tree)) & (index == F.col(at)), "left").drop(tree, at)
            digest = F.coalesce(F.col(other), F.lit(b""))
            before = F.concat(before, F.when(slot + shift >= arity, digest).otherwise(F.lit(b"")))
            after = F.concat(after, F.when(slot + shift < arity, digest).otherwise(F.lit(b"")))
        # Siblings in a row's own slots follow in ascending order of the shift on either side.
        alone = (F.col("at") == 0) & (F.octet_length(after) == 0)
        left, right = F.when(~alone, before), F.when(~alone, after)
        beside = [f"_other{shift}" for shift in range(1, arity)]
        return Level(materialize(rows.withColumns({"left": left, "right": right}).drop(*beside), name))

    def parents(self, arity: int) -> DataFrame:
        first = self.nodes.filter((F.col("at") % arity == 0) & F.col("right").isNotNull())
        up = F.expr(f"at div {arity}")
        return first.select("tree", up.alias("at"), joined(F.concat("digest", "right")).alias("digest"))

    def roots(self) -> DataFrame:
        return self.nodes.filter(F.col("right").isNull()).select("tree", "digest")


def _levels(nodes: DataFrame, largest: int, arity: int) -> list[Level]:
    """The levels of trees of at most ``largest`` leaves, from the leaves to the roots."""
    levels = [Level.of(nodes, arity, "leaves")]
    while largest > 1:
        largest = -(-largest // arity)
        levels.append(Level.of(levels[-1].parents(arity), arity, "level"))
    return levels


def _paths(levels: list[Level], top: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """The leaves with ``top``'s columns (tree, root, steps) and, put before its steps, those of each node's own path.

    A step is (left, right).  ``steps`` of a root are those of ``top``.
    """
    carried = [c for c in top.columns if c not in ("tree", "steps")]
    above = None
    for depth, level in reversed(list(enumerate(levels))):
        columns = ["tree", "at", *(keep if depth == 0 else [])]
        ends = level.nodes.filter(F.col("right").isNull()).select(*columns)
        paths = ends.join(top, "tree").select(*columns, *carried, "steps")
        if above is not None:
            inner = level.nodes.filter(F.col("right").isNotNull())
            parent = above.withColumnsRenamed({"tree": "_tree", "at": "_at", "steps": "_steps"})
            inner = inner.join(parent, (F.col("tree") == F.col("_tree")) & (F.expr(f"at div {arity}") == F.col("_at")))
            steps = F.concat(F.array(F.struct("left", "right")), F.col("_steps"))
            paths = paths.unionByName(inner.select(*columns, *carried, steps.alias("steps")))
        above = paths
    return above


def manifest(
    rows: DataFrame, digest: str, *, group: str = "source", key: str = "doc_id", arity: int = ARITY
) -> tuple[DataFrame, str | None]:
    """(the rows with ``subroot`` and ``steps``, the root as text).

    Rows with a leaf digest (binary, in column ``digest``) form one tree for each value of ``group`` (null is one of
    them), ordered by ``key``, null first, rows with an equal key by digest; the trees' roots, in order of the group,
    form the last tree.  Each ``arity`` consecutive nodes have the digest of their digests as parent, also fewer at a
    level's end, until one is left.  ``steps``, from the leaf to the root, are (left, right): the digests beside the
    node on the path, before and after it, joined.  No table: no rows, and no root.

    A level is stored once, and has 1/``arity`` of the rows of the one below it.  A group may hold any share of the
    rows: joins are by tree and index.  Other columns stay; text columns should be left out, as rows are sorted.
    """
    if arity < 2:
        raise ValueError("a parent has two children at least")
    reserved = {"tree", "at", "left", "right", "subroot", "steps"}
    if clash := reserved & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    (own,) = fresh(rows, "digest") if digest != "digest" else (digest,)
    rows = rows.withColumnRenamed(digest, own)
    placed, (tree, at) = in_groups(rows, group, [F.col(key).asc_nulls_first(), F.col(own).asc()])
    keep = rows.columns
    # The columns that only pass through wait in one struct, so that no name can clash.
    leaves = placed.select(
        F.col(tree).alias("tree"), F.col(at).alias("at"), F.col(own).alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
    )
    largest = leaves.agg(F.max("at"), F.max("tree")).first()  # two numbers
    if largest[0] is None:
        kinds = "subroot binary, steps array<struct<left: binary, right: binary>>"
        empty = rows.sparkSession.createDataFrame([], kinds)
        return rows.withColumnRenamed(own, digest).limit(0).join(empty, F.lit(True), "left"), None
    levels = _levels(leaves.select("tree", "at", "digest", "row"), largest[0] + 1, arity)
    subroots = levels[0].roots()
    for level in levels[1:]:
        subroots = subroots.unionByName(level.roots())
    subroots = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest")
    upper = _levels(subroots, largest[1] + 1, arity)
    root = upper[-1].nodes.select(text_of("digest")).first()[0]  # one digest

    start = rows.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("tree"), F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)").alias("steps")
    )
    tops = _paths(upper, start, arity, ["digest"])
    tops = materialize(tops.select(F.col("at").alias("tree"), F.col("digest").alias("subroot"), "steps"), "tops")
    paths = _paths(levels, tops, arity, ["row"])
    return paths.select("row.*", "subroot", "steps").withColumnRenamed(own, digest), root


def proof(steps: Column | str) -> Column:
    """The siblings of all steps one after the other, as text."""
    return F.array_join(F.transform(steps, lambda s: text_of(F.concat(s["left"], s["right"]))), "")


def fold(digest: Column | str, steps: Column | str) -> Column:
    """The root as text that a leaf digest gives with the siblings of its steps."""
    start = text_of(digest)
    return F.aggregate(
        steps, start, lambda node, s: F.sha2(F.concat(text_of(s["left"]), node, text_of(s["right"])), 256)
    )
