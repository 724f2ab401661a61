"""A training-corpus pipeline of five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, mixing, near_duplicates, quality, shards
from tidemark.llm.text import fresh, table
from tidemark.session import materialize


def _packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that no name can clash with the columns a stage works with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among them."""
    (score,) = fresh(docs, "_score")
    model = quality.train(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.with_score(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Near-duplicates share 0.8 of their five-word shingles.  Rows that repeat an id stay or go together; rows without
    an id stay.
    """
    dropped = near_duplicates.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lies in benchmark windows go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, or up to three times)."""
    rows = _packed(docs).select(
        "doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), mixing.word_count("doc.text").alias("size")
    )
    rows = mixing.mix(rows, "size").filter(F.col("copies") > 0)
    return rows.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot (with a leading underscore where they have such columns already)."""
    shard, slot = fresh(docs, "shard", "slot")
    rows = _packed(docs).select("doc", F.col("doc.doc_id").alias("doc_id"), shards.byte_size("doc.text").alias("size"))
    rows = shards.shard_by_bytes(rows, "size")
    return rows.select("doc.*", F.col("shard").alias(shard), F.col("slot").alias(slot))


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", unlike),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

# A trained classifier decides in the first stage: not a matter of SQL.  tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
