"""The registered queries of the numbered operators and the stages of the pipeline."""

import os

import pytest
from llm_helpers import contamination, docs_of, near_duplicates
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from tidemark.llm import quality as Q
from tidemark.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 11))
    assert set(REGISTRY) | {"pipeline"} <= set(driver.queries())


@here
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_covers_its_table(spark, name):
    rows = REGISTRY[name](spark, SMALL)
    key = rows.columns[0]
    table = spark.read.parquet(f"{SMALL}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet")
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())


@here
def test_quality_on_held_out_rows(spark):
    scored = REGISTRY["op10_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


@here
def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = docs
    for (name, stage), before in zip(corpus_pipeline.STAGES, [None, *names]):
        after = stage(spark, kept, SMALL)
        old, new = kept.collect(), after.collect()
        if name == "quality classifier":
            model = Q.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality"))
            good = Q.with_score(docs, model, "s").filter(F.col("s") >= Q.THRESHOLD)
            assert sorted(new) == sorted(good.select(*docs.columns).collect())
        elif name == "MinHash near-dedup":
            found = near_duplicates({r.doc_id: r.text for r in old}, 5)
            assert sorted(r.doc_id for r in new) == sorted(i for i, (_, c) in found.items() if i == c)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            hits = contamination([r.text for r in old], items)
            assert sorted(new) == sorted(r for r, (n, h, _) in zip(old, hits) if not (h and 20 * h >= n))
        elif name == "mixing sources":
            assert set(new) <= set(old) and all(new.count(r) <= 3 for r in set(new))
        else:
            assert sorted(tuple(r)[:-2] for r in new) == sorted(tuple(r) for r in old)
            assert {r.shard for r in new} == set(range(16))
        if name != "sharding":
            assert after.columns == docs.columns
            kept = spark.createDataFrame(new, docs.schema)


def test_stages_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some test item"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [None, "", "word " * 60_000, "same words here again ok", "same words here again ok", "tie"]
    docs = docs_of(spark, texts, ids=[1, None, 3, 4, 5, 5], sources=[None, "a", "a", "b", "b", None])
    docs = docs.withColumns({"shard": F.lit(9), "Slot": F.lit("x"), "_score": F.lit(1), "size": F.lit(2), "copies": F.lit(3), "doc": F.lit("y")})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= 3 * len(texts)
            if name != "sharding":
                assert out.columns == docs.columns
            else:
                assert out.count() == frame.count()
