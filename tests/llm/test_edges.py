"""Very long texts, empty tables and clashing names, operator by operator."""

import random

import pytest
from llm_helpers import docs_of, stored
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D, embeddings as E, language_model as L, near_duplicates as N, quality as Q, repeats as R
from tidemark.llm import secret_scan as S


@pytest.fixture(scope="module")
def long_words():
    rng = random.Random(4)
    return [f"w{rng.randrange(10**5)}" for _ in range(150_000)]


def test_a_very_long_text_is_searched_to_its_end(spark, long_words):
    item = "the question that is asked here has more than thirteen words so that it is one"
    docs = docs_of(spark, [" ".join([*long_words, item]), " ".join(long_words), None])
    docs = docs.withColumn("_item", F.lit("clash")).withColumn("items", F.lit(1))
    benchmark = spark.createDataFrame([("a", item), ("b", None), ("c", "")], "item_id string, text string")
    rows = {r.doc_id: r for r in D.find_items(docs, benchmark, "found").collect()}
    assert rows[0].found.items == ["a"] and rows[0].found.n_words == len(long_words) + len(item.split())
    assert not rows[1].found.items and rows[1]["_item"] == "clash" and rows[1]["items"] == 1
    assert rows[2].found.n_words == 0
    assert D.find_items(docs.limit(0), benchmark, "found").count() == 0
    none = D.find_items(docs, benchmark.limit(0), "found").collect()
    assert len(none) == 3 and not any(r.found.items for r in none)


def test_very_long_near_copies(spark, long_words):
    near = list(long_words)
    near[1000] = near[140_000] = "changed"
    other = long_words[:60_000] + [f"o{i}" for i in range(90_000)]
    docs = docs_of(spark, [" ".join(long_words), " ".join(near), " ".join(other), ""])
    docs = docs.withColumn("bands", F.lit(1)).withColumn("component_id", F.lit("clash"))
    rows = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 3}


def test_a_very_long_text_is_scored_whole(spark, long_words, tmp_path):
    docs = docs_of(spark, [" ".join(long_words), " ".join(long_words[:1000]), None]).withColumn("block", F.lit("clash"))
    rows = {r.doc_id: r for r in L.scores(stored(docs, tmp_path), F.lit(True), block_tokens=5000).collect()}
    assert rows[0].n_tokens == len(long_words) + 1 == rows[0].n_known and rows[0].train_tokens == len(long_words) + 1003
    assert rows[0].score > rows[0].base_score and rows[2].n_tokens == 1


def test_a_repeat_in_a_very_long_text(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    twice = text[:500]
    docs = docs_of(spark, [text + twice, "x" * 399, None]).withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    rows = {r.doc_id: r for r in R.without_repeats(stored(docs, tmp_path)).collect()}
    assert (rows[0].n_bytes, rows[0].n_removed, rows[0].n_spans) == (400_500, 1000, 2)
    assert rows[1].n_removed == rows[2].n_removed == 0


def test_a_very_long_text_is_scanned_for_secrets(spark):
    docs = docs_of(spark, ["word " * 100_000 + "token=abcdefghij"]).withColumn("found_", F.lit(1))
    (row,) = S.find_secrets(docs, "found").collect()
    assert [(s.kind, s.start) for s in row.found] == [("assign", 500_000)]


def test_vectors_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.withColumn("id", F.lit("clash")).withColumn("bucket", F.lit(1))
    assert sorted((r.vec_id, r.component_id) for r in E.near_vectors(frame).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert E.near_vectors(frame.limit(0)).count() == 0


def test_no_labels(spark):
    """Nothing to learn from: every text gets the same score."""
    docs = docs_of(spark, ["a b c", None, "d " * 1000])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert len({r.score for r in Q.with_score(docs, model, "score").collect()}) == 1
