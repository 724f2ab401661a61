"""Near duplicates, vectors, sharding, mixing, token files, classifier: against brute force and on edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import components, docs_of, near_duplicates, space_words, stored
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import coder, embeddings as E, mixing, near_duplicates as N, quality as Q, shards, tokens as T
from tidemark.llm.components import connected_components
from tidemark.llm.text import id_filter, passing
from tidemark.session import settings


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    links = [(a, b) for a, b in links if a != b]
    expected = components({x for pair in links for x in pair}, links)
    assert got == expected
    assert connected_components(df.limit(0), "a", "b").count() == 0


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(8)
    texts = [None, "", " ", "one two", "ONE  two", "one two three"]
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 150))]
        texts += [edited(rng, base, k) for k in (0, 0, 1, 2, 3, 5, 8, 12) for _ in range(2)]
    rng.shuffle(texts)
    docs = docs_of(spark, texts).withColumn("digest", F.lit("clash"))
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, shingle=4).collect()}
    assert rows == near_duplicates(dict(enumerate(texts)), 4)


@pytest.mark.parametrize("bytes_", [1 << 23, 4000])
def test_near_duplicates_alike_but_unlinked(spark, monkeypatch, bytes_):
    """A group of texts that are alike at 0.7 to 0.8: many pairs by the sketch, few links, no row for any other pair."""
    monkeypatch.setattr(N, "BLOCK_BYTES", bytes_)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [edited(rng, base, rng.choice([2, 3, 4])) for _ in range(60)] + [edited(rng, base, 1), "other words here then", None]
    docs = docs_of(spark, texts)
    signed = N.signatures(docs, "doc_id", "text", 4).filter("n_shingles > 0").withColumn("component", F.col("id"))
    members = signed.select(F.explode("bands").alias("bucket"), "id", "component")
    sizes = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    most = N.most_differing_bits(0.8 - N.MARGIN)
    links = N._remaining_links(members.join(sizes, "bucket"), signed, docs, "doc_id", "text", 4, most, 80).collect()
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in enumerate(texts) if t for w in [t.split()]}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    linked = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    near = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])]
    assert len(near) > 3 * max(1, len(linked))
    assert {tuple(sorted(x)) for x in links} <= set(linked)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, shingle=4).collect()}
    assert rows == near_duplicates(dict(enumerate(texts)), 4)


def test_near_duplicates_edges(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "x", "x", None], ids=[4, 4, None, None, None, 9])
    rows = [(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()]
    assert sorted(rows, key=str) == sorted(
        [(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (None, None, True), (9, 9, True)], key=str
    )
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.6, 0.8, 0.9):
        common = rng.integers(0, 2**63, 2000).astype(np.uint64)
        own = int(2000 * (1 - share) / share / 2)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 2**63, own).astype(np.uint64)))) for _ in range(2)]
        a, b = (N.odd_sketch(N.minhash(s)) for s in sets)
        differing = int(np.bitwise_count(N.unsigned([a ^ b])).sum())
        assert N.most_differing_bits(share + 0.15) < differing < N.most_differing_bits(share - 0.15)


def vectors(rng):
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for k in range(rng.integers(1, 6)):
                rows.append((n, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2])).tolist(), label))
                n += 1
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0] * 3, [1e-200] * 16, [1e200] * 16]
    return rows + [(n + i, v, 0) for i, v in enumerate(bad)]


@pytest.mark.parametrize("block", [512, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = [
        (i, np.array(v) / np.abs(v).max(), label)
        for i, v, label in rows
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = [
        (a, b)
        for a, x, p in usable
        for b, y, q in usable
        if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    ]
    found = components([r[0] for r in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert len(links) > 20
    assert got == {i: (sum(i in p for p in links), c, i == c) for i, c in found.items()}


def test_vectors_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect())
    assert rows == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, True)]
    assert E.near_vectors(df.limit(0)).count() == 0


def test_hash_shape_keeps_recall():
    for rows in (10, 10**5, 10**8, 10**10):
        tables, bits = E.hash_shape(rows)
        together = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - together) ** tables <= 1.01e-4


def test_shards_are_contiguous_and_even(spark):
    rng = random.Random(3)
    texts = [None, "", *["x" * rng.randrange(300) for _ in range(300)]]
    docs = docs_of(spark, texts, ids=[None, None, *[rng.randrange(200) for _ in range(300)]])
    rows = shards.shard_by_bytes(docs.withColumn("size", shards.byte_size()).withColumn("_row", F.lit(1)), "size", 7).collect()
    assert len(rows) == len(texts) and {r["_row"] for r in rows} == {1}
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    totals = [0] * 7
    for shard in range(7):
        assert [r.slot for r in order if r.shard == shard] == list(range(sum(r.shard == shard for r in order)))
        totals[shard] = sum(r.size for r in order if r.shard == shard)
    assert max(totals) - min(totals) <= 2 * 301
    assert shards.shard_by_bytes(docs.limit(0).withColumn("size", shards.byte_size()), "size").count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1)
        above = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not above:
            return {**capped, **{s: level * weight[s] for s in free}}
        capped |= {s: most * sizes[s] for s in above}


def test_clashing_names(spark):
    """Columns with any names pass through; those named like a result are refused."""
    docs = docs_of(spark, ["a b c", "d e", None], sources=["s", None, "s"]).withColumn("size", mixing.word_count())
    names = ["_source", "_first", "_rows", "_row", "first", "rows", "of_source", "key", "doc", "a.b"]
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for found, added in (
        (mixing.mix(docs, "size"), ["source_size", "target", "copies"]),
        (shards.shard_by_bytes(docs, "size", 2), ["shard", "slot"]),
    ):
        assert found.columns == [*docs.columns, *added]
        rows = found.collect()
        assert len(rows) == 3 and all(r[n] == n for r in rows for n in names)
    for name in ("Target", "copies", "source_size"):
        with pytest.raises(ValueError):
            mixing.mix(docs.withColumn(name, F.lit(1)), "size")
    for name in ("shard", "Slot"):
        with pytest.raises(ValueError):
            shards.shard_by_bytes(docs.withColumn(name, F.lit(1)), "size")


def test_shard_query_columns(spark, tmp_path):
    """op3's checksums, law and slots, against zlib and plain sums."""
    import zlib

    from tidemark.llm.queries import REGISTRY

    texts = ["é" * 50, "", None, "a b", "a b"] + ["x" * (i * 7 % 90) for i in range(60)]
    stored(docs_of(spark, texts), tmp_path)
    rows = REGISTRY["op3_shards"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    sizes = [0] * 16
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r.shard] += r.size
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_mix(spark):
    rng = random.Random(6)
    names = ["b", None, "a", "Z", "é", "empty"]
    texts = [None, "", *[" ".join(["w"] * rng.randrange(60)) for _ in range(600)]]
    sources = ["empty", "empty", *[rng.choices(names[:5], [300, 40, 3, 100, 20])[0] for _ in range(600)]]
    docs = docs_of(spark, texts, sources=sources).withColumn("size", mixing.word_count())
    rows = mixing.mix(docs, "size").collect()
    sizes = {s: sum(r.size for r in rows if r.source == s) for s in set(sources)}
    assert all(r.size == len(space_words(r.text)) for r in rows)
    wanted = targets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - wanted[source]) < 1e-6 for r in own) and all(0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - wanted[source]) <= 60
    again = mixing.mix(docs.repartition(5), "size").collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mix(docs.limit(0), "size").count() == 0


def test_rows_are_placed_without_python(spark, monkeypatch):
    """Texts neither pass through Python nor move a second time while rows are mixed or put into shards."""
    texts = ["x" * (i * 37 % 400) + " w" * (i % 9) for i in range(300)]
    docs = docs_of(spark, texts, sources=["ab"[i % 2] for i in range(300)]).withColumn("size", mixing.word_count())
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *_: pytest.fail("rows pass through Python"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "20k"}):
        mixed = mixing.mix(docs, "size")
        assert "SortMergeJoin" not in mixed._jdf.queryExecution().toString()
        assert mixed.count() == 300
        assert shards.shard_by_bytes(docs, "size", 7).count() == 300


def test_null_sizes_count_as_nothing(spark):
    docs = docs_of(spark, ["a"] * 40).withColumn("size", F.when(F.col("doc_id") % 4 != 0, 10))
    rows = sorted(shards.shard_by_bytes(docs, "size", 3).collect(), key=lambda r: r.doc_id)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert [sum(r.size or 0 for r in rows if r.shard == s) for s in range(3)] == [100, 100, 100]


@pytest.mark.parametrize("n", [0, 1, 2, 300, 20_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.integers(0, 3, n), np.full(n, 65_537), np.repeat(rng.integers(0, 900, n // 5 + 1), 5)[:n]):
        data = coder.write_block([3, None], [n, 0], ids)
        keys, lengths, back = coder.read_block(data)
        assert keys == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    if n == 20_000:
        assert len(coder.write_block([1], [n], np.repeat(rng.integers(0, 900, n // 5 + 1), 5)[:n])) < 2 * n
        for at in (9, len(data) // 2, len(data) - 1):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                coder.read_block(bytes(broken))


def test_tokenizer_is_kept_within_bounds(monkeypatch):
    """One tokenizer serves all tasks of a process; its cache is dropped by number and by bytes, ids stay the same."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path) as file:
        definition = file.read()
    encoder = T.tokenizer_of(definition)
    assert T.tokenizer_of(str(definition)) is encoder
    monkeypatch.setattr(T, "CACHED_BYTES", 5000)
    for k in range(30):
        text = f"some words {k} and " + "x" * (k * 100) + " end "
        assert encoder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert sum(len(p) + len(i) for p, i in encoder.pieces.items()) == encoder.held <= 5000 + 4 * len(text) + 4 * 3000


def test_words_are_encoded_once(monkeypatch):
    """Ids equal the library's on odd texts; a word that has been met costs nothing, whatever stands around it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path) as file:
        encoder = T.PieceTokenizer(file.read())
    rng = random.Random(4)
    parts = ["a", "Be", "éß", "×", "'", "'s", "'ll", "'S", "'re", " ", "  ", "\n", "\n\n", "\t", "\r", "!", "?!", "<", "|", "12", "²", "日", "\xa0", "\x0b", "\0"]
    texts = ["".join(rng.choices(parts if k % 2 else parts[:3] + parts[4:20], k=k % 30)) for k in range(4000)]
    texts += ["", "<|endoftext|>", "x <|endoftext|> y", "'s", "don't they've", "it''s 's", "word " * 3000, "x" * 5000, " ", "\n"]
    for slice_bytes in (100, 1 << 22):
        monkeypatch.setattr(T, "SLICE", slice_bytes)
        found = encoder.ids_of(pa.array(texts))
        assert [ids.tolist() for ids in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    encoded = []
    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda text, *more: (encoded.append(text), plain(text, *more))[1])
    words = ["alpha", "beta", "gamma", "delta"]
    met = [f" {a}{mark} {b}" for a in words for b in words for mark in (",", ".", "!", "")]
    first = list(encoder.ids_of(pa.array([" ".join(["", *words]) + ", x. y! z"])))
    encoded.clear()
    assert len(first) == 1 and len(list(encoder.ids_of(pa.array(met)))) == len(met) and encoded == []


def test_blocks_stay_small():
    """Ids that follow from those before cost little, others what their frequencies say."""
    rng = np.random.default_rng(5)
    n = 1 << 18
    often = np.minimum(rng.geometric(0.02, n), 40_000)
    shares = np.bincount(often) / n
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    assert 8 * len(coder.write_block([1], [n], often)) < 1.15 * n * entropy
    chain = (np.arange(n) * 7919 % 3001) + 1  # each id follows from the last
    assert len(coder.write_block([1], [n], chain)) < 0.25 * n


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", " ", "a  b\n\n c ", "don't stop  ", "x<|endoftext|> y", "ünï cödé 𝄞 日本", "\ttab  nbsp em", "word " * 3000]
    docs = docs_of(spark, texts, ids=[5, 3, 9, None, 1, 2, 8, 3, 7])
    for block in (1, 1 << 19):
        out = str(tmp_path / f"tokens-{block}")
        T.write_tokens(docs, out, path, block_ids=block)
        rows = sorted(T.read_tokens(spark, out, with_ids=True).collect(), key=lambda r: r.start)
        start = 0
        assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 5, 7, 8, 9]
        expected = sorted(library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts)
        assert sorted(r.ids for r in rows) == expected
        for r in rows:
            assert (r.start, r.n_tokens) == (start, len(r.ids))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            start += len(r.ids)
    T.write_tokens(docs.limit(0), str(tmp_path / "none"), path)
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    assert Q.fit(np.empty((0, 6)), np.empty(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert (Q.fit(x[:50], np.ones(50)).score(x) > 0.9).all()


def test_quality_edges(spark):
    docs = docs_of(spark, [None, "", "word " * 100_000, "ok"], ids=[1, 1, None, 2]).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    model = Q.train(docs.select("doc_id", "text"), labels)
    rows = Q.with_score(docs, model, "score").collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert Q.train(docs.limit(0).select("doc_id", "text"), labels.limit(0)).base == 0.0
    assert Q.with_score(docs.limit(0), model, "score").count() == 0


def test_texts_are_filtered_where_they_are_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(None, "x"), (7, "again"), (9, None)], "name long, body string")
    ids = spark.createDataFrame([(7,), (9,), (300,), (5000,)], "id long")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = N._texts_of(docs, ids, "name", "body")
        assert sorted(map(str, found.collect())) == sorted(
            map(str, docs.filter("name IN (7, 9, 300)").toDF("id", "text").collect())
        )
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("Exchange") < plan.index("MapInArrow")  # before the shuffle: lower in the plan
    assert passing(docs, "name", id_filter(ids, "id")).count() < 20
