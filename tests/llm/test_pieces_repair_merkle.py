"""SentencePiece coding, conversation repair, Merkle manifests: against libraries, brute force and on edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import merkle as M, pieces as P, repair as C
from tidemark.llm.queries import damaged

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# -- pieces --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return P.read_model(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    letters = " ▁abcdetionrsIN\n\t\0Éé😀<>0x19,.'\"ﬁ中文梦ңह्"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


TEXTS = [
    None, "", " ", "  a  b ", "a▁b", "\n\n x", "<s></s><unk><0x41> hello", "﻿\U0010ffff", " " * 100, "a" * 1000, "0123 4567,,..!!",
    "internationalisation " * 3000, "x" * 60_000, "word\n" * 2000,
]


def test_pieces_equal_the_library(spark, model, library):
    texts = [*TEXTS, *random_texts(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    tokens = P.encode(docs, model, ids="codes")
    assert tokens.columns == ["doc_id", "text", "tokens", "codes"]
    rows = P.decode(tokens.withColumnRenamed("text", "given"), model, ids="codes").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for row in rows:
        ids = library.encode(row.given or "", add_bos=True, add_eos=True)
        assert np.frombuffer(row.codes, "<u4").tolist() == ids
        assert row.text == library.decode(ids)
    unmarked = P.encode(docs.limit(5), model, ids="codes", marks=False).collect()
    assert bytes(unmarked[0].codes) == b"" or unmarked[0].text
    assert P.encode(docs.limit(0), model, ids="codes").count() == 0
    with pytest.raises(ValueError):
        P.encode(docs, model, ids="Text")
    with pytest.raises(ValueError):
        P.decode(tokens, model, ids="codes")


def test_decoding_any_ids(model, library):
    rnd = random.Random(2)
    decoder = P.Decoder(model)
    kinds = [(0, 3), (3, 259), (130, 259), (259, 32_000), (28_705, 28_706), (259, 262)]
    for _ in range(3000):
        ids = [rnd.randrange(*rnd.choice(kinds)) for _ in range(rnd.randint(0, 9))]
        assert decoder.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_caches_that_overflow_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 5)
    monkeypatch.setattr(P, "CACHED_PAIRS", 7)
    encoder = P.WordIds(model)
    for text in random_texts(200, 3):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text)


def test_null_ids_and_unfit_models(spark, model, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as schema

    frame = spark.createDataFrame([(None,), (bytearray(b""),)], "ids binary")
    assert {r.text for r in P.decode(frame, model).collect()} == {None, ""}
    with open(MODEL, "rb") as f:
        other = schema.ModelProto.FromString(f.read())
    other.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(other.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        P.read_model(str(path))


# -- repair --------------------------------------------------------------------------------------------------


def cheapest(codes):
    """(cost, letters): exact costs backwards, then the first letter that keeps to them."""
    n, far = len(codes), 10**9
    moves = {}

    def consuming(i, q):
        initial, fault = codes[i][0], codes[i][1]
        cut = int(fault == "t")
        out = [("D", 3, q)]
        if fault != "b":
            follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q].get(initial)
            out += [("K", cut, follows)] if follows is not None else []
            out += [("R", 2 + cut, 3 if q == 2 else 2)]
        return out

    costs = [[far] * 4 for _ in range(n + 1)]
    costs[n][0] = costs[n][3] = 0
    for i in range(n, -1, -1):
        for q in range(4):
            moves[i, q] = [(a, c, i + 1, to) for a, c, to in consuming(i, q)] if i < n else []
            costs[i][q] = min([costs[i][q], *(c + costs[j][to] for _, c, j, to in moves[i, q])])
        for _ in range(4):
            for q in range(4):
                costs[i][q] = min(costs[i][q], 2 + costs[i][3 if q == 2 else 2])
    i = q = 0
    letters, left = "", costs[0][0]
    while not (i == n and q in (0, 3)):
        options = sorted([*moves[i, q], ("I", 2, i, 3 if q == 2 else 2)])
        letter, cost, i, q = next(o for o in options if o[1] + costs[o[2]][o[3]] == left)
        letters, left = letters + letter, left - cost
    return costs[0][0], letters


def random_codes(rnd, n):
    plain = ["u" if i % 2 == 0 else "a" for i in range(n)]
    return [(rnd.choice("sua?") if rnd.random() < 0.3 else r) + rnd.choice("-----bt") for r in plain]


def test_search_is_cheapest_and_first():
    rnd = random.Random(3)
    for _ in range(1500):
        codes = random_codes(rnd, rnd.randint(0, 12))
        cost, letters, _ = C.Search(codes).best(C.START)
        assert (cost, letters) == cheapest(codes), codes
    for codes in (["u-"] * 256, ["?-"] * 256, ["ab"] * 256, ["u-", "a-", "a-", "u-"] * 64, random_codes(rnd, 256)):
        assert C.Search(codes).best(C.START)[:2] == cheapest(codes)


SHOWN = [c for c in map(chr, range(128)) if c not in " \t\n\v\f\r"]


def repaired(rows):
    """The answer for (turn, role, text) rows in order."""
    blank = duplicate = truncated = illegal = 0
    codes, seen = [], set()
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        fault = "-"
        if not shown:
            blank, fault = blank + 1, "b"
        elif (role, text) in seen:
            duplicate, fault = duplicate + 1, "b"
        elif shown[-1] not in ".!?":
            truncated, fault = truncated + 1, "t"
        seen.add((role, text))
        codes.append((role[:1] or "?") + fault)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, letters = cheapest(codes)
    lines, at, state = [], 0, 0
    for letter in letters:
        if letter != "D":
            role = "assistant" if state == 2 else "user"
            if letter == "K":
                role = rows[at][1]
            lines.append(f"{role}:" if letter == "I" else f"{role}:{rows[at][2]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        at += letter != "I"
    return gaps, blank, duplicate, truncated, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rnd, n):
    texts = ["Yes.", "no", "", " \t\n", "What?", "ok! ", "é…", "end.\u0085", "end.\n", "x" * 30_000 + "."]
    for conv in range(n):
        turns = [t for t in range(rnd.randint(1, 14)) if rnd.random() < 0.9]
        for turn in turns:
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", "u"])
            yield (conv, turn, role, rnd.choice(texts))
    yield from [(None, None, "user", "no"), (None, 7, "assistant", "Yes."), (None, 7, "assistant", "Yes.")]


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_repair(spark, segment):
    rows = list(conversations(random.Random(5), 60))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    found, edits, out = C.repair(frame, "conv_id", order, segment)
    names = {r.conv: r.conv_id for r in found.select("conv", "conv_id").distinct().collect()}
    expected = {}
    for conv in names.values():
        own = [r[1:] for r in rows if r[0] == conv]
        expected[conv] = repaired(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())))
    audits = {names[r.conv]: (r.cost, r.audit) for r in C.audits(edits).collect()}
    hashes = {names[r.conv]: r.sha256 for r in C.line_hashes(out).collect()}
    for conv, row in expected.items():
        assert audits[conv] == row[5:7]
        assert hashes.get(conv, hashlib.sha256(b"").hexdigest()) == row[7]
    illegal = {names[r.conv]: r.illegal for r in C.illegal_pairs(C.runs_of(found, segment)).collect()}
    assert illegal == {conv: row[4] for conv, row in expected.items()}


def test_repair_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, edits, out = C.repair(frame, "conv_id", [F.col("turn").asc_nulls_first()])
    assert found.count() == C.audits(edits).count() == C.line_hashes(out).count() == 0
    with pytest.raises(ValueError):
        C.with_faults(frame.withColumn("Fault", F.lit(1)), "conv_id", [F.col("turn")])


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(60)) for r, x in [("user", "A. b!"), (None, None)]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    expected = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text)
        expected += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, damaged(frame).collect()))) == sorted(map(str, expected))


# -- Merkle --------------------------------------------------------------------------------------------------


def digest_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """(root, steps of each leaf)."""
    steps, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(level) > 1:
        parents, owned = [], []
        for begin in range(0, len(level), arity):
            run = level[begin : begin + arity]
            for j in range(len(run)):
                for leaf in owners[begin + j]:
                    steps[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(digest_of(*run))
            owned.append(sum(owners[begin : begin + arity], []))
        level, owners = parents, owned
    return level[0], steps


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, arity):
    rnd = random.Random(arity)
    sources = ["a"] * 60 + ["é", "ﬁ", "𝄞", None, None, "", "b", "b", "b", "b"]
    rows = [(rnd.choice([None, *range(50)]), s, rnd.choice([None, "", "é\nx"]), i) for i, s in enumerate(sources)]
    rows += rows[:3]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, Digest int").repartition(7)
    leaves = frame.withColumn("mark", M.leaf("doc_id", "source", "text", "Digest"))
    found, root = M.manifest(leaves, "mark", arity=arity)
    assert found.columns == ["doc_id", "source", "text", "Digest", "mark", "subroot", "steps"]

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], digest_of(*map(field, row))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = [*tree([d for _, d in own], arity), [d for _, d in own]]
    top, above = tree([trees[s][0] for s in names], arity)
    assert root == top
    expected = sorted(
        (leaf, trees[s][0], str([*steps, *above[names.index(s)]]))
        for s in names
        for leaf, steps in zip(trees[s][2], trees[s][1])
    )
    got = found.select(
        M.text_of("mark").alias("leaf"), M.text_of("subroot").alias("subroot"), "steps", M.proof("steps").alias("proof"),
        M.fold("mark", "steps").alias("whole"), M.fold(M.leaf(F.lit("other")), "steps").alias("other"),
    ).collect()
    assert sorted((r.leaf, r.subroot, str([(s.left.hex(), s.right.hex()) for s in r.steps])) for r in got) == expected
    for r in got:
        assert r.whole == root and r.other != root
        assert r.proof == "".join(s.left.hex() + s.right.hex() for s in r.steps)


def test_manifest_of_little(spark):
    frame = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    leaves = frame.withColumn("leaf", M.leaf("doc_id", "source", "text"))
    found, root = M.manifest(leaves, "leaf")
    row = found.select(M.text_of("leaf").alias("leaf"), M.text_of("subroot").alias("subroot"), "steps").first()
    assert row.leaf == row.subroot == root and row.steps == []
    found, root = M.manifest(leaves.limit(0), "leaf")
    assert root is None and found.count() == 0 and found.columns[-2:] == ["subroot", "steps"]
    with pytest.raises(ValueError):
        M.manifest(leaves.withColumn("Steps", F.lit(1)), "leaf")
    with pytest.raises(ValueError):
        M.manifest(leaves, "leaf", arity=1)
