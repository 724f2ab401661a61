"""The registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, scratch_path
from . import decontaminate as D, embeddings as E, language_model as L, mixing, near_duplicates as N, quality as Q, repeats as R
from . import merkle as M, pieces as P, repair as C, secret_scan as S, shards, tokens as T
from .text import table

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def joined_sha256(items: str) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


@query
def op2_decontaminate(spark, d):
    docs, benchmark = table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "benchmark", ["item_id", "text"])
    found = D.find_items(docs, benchmark, "found").drop("text")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        D.hit_words("found").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        joined_sha256("found.items").alias("items_sha256"),
        D.is_contaminated("found").alias("contaminated"),
    )


@query
def op3_shards(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"]).select(
        "doc_id",
        shards.byte_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shards.shard_by_bytes(docs, "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_mix(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "source", "text"])
    docs = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix(docs, "size").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op8_near_duplicates(spark, d):
    return N.near_duplicates(table(spark, d, "documents", ["doc_id", "text"]), shingle=4)


@query
def op5_near_vectors(spark, d):
    return E.near_vectors(table(spark, d, "embeddings", ["vec_id", "embedding", "label"]))


@query
def op10_quality(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"])
    model = Q.train(docs, table(spark, d, "labels", ["doc_id", "quality"]))
    return Q.with_score(docs, model, "score").select(
        "doc_id",
        F.coalesce(Q.remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= Q.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_language_model(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return L.scores(docs, ~L.held_out("doc_id")).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op1_secrets(spark, d):
    found = S.find_secrets(table(spark, d, "documents", ["doc_id", "text"]), "found")
    found = found.select("doc_id", "found")
    base = F.filter("found", lambda x: x["rank"] < 3)
    count = lambda rank: F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("found")).alias("spans"),
    )


@query
def op4_token_files(spark, d):
    path = scratch_path(spark, "tokens")
    T.write_tokens(table(spark, d, "documents", ["doc_id", "text"]), path, public_tokenizers.path("byte_bpe_50k.json"))
    return T.read_tokens(spark, path)


@query
def op7_without_repeats(spark, d):
    return R.without_repeats(table(spark, d, "documents", ["doc_id", "text"]))


@query
def op11_piece_tokens(spark, d):
    model = P.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = P.encode(table(spark, d, "documents", ["doc_id", "text"]), model, ids="ids").drop("text")
    return P.decode(tokens, model, text="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_merkle_manifest(spark, d):
    others = ["doc_id", "source", "lang", "n_chars"]
    docs = table(spark, d, "documents", [*others, "text"])
    turned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(turned & F.contains("text", F.lit("\n")), M.leaf(*others, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", M.leaf(*others, "text").alias("leaf"), changed.alias("changed"))
    rows, root = M.manifest(materialize(leaves, "leaves"), "leaf")
    folded = M.fold(F.coalesce("changed", "leaf"), "steps")
    return rows.select(
        "doc_id",
        M.text_of("leaf").alias("leaf"),
        M.text_of("subroot").alias("subroot"),
        F.lit(root).alias("root"),
        F.sha2(M.proof("steps"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(root)).alias("verified"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults put in where a checksum of conversation and turn says so; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("kind > 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


@query
def op12_repair_conversations(spark, d):
    conversations = table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    found = materialize(C.with_faults(damaged(conversations), "conv_id", order), "faults")
    runs = C.runs_of(found)
    edits = C.find_edits(runs)
    hashes = C.line_hashes(C.apply_edits(found, edits))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    summary = found.groupBy("conv").agg(
        F.first("conv_id").alias("_conv_id"),
        F.coalesce(spread, F.lit(0)).alias("gaps"),
        *[count(fault) for fault in ("blank", "duplicate", "truncated")],
    )
    for part in (C.illegal_pairs(runs), C.audits(edits), hashes):
        summary = summary.join(part, "conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = conversations.select("conv_id").distinct()
    return rows.join(summary, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        "conv_id",
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
