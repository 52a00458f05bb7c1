"""The thin queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, hnsw, language_id, mixing, pii, quality_classifier, quality_rules, toxicity, warc
from .io import fold, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 4) == 2
    grammar = toxicity.fit(docs, labels, ~held)
    out = toxicity.score(docs, grammar, {"doc_id": F.col("doc_id")})
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    out = language_id.predict(docs, language_id.fit(docs, ~held), {"doc_id": F.col("doc_id")})
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/hawser/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}, ranks, public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels, ~held), {"doc_id": F.col("doc_id")})
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: The 32 letters of base32, and SHA-1 in it: eight groups of five hex digits, four letters each.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(
    f"substr('{_BASE32}', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::INT // {32 ** (3 - k)}) % 32), 1)" for g in range(8) for k in range(4)
)


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
            d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
            f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM d)
            SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
                   CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
            FROM f""",
    }
