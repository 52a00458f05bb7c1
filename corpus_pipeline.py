"""The training-corpus pipeline: documents in, encoded documents out, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``docs``. Learned parts (the quality model) use the labels in sf_dir and the
texts of the stage's own input; folds held out by the operator's query are held out here too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawser.llm import bagminhash, bpe, mixing, pii, quality_classifier
from hawser.llm.io import durable, fold, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; null and empty texts go as the model scores them."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    names = docs.columns
    scored = quality_classifier.score(docs, model, {c: F.col(f"`{c}`") for c in names}, "__quality")
    return scored.where(F.col("__quality") >= 0.5).select(*[F.col(f"`{c}`") for c in names])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, that of the smallest doc_id. Rows without doc_id, and texts without a word,
    stay; rows that repeat doc_id and text go."""
    return bagminhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; null texts stay null, n_chars follows the text."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row for each turn of a document. Texts that are null or without a word have no turn;
    null source is a source of its own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document of the mix, and the digests of its text and of the bytes that
    the ids decode to, which are equal. Null text counts as empty, with no ids."""
    ranks = bpe.load_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source")} | {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    return bpe.round_trip(docs, keep, ranks, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("dedup", dedup), ("pii", redact), ("mix", mix), ("encode", encode)]

#: No stage is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
