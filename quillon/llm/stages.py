"""The stages of the corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on every row it gets, and returns the columns of docs as they were, whatever
their names, but for the last, which returns digests of the token ids. Between stages results are Parquet tables, of which
run() keeps the last one only. Empty docs give no rows in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, langid, linededup, neardup
from quillon.llm.common import discard, read, stored, tuned

#: Documents whose leading language has less of the text than this are rejected with those without letters.
LEAST_SHARE = 0.5


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """docs as text, the columns `apart`, and all others in one struct, so that no name can clash with a result's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), "text", *apart)


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*("text" if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose leading language has LEAST_SHARE of the text or more. Null, empty and letterless texts go, and
    all go if no row has a label. Repeated rows fare alike."""
    tuned(spark)
    found = langid.identify(_packed(docs), langid.learn(docs))
    return _unpacked(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the lines that a document of smaller doc_id holds; n_chars is set anew. Null text stays
    null; a null doc_id counts as the largest; equal rows lose equal lines."""
    tuned(spark)
    kept = linededup.apply_bitmaps(linededup.with_bitmaps(_packed(docs, "doc_id"), linededup.keep_bitmaps(docs)))
    kept = _unpacked(kept, docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id, one with an id before those without.
    Of texts without words (null counts as empty) one of each equal text stays."""
    tuned(spark)
    return neardup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none. Repeated rows fare alike."""
    found = decontam.contamination(_packed(docs), read(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("spans") == 0), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and lossless of each document; null text has no ids."""
    tuned(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: The language model's choice and the similarity of texts have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
