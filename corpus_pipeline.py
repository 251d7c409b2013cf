"""A training corpus from raw documents: named stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, the last one the encoded corpus.
``run`` writes and rereads each stage, so a lost executor repeats a part of one stage only. An empty table gives an
empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.llm import bpe, line_templates, mixing, quality_rules, simhash
from rareflow.session import stage_table

TOKENIZER = "word_bpe_49k.json"


def with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects; null and empty texts go, repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents.

    A document of which nothing is left repeats others in every line, and goes. The first document (smallest id,
    null ids last) keeps a recurring line; rows equal in id and text are one document; a null text stays null.
    """
    cleaned = line_templates.drop_recurring(docs)
    left = ~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kept = cleaned.filter(F.coalesce(left, F.lit(True))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return with_lengths(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: the smallest id, null ids last.

    Texts without a word are alike; of rows equal in id and text one stays.
    """
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes, with the words it takes.

    Null and empty texts are never taken; null sources are a source; repeated rows are documents of their own.
    """
    return with_lengths(mixing.mixed_documents(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per row; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", encoding),
]

#: The stages hash, cluster and encode beyond what SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
