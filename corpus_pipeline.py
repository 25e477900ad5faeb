"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir) with docs reread from Parquet, and returns a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontam, langid, mixing, secrets, simhash
from wardline.llm.common import cut, shared_folder, table
from wardline.llm.queries import secret_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names every text's language from its bytes; rejects texts without any. The named language replaces `lang`.

    Null and empty texts and those without a letter go; very long ones are labelled whole; repeated rows get the
    same language and stay; an empty table, or one without labels to learn from, gives no rows.
    """
    docs = docs.select(*COLUMNS)
    net = langid.fit(docs, F.lit(True))
    named = langid.identify_language(docs, net)
    kept = named.where(F.col("language.label") != "und")
    return kept.withColumn("lang", F.col("language.label")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, null ids last.

    Null and empty texts are near copies of each other; of repeated rows and equal ids one stays; an
    empty table gives no rows.
    """
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the contamination rule, go.

    Null and empty texts have no words and stay; repeated rows are judged alike; an empty benchmark removes nothing.
    """
    found = decontam.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and `n_chars` is counted anew.

    A null text becomes an empty one; very long texts are searched whole; repeated rows change alike; an
    empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    found = secrets.find_secrets(docs, secret_model(docs))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans")))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, its source's target and its first slot.

    A null source is a source; null and empty texts have size 0 and are never taken; repeated rows are
    documents of their own; an empty table gives no rows.
    """
    placed = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))  # numbered once: a scan planned again may be cut otherwise
    taken = mixing.mix_sources(placed, keep=("__row",)).drop("doc_id")
    return placed.join(taken, "__row").drop("__row")


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; what each keeps is written as Parquet in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    shared = shared_folder(spark)
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
