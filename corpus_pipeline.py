"""The corpus pipeline: documents to packed training sequences, a stage at a time.

Each stage reads all that the one before kept and returns the columns of documents; the last one returns
the pieces of packed sequences. SQL can't express the stages (trees, MinHash, latent search, checksums,
a tokenizer), so tests hold them against brute force on small tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import decontam, neardup, packing, pii, quality
from wavemill.llm._spread import written

ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in ``_doc``, so that no column of an operator meets one of the documents."""
    return docs.select("doc_id", "text", F.struct("*").alias("_doc"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them.

    Each row is judged alone, so rows that repeat stay or go together and very long texts are rows like any other. An empty
    table gives an empty one; columns pass whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(_apart(docs), quality.fit(docs, labels)).where("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of those with the least doc_id (null after all others).

    Rows are told apart by numbers of their own: rows that repeat, or share a doc_id or have none, are members like others.
    Null and empty texts are linked with nothing and stay, as very long ones without a copy do. An empty table gives an
    empty one; columns pass whatever their names.
    """
    rows = written(docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_row")), "rows")
    groups = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))).select(F.col("doc_id").alias("_row"), "component_id")
    groups = written(groups.join(rows.select("_row", "_id"), "_row"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"].alias("_row"))
    gone = groups.select("_row").join(first, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; each row is searched alone and whole, so rows that repeat stay or go together. An
    empty table gives an empty one, an empty benchmark removes nothing; columns pass whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_leaks(_apart(docs), decontam.fit(docs, items)).where(F.size("leaks") == 0).select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become ``<KIND>``; n_chars follows the text.

    Every row stays. Null texts stay null (so does their n_chars), empty ones empty; very long texts are read whole. Rows that
    repeat are changed alike; an empty table gives an empty one; other columns pass whatever their names.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequence and offset: see packing.pack_documents.

    Null and empty texts are one end mark; very long texts are cut into pieces; rows that repeat each take a place; an
    empty table gives an empty one; columns besides doc_id and text don't pass.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
