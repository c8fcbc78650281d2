"""Helpers that keep work spread out: shared intermediate tables, numbering, joins on hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, the warehouse, which is shared too.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_each(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` as a written table with one row of each (not null) key. Rows that repeat a key are taken to be few, so only keys are grouped."""
    table = written(df.withColumn("_row", F.monotonically_increasing_id()), name)
    twins = table.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_row").alias("_least")).where("_n > 1")
    more = written(table.select(*key, "_row").join(twins, key).where("_row <> _least").select("_row"), name + "-twins")
    return table.join(more, "_row", "left_anti").drop("_row")


def numbered(df: DataFrame, group: list[str], key: list[str], out: str, rows: int, per_task: int = 50_000) -> DataFrame:
    """Adds ``out``: gapless numbers from 0 within each group.

    A group is dealt over buckets by the hash of ``key``, so that a group with a third of all
    rows is numbered by many tasks; a bucket's first number is the sum of the buckets before it.
    ``df`` is read twice and should be a written table. Rows that repeat ``key`` count one each.
    """
    buckets = max(16, -(-rows // per_task))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*key))
    return df.withColumn("_rank", inside).join(base, [*group, "_bucket"]).withColumn(out, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_base")


def hot_keys(counts: DataFrame, key: list[str], n: str, total: int, share: int = 500) -> DataFrame:
    """Keys with over 1/``share`` of ``total`` rows, hence fewer than ``share`` of them, and the salts each needs."""
    return counts.where(F.col(n) * share > total).select(*key, F.ceil(F.col(n) * share / F.lit(max(1, total))).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, key: list[str], hot: DataFrame, salt_on: Column, how: str = "inner") -> DataFrame:
    """Joins many left rows to the one right row of their key; hot keys are dealt over salts.

    ``hot`` is bounded (see hot_keys), so it is broadcast to both sides.
    """
    hot = F.broadcast(hot)
    left = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*key, "_salt"], how).drop("_salt")
