"""Landed catalogue responses: {status, count, <key>: [...]} as one row each, or as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("lastUpdateTime", T.LongType())])
EPISODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("feedId", T.LongType()), T.StructField("title", T.StringType()), T.StructField("feedTitle", T.StringType()), T.StructField("enclosureUrl", T.StringType())])
#: The key under which each kind of response has its rows.
KEYS = {"feeds": FEED, "items": EPISODE, "episodes": EPISODE}


def schema(key: str) -> T.StructType:
    return T.StructType([T.StructField("count", T.LongType()), T.StructField(key, T.ArrayType(KEYS[key]))])


def decode(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``df`` with the response in ``envelope``; fields that the schema doesn't name are ignored, bad JSON is null."""
    return df.withColumn("envelope", F.from_json(body, schema(key)))


def rows(df: DataFrame, key: str) -> DataFrame:
    """A row per entry, with pos: its place in the response, which is the service's rank."""
    return df.select("*", F.posexplode(f"envelope.{key}").alias("pos", "entry")).select(*[c for c in df.columns if c not in ("envelope", "body")], "pos", "entry.*")


def status(http: str = "http_status", count: str = "envelope.count") -> Column:
    """``http_<code>`` unless 200, ``empty`` with no rows (a missing count is none), else ``ok``."""
    return F.when(F.col(http) != 200, F.concat(F.lit("http_"), F.col(http))).when(F.coalesce(count, F.lit(0)) == 0, "empty").otherwise("ok")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good responses and rejected ones."""
    df = df.withColumn("status", status())
    return df.where("status = 'ok'"), df.where("status <> 'ok'")
