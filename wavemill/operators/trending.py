"""Popularity and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how many feeds are shown.
TOP = 10


def topk(events: DataFrame, since: str, until: str, k: int = TOP) -> DataFrame:
    """Feeds with the most events in [since, until); ties by id."""
    inside = (F.col("ts") >= F.to_timestamp_ntz(F.lit(since))) & (F.col("ts") < F.to_timestamp_ntz(F.lit(until)))
    return events.where(inside).groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("feed_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feed_id").limit(k)


def freshest(feeds: DataFrame) -> DataFrame:
    """The feed updated last; nulls are skipped and of ties the first (by pos) wins."""
    order = F.when(F.col("last_update_time").isNotNull(), F.struct("last_update_time", -F.col("pos")))
    return feeds.agg(F.max_by(F.struct("id", "title", "last_update_time"), order).alias("f")).where("f is not null").select("f.*")
