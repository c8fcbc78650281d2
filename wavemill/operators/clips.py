"""Clip requests: validation, names, slices of time-indexed segments, the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals, labels
from .lookup import select_first


def validate(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Requests with url, title (and feed_title, if episodes have it), start_sec, end_sec, status and whether a retry may help.

    Of episodes that repeat an id the first (by pos) counts, so a request stays one row.
    In order: no_url ends the session, bad_interval and not_after may be tried again, too_long ends it, else ok.
    """
    wanted = tuple(c for c in ("enclosure_url", "title", "feed_title") if c in episodes.columns)
    df = intervals.parsed(select_first(requests, episodes, "episode_id", wanted))
    checked = intervals.status(F.col("start_sec"), F.col("end_sec"))
    long = F.col("end_sec") - F.col("start_sec") > intervals.LONGEST
    status = F.when(F.col("enclosure_url").isNull(), "no_url").when(checked != "ok", checked).when(long, "too_long").otherwise("ok")
    outcome = F.when(F.col("status") == "ok", "ok").when(F.col("status").isin("bad_interval", "not_after"), "retryable").otherwise("terminal")
    return df.withColumn("status", status).withColumn("outcome", outcome)


def named(clips: DataFrame, feed_title: str = "feed_title") -> DataFrame:
    parts = F.col(feed_title), F.col("title"), F.col("interval_text")
    return clips.withColumns({"filename": labels.clip_filename(*parts), "clip_title": labels.clip_title(*parts)})


#: Requests and segments of one bucket that meet in one task, about.
DEALT = 4096


def dealt(requests: DataFrame, segments: DataFrame, longest: int = intervals.LONGEST, most: int = DEALT) -> tuple[DataFrame, DataFrame]:
    """Both sides of the interval join with their key: episode_id, b (bucket of ``longest`` seconds), salt and part.

    A bucket with over ``most`` segments is cut into salts by their starts, and a request goes only to salts whose
    segments reach into its span; one with over ``most`` requests has them dealt over parts, to each of which the segments go. So an episode with half of all requests and segments
    is many keys of about that size.
    """
    key = ["episode_id", "b"]
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / longest), F.floor((F.col(hi) - 1) / longest)))
    r = requests.where("start_sec < end_sec").select("request_id", "episode_id", "start_sec", "end_sec", spread("start_sec", "end_sec").alias("b"))
    s = segments.where("seg_start < seg_end").select("episode_id", "turn", "seg_start", "seg_end", spread("seg_start", "seg_end").alias("b"))
    parts = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    busy = parts(r, "parts").join(parts(s, "salts"), key).where("parts > 1 or salts > 1")
    inside = F.greatest(F.col("seg_start"), F.col("b") * longest) - F.col("b") * longest
    s = s.join(busy, key, "left").withColumn("salt", F.coalesce(F.floor(inside * F.col("salts") / longest).cast("int"), F.lit(0)))
    reach = s.where("salts > 1").groupBy(*key, "salt").agg(F.min("seg_start").alias("lo"), F.max("seg_end").alias("hi"))
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts", "salts")
    r = r.join(busy, key, "left").withColumn("part", F.pmod(F.xxhash64("request_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    near = [r[c] == reach[c] for c in key] + [reach["lo"] < r["end_sec"], reach["hi"] > r["start_sec"]]
    r = r.join(reach, near, "left").select(*(r[c] for c in ("request_id", *key, "start_sec", "end_sec", "part")), F.coalesce("salt", F.lit(0)).alias("salt"))
    return r, s


def slices(requests: DataFrame, segments: DataFrame, longest: int = intervals.LONGEST, most: int = DEALT) -> DataFrame:
    """Parts of segments that a request's [start_sec, end_sec) covers, counted from its start.

    Both are dealt to buckets of ``longest`` seconds within an episode, so a long episode isn't one group, and busy buckets are cut further (see dealt); a request
    touches two buckets at most, and a pair that meets in several counts in the first.
    """
    r, s = dealt(requests, segments, longest, most)
    bucket = lambda c: F.floor(F.col(c) / longest)
    pair = r.join(s, ["episode_id", "b", "salt", "part"]).where((F.col("seg_start") < F.col("end_sec")) & (F.col("seg_end") > F.col("start_sec")) & (F.col("b") == F.greatest(bucket("start_sec"), bucket("seg_start"))))
    return pair.select("request_id", "episode_id", "turn", (F.greatest("seg_start", "start_sec") - F.col("start_sec")).alias("from_sec"), (F.least("seg_end", "end_sec") - F.col("start_sec")).alias("to_sec"))


def write_segments(segments: DataFrame, path: str, batch: int, files: int = 8) -> None:
    """Writes a batch of segments in ranges of (episode_id, seg_start), sorted, under ``batch=<number>``.

    A batch that is written again replaces its own part alone, and a read of one episode skips the files and row groups of others by their least and greatest values.
    """
    laid = segments.withColumn("batch", F.lit(batch)).repartitionByRange(files, "episode_id", "seg_start").sortWithinPartitions("episode_id", "seg_start")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_manifest(clips: DataFrame, path: str, batch: int = 0) -> DataFrame:
    """Writes clips by batch and status, in order of their requests, and reads all batches back; a batch that is written again replaces its own part alone."""
    laid = clips.withColumn("batch", F.lit(batch)).repartitionByRange("status", "request_id").sortWithinPartitions("status", "request_id")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(path)
    return clips.sparkSession.read.schema(laid.schema).parquet(path)
