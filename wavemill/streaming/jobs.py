"""Structured Streaming forms: clip requests, trending windows, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from ..operators import clips, sessions
from ..operators.trending import TOP
from ..plans import views


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed update log as a stream; ts as a timestamp, which watermarks need."""
    schema = views.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def clip_requests(requests: DataFrame, episodes: DataFrame, path: str) -> None:
    """Validates a stream of requests against the catalogue; good ones and dead letters go to two folders.

    Each batch is a folder of its own name, written over if the batch is run again, so a restart repeats nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch = clips.validate(batch, episodes).persist()
        for name, rows in (("good", "status = 'ok'"), ("dead", "status <> 'ok'")):
            batch.where(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    requests.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def trending(stream: DataFrame, path: str, window: str = "7 days", slide: str = "1 day", late: str = "1 day", k: int = TOP) -> None:
    """Events per feed in sliding windows of event time, and the ``k`` first feeds of each window; rows later than ``late`` behind the latest one are dropped.

    Each batch writes the counts it updates (``out``) and the table of first feeds (``top``). That is kept up incrementally: counts only
    grow, so only feeds of the last table and feeds of this batch can be in the new one. Every run has the open windows
    in full; those that end before all the stream will take go to ``closed`` once. A batch that is run again writes over its own folders and reads the run
    before, so it gives the same.
    """
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), F.get_json_object("props", "$.k").try_cast("bigint").alias("feed_id")).count()
    out = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feed_id", F.col("count").alias("n"))

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/out/run={number}")
        new = spark.read.schema(batch.schema).parquet(f"{path}/out/run={number}")
        over = F.lit(False)
        if number:
            held = spark.read.schema(batch.schema).parquet(f"{path}/top/run={number - 1}")
            # a batch drops what was late when the one before began; the last run's latest window starts no later than its latest event
            latest = held.agg(F.max("window_start").alias("at")).first().at
            over = over if latest is None else F.col("window_end") <= F.lit(latest) - F.expr(f"interval {late}")
            new = new.union(held)
        best = new.groupBy("window_start", "window_end", "feed_id").agg(F.max("n").alias("n"))
        rank = F.row_number().over(W.partitionBy("window_start", "window_end").orderBy(F.desc("n"), F.asc_nulls_first("feed_id")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank").persist()
        best.where(~over).write.mode("overwrite").parquet(f"{path}/top/run={number}")
        best.where(over).write.mode("overwrite").parquet(f"{path}/closed/run={number}")
        best.unpersist()

    out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def top_feeds(spark: SparkSession, path: str) -> DataFrame:
    """window_start, window_end, rank, feed_id, n of all windows so far; closed ones don't change any more."""
    closed = spark.read.parquet(f"{path}/closed")
    last = closed.agg(F.max("run").alias("run")).first().run
    closed = closed.drop("run")
    seen = closed.union(spark.read.schema(closed.schema).parquet(f"{path}/top/run={last}"))
    rank = F.row_number().over(W.partitionBy("window_start", "window_end").orderBy(F.desc("n"), F.asc_nulls_first("feed_id")))
    return seen.withColumn("rank", rank.cast("bigint"))


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last count of each window and feed."""
    seen = spark.read.parquet(f"{path}/out")
    return seen.groupBy("window_start", "window_end", "feed_id").agg(F.max_by("n", "batch").alias("n"))


class Sessions(StatefulProcessor):
    """A user's session as value state: its step, the steps it reached, finished clips and updates. The ids of finished clips are a list state."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "now int, mask long, done long, n long", self.ttl)
        self.clips = handle.getListState("clips", "update_id long", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        at = initialState.iloc[0]
        self.session.update((sessions.STATES.index(at["final_state"]), int(at["reached"]), int(at["finished"]), int(at["n_updates"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, mask, done, n = self.session.get() if self.session.exists() else (0, 0, 0, 0)
        # frames of a batch come in any order: what is kept of them is an id and a number for each update
        found = [(f["update_id"].to_numpy(), f["symbol"].map(_NUMBER).fillna(-1).to_numpy(np.int8)) for f in rows]
        ids, codes = (np.concatenate(x) for x in zip(*found, strict=True))
        for i in np.argsort(ids, kind="stable"):
            symbol = sessions.SYMBOLS[codes[i]] if codes[i] >= 0 else ""
            to = sessions.next_state(now, symbol)
            if now == sessions.STATES.index("CUT_INTERVAL") and symbol == "interval_ok":
                done += 1
                self.clips.appendValue((int(ids[i]),))
            now, mask, n = to, mask | 1 << to, n + 1
        self.session.update((int(now), int(mask), int(done), int(n)))
        clips = [c[0] for c in self.clips.get()] if self.clips.exists() else []
        yield pd.DataFrame({"user_id": [key[0]], "n_updates": [n], "final_state": [sessions.STATES[now]], "reached": [mask], "finished": [done], "last_clip": [max(clips, default=-1)]})

    def close(self) -> None:
        pass


_NUMBER = {s: i for i, s in enumerate(sessions.SYMBOLS)}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_states(updates: DataFrame, path: str, initial: DataFrame | None = None, ttl: int | None = None) -> None:
    """Each user's session after every batch, by keyed state in RocksDB; updates of a batch are applied in order of update_id.

    ``initial``: rows of sessions.fold, for users whose log up to here was folded in batch. ``ttl``: milliseconds after which the state of a user
    who sends nothing goes. A user's rows of a batch come in frames of Arrow's size and are kept as nine bytes an update, so a batch is bounded by its source's limit of files.
    """
    spark = updates.sparkSession
    kind = "user_id long, n_updates long, final_state string, reached long, finished long, last_clip long"
    rows = updates.select("user_id", "update_id", "symbol").groupBy("user_id")
    out = rows.transformWithStateInPandas(Sessions(ttl), kind, "Update", "ProcessingTime" if ttl else "None", initial.groupBy("user_id") if initial is not None else None)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/run={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each user: n_updates only grows."""
    seen = spark.read.parquet(f"{path}/out").drop("run")
    return seen.groupBy("user_id").agg(F.max(F.struct("n_updates", "final_state", "reached", "finished", "last_clip")).alias("s")).select("user_id", "s.*")
