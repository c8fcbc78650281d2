"""Landed responses as files: JSON lines {request, http_status, response: {count, <key>: [...]}}, in batch or as a stream, counted in the pass that splits them."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from . import envelopes

#: Where a line that isn't JSON, or not of the schema, is kept as it stands.
CORRUPT = "_corrupt"


def schema(key: str) -> T.StructType:
    fields = [T.StructField("request", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("response", envelopes.schema(key)), T.StructField(CORRUPT, T.StringType())]
    return T.StructType(fields)


def _with_file(df: DataFrame) -> DataFrame:
    df = df.select("*", F.col("_metadata.file_path").alias("file")).withColumnRenamed("response", "envelope")
    return df.withColumn("status", status())


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """request, http_status, envelope, the corrupt line, the file it stands in and status of every line below ``path``."""
    return _with_file(spark.read.schema(schema(key)).option("columnNameOfCorruptRecord", CORRUPT).json(path))


def stream(spark: SparkSession, path: str, key: str, files: int = 100) -> DataFrame:
    """As read, of files as they land, at most ``files`` in a batch."""
    return _with_file(spark.readStream.schema(schema(key)).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files).json(path))


def status() -> Column:
    """``corrupt`` for a line that can't be read whole, else as envelopes.status."""
    return F.when(F.col(CORRUPT).isNotNull(), "corrupt").otherwise(envelopes.status())


def rows(df: DataFrame, key: str) -> DataFrame:
    """A row per entry of the good responses, with request, file and pos, the service's rank."""
    return envelopes.rows(df.where("status = 'ok'").select("request", "file", "envelope"), key)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "ok").alias("good"), F.count_if(F.col("status") != "ok").alias("rejected"), F.count_if(F.col("status") == "corrupt").alias("corrupt")]


def _laid(df: DataFrame) -> DataFrame:
    return df.withColumn("rejected", F.col("status") != "ok")


def write(df: DataFrame, path: str) -> dict[str, int]:
    """Writes good and rejected responses below ``path`` (``rejected=false``, ``rejected=true``), and counts them in that one pass."""
    seen = Observation("landed")
    _laid(df.observe(seen, *_counts())).write.mode("overwrite").partitionBy("rejected").parquet(path)
    return dict(seen.get)


class _Listener(StreamingQueryListener):
    """Adds up what the batches of one query observed. Its end comes after all its progress."""

    def __init__(self):
        self.query, self.over, self.ended, self.seen = None, threading.Event(), set(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen.append((str(event.progress.id), event.progress.batchId, event.progress.observedMetrics.get("landed")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
        if self.query in self.ended:
            self.over.set()


def write_stream(df: DataFrame, path: str, wait: float = 60) -> dict[str, int]:
    """As write, for all files that have landed since the last run; a folder for each batch, written over if the batch is run again.

    The counts are those of this run's batches, as a listener got them.
    """

    def sink(batch: DataFrame, number: int) -> None:
        _laid(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "rejected").parquet(f"{path}/out")

    listener = _Listener()
    df.sparkSession.streams.addListener(listener)
    try:
        query = df.observe("landed", *_counts()).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        listener.query = str(query.id)
        query.awaitTermination()
        listener.over.wait(wait)
    finally:
        df.sparkSession.streams.removeListener(listener)
    batches = {number: row for name, number, row in listener.seen if name == listener.query and row is not None}
    return {c: sum(row[c] for row in batches.values()) for c in ("lines", "good", "rejected", "corrupt")}
