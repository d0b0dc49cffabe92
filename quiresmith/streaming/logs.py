"""Incremental scans of batch logs by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiresmith.operators.relations import last_by
from quiresmith.session import shared_path
from quiresmith.sources.schemas import BATCH_LOG
from quiresmith.sources.sinks import append_log


def follow(spark: SparkSession, folder: str, schema: str = BATCH_LOG) -> DataFrame:
    """Streaming rows of the JSON-lines files that appear in a folder. A writer adds a file per batch; growing files are not tailed."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)


def finished(rows: DataFrame) -> DataFrame:
    """The first ``ok`` row of each name, over the whole stream."""
    return rows.where(F.col("status") == "ok").dropDuplicates(["name"])


def process(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Hand each micro-batch to ``handle``; ``once`` takes what is there and stops, else a batch runs at each interval.

    The checkpoint lies in the shared folder, so that a restart goes on where
    the last run ended.
    """
    spark = rows.sparkSession
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint or shared_path(spark, "stream"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def unseen(rows: DataFrame, horizon: str = "1 day") -> DataFrame:
    """The first ``ok`` row of each name within ``horizon`` of processing time; what is remembered of older names is let go."""
    timed = rows.where(F.col("status") == "ok").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", horizon)
    return timed.dropDuplicatesWithinWatermark(["name"]).drop("arrived")


def ended(spark: SparkSession, marker: str, said: str = "batch finished", within: int = 400) -> bool:
    """Whether a file is there and says so at its end."""
    try:
        texts = spark.read.text(marker, wholetext=True)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise
    return not texts.where(F.right("value", F.lit(within)).contains(said)).isEmpty()


def follow_log(
    spark: SparkSession,
    folder: str,
    own: str,
    handle: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    marker: str | None = None,
    once: bool = False,
    every: float = 30.0,
    horizon: str = "1 day",
    schema: str = BATCH_LOG,
) -> None:
    """Hand each finished name of a log to ``handle`` once, and keep what it returns (name, ...) in the log ``own``, until the batch has ended.

    Rows come as a stream. The stream forgets names after ``horizon``; names
    in ``own`` are left out of every batch, so that neither this nor a restart
    hands one over again. ``once`` takes what is there; otherwise a batch runs
    each ``every`` seconds, and the call returns when ``marker`` says that the
    batch has ended and all rows before are handled. A handler that fails
    ends the call, and its batch comes again with the next.
    """
    own_schema = "name string, commit long"

    def step(batch: DataFrame, number: int) -> None:
        done = spark.read.schema(own_schema).json(own).select("name").distinct() if commits(spark, own) else batch.select("name").limit(0)
        work = batch.join(done, "name", "left_anti")
        if not work.isEmpty():
            append_log(handle(work), own)

    query = process(unseen(follow(spark, folder, schema), horizon), step, checkpoint, once, f"{every} seconds")
    if once:
        query.awaitTermination()
        return
    while not query.awaitTermination(max(1, int(every))):
        if marker and ended(spark, marker):
            query.processAllAvailable()
            query.stop()
            return


def commits(spark: SparkSession, path: str) -> int:
    """How many commits a log has had."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return len(store.listStatus(folder)) if store.exists(folder) else 0


def resume(files: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Files not in the log. A failed file counts as done; requeue it to run again."""
    done = log.where(F.col("paper").isNotNull()).select(F.col("paper").alias(key)).distinct()
    return files.join(done, key, "left_anti")


def latest(log: DataFrame, key: str = "name") -> DataFrame:
    """The last row of each key of log(ord, ...)."""
    return last_by(log, [key], "ord")
