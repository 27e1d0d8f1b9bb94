"""Windowed indicators on a stream of events, with the same row shapes as their batch forms."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalar import cents, weight_of
from ..session import scratch_path
from ..settings import BEHAVIOR_WEIGHTS
from ..sources.worlds import event_columns, event_orders

LATENESS = "2 hours"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files arriving in a folder; the schema is read off the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def behavior_stream(events: DataFrame) -> DataFrame:
    return event_columns(events).withColumn("event_time", F.col("event_time").cast("timestamp"))


def order_stream(events: DataFrame) -> DataFrame:
    return event_orders(events).withColumn("order_time", F.col("order_time").cast("timestamp"))


def page_views(behaviors: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    views = behaviors.filter(F.col("behavior_type") == "pv").withWatermark("event_time", lateness)
    return views.groupBy(F.window("event_time", window)).agg(F.count(F.lit(1)).alias("pv")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pv")


def active_users(behaviors: DataFrame, window: str = "1 hour", slide: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Exact: one row per (window, user) first, then rows per window, both closed by the watermark."""
    per_user = behaviors.withWatermark("event_time", lateness).groupBy(F.window("event_time", window, slide), "user_id").agg(
        F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("window").agg(F.count(F.lit(1)).alias("active_users")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "active_users")


def item_heat(behaviors: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    scored = behaviors.withWatermark("event_time", lateness)
    return scored.groupBy(F.window("event_time", window), "item_id").agg(
        F.sum(weight_of("behavior_type", BEHAVIOR_WEIGHTS)).alias("heat")).select(
        F.col("window.start").alias("window_start"), "item_id", "heat")


def order_totals(orders: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    paid = orders.filter(F.col("status") == "paid").withWatermark("order_time", lateness)
    return paid.groupBy(F.window("order_time", window)).agg(
        F.count(F.lit(1)).alias("orders"), cents(F.sum("total_amount")).alias("gmv")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "orders", "gmv")


def user_sessions(behaviors: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    return behaviors.withWatermark("event_time", lateness).groupBy(
        "user_id", F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("s.start").alias("session_start"), "events")


def deduplicated(behaviors: DataFrame, key: str = "behavior_id", lateness: str = LATENESS) -> DataFrame:
    return behaviors.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there, append to Parquet and read the result back.

    Windows still open at the watermark stay in the state of ``checkpoint`` for the next run.
    """
    return run_counting_late(stream, out, checkpoint)[0]


class LateRows(StreamingQueryListener):
    """Adds up the rows that a query's stateful operators dropped, batch by batch, however many batches there are.

    A batch is counted once, under its number, even if its progress is reported again.
    """

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.by_batch[str(p.runId), p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def total(self, run: str, wait_seconds: float = 60.0) -> int:
        """Dropped rows of an ended query; reports arrive in order, so after its end all of its batches are in."""
        if not self._end_of(run).wait(wait_seconds):
            raise TimeoutError(f"no report of the end of query {run}")
        return sum(n for (r, _), n in self.by_batch.items() if r == run)


def run_counting_late(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """``run_available`` together with the number of rows that came too late for the watermark and were dropped."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "state")
    late = LateRows()
    spark.streams.addListener(late)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start(out))
        query.awaitTermination()
        dropped = late.total(str(query.runId))
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(stream.schema).parquet(out), dropped


def run_top_items(heat: DataFrame, k: int = 10, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Top ``k`` items per closed window, ranked batch by batch as windows close."""
    from pyspark.sql import Window

    spark = heat.sparkSession
    out = out or scratch_path(spark, "hot")
    checkpoint = checkpoint or scratch_path(spark, "state")
    order = Window.partitionBy("window_start").orderBy(F.desc("heat"), "item_id")

    def rank(batch: DataFrame, batch_id: int) -> None:
        # A folder per batch makes a repeated batch overwrite itself instead of adding rows twice.
        batch.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    heat.writeStream.outputMode("append").foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")
