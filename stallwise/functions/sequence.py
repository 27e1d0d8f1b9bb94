"""Order-dependent helpers that never put one key's whole history into one task.

A key's rows are split into time buckets.  Windows run inside a (key, bucket); what crosses a
bucket border is carried by a one-row summary per bucket, and only those summaries are ordered
per key.  A key with a third of all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scalar import micros_between


def with_previous(df: DataFrame, key: list[str], time: str, tie: str, carry: list[str],
                  bucket_unit: str = "hour") -> DataFrame:
    """Adds ``_bucket`` and the struct ``_prev`` holding ``carry`` of the preceding row of the key."""
    df = df.withColumn("_bucket", F.date_trunc(bucket_unit, time).cast("timestamp_ntz"))
    inner = Window.partitionBy(*key, "_bucket").orderBy(time, tie)
    outer = Window.partitionBy(*key).orderBy("_bucket")
    last = (
        df.groupBy(*key, "_bucket").agg(F.max_by(F.struct(*carry), F.struct(time, tie)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(outer)).drop("_last")
    )
    return (
        df.withColumn("_prev", F.lag(F.struct(*carry)).over(inner))
        .join(last, [*key, "_bucket"], "left")
        .withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")
    )


def sessions(df: DataFrame, gap_minutes: int, key: str = "user_id", time: str = "event_time",
             tie: str = "behavior_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_prev``, ``new_session`` and ``session_start``; a gap of exactly the limit still continues.

    One summary row per (key, bucket) carries all that crosses its borders: the last row, and where the last session began.
    """
    kept = F.struct(time, *carry)
    df = df.filter(F.col(time).isNotNull()).withColumn("_bucket", F.date_trunc("hour", time).cast("timestamp_ntz"))
    inner = Window.partitionBy(key, "_bucket").orderBy(time, tie)
    outer = Window.partitionBy(key).orderBy("_bucket")
    limit = gap_minutes * 60_000_000
    df = df.withColumn("_inside", F.lag(kept).over(inner))
    late = F.col("_inside").isNotNull() & (micros_between(time, F.col(f"_inside.{time}")) > limit)
    borders = df.groupBy(key, "_bucket").agg(
        F.min(time).alias("_first"), F.max_by(kept, F.struct(time, tie)).alias("_last"), F.max(F.when(late, F.col(time))).alias("_begin"))
    borders = borders.withColumn("_before", F.lag("_last").over(outer))
    opens = F.col("_before").isNull() | (micros_between("_first", F.col(f"_before.{time}")) > limit)
    begun = F.coalesce("_begin", F.when(opens, F.col("_first")))
    borders = borders.select(key, "_bucket", "_before", F.max(begun).over(
        outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    df = df.join(borders, [key, "_bucket"], "left").withColumn("_prev", F.coalesce("_inside", "_before"))
    df = df.withColumn("new_session", F.col("_prev").isNull() | (micros_between(time, F.col(f"_prev.{time}")) > limit))
    own = F.max(F.when(F.col("new_session"), F.col(time))).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("session_start", F.coalesce(own, "_open")).drop("_inside", "_before", "_open")


def even_buckets(df: DataFrame, order: list[Column | str], name: str = "bucket") -> DataFrame:
    """``name``: numbers that rise with the order and hold about equally many rows each, however the values cluster.

    The split comes from sampled ranges, so the table is written once and every later pass sees the same split.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running_total(df: DataFrame, bucket: str, order: list, columns: list[str],
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``cum_<column>`` over the order (bucket, order) per ``by`` without a one-task window.

    ``bucket`` must be monotone in the order and take a bounded number of values.
    """
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    offsets = totals.select(*by, bucket, *[
        F.coalesce(F.sum(f"_t_{c}").over(outer), F.lit(0)).alias(f"_o_{c}") for c in columns])
    joined = df.join(offsets, [*by, bucket])
    return joined.select(*df.columns, *[
        (F.sum(c).over(inner) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in columns])
