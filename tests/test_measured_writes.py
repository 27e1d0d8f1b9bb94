"""Figures observed while tables are written, partition merges, and late rows over many batches."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stallwise.sources import tables as S
from stallwise.streaming.indicators import run_counting_late


def test_a_write_reports_rows_and_time_range(spark, tmp_path):
    df = spark.sql("SELECT id, TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, id) AS t, CAST(id % 3 AS string) AS part FROM range(50)")
    seen = S.write_measured(df, str(tmp_path / "t"), partition_by="part", time="t")
    assert seen == {"rows": 50, "first_time": "2026-01-01 00:00:00", "last_time": "2026-01-03 01:00:00"}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50
    assert S.write_measured(df.limit(0), str(tmp_path / "none"), time="t") == {"rows": 0, "first_time": None, "last_time": None}
    assert S.write_measured(df, str(tmp_path / "j"), as_json=True) == {"rows": 50} and spark.read.json(str(tmp_path / "j")).count() == 50


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_rewrites_only_the_partitions_it_hits(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.range(40).select("id", F.lit("old").alias("v"), F.col("id").alias("w"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("day"))
    S.write_table(rows, path, "day")
    before = _files(path)
    updates = spark.createDataFrame([(1, "new", None, dt.date(2026, 1, 1)), (1, "zzz", None, dt.date(2026, 1, 1)), (5, None, None, dt.date(2026, 1, 2)),
                                     (100, "added", 7, dt.date(2026, 2, 1))], "id long, v string, w long, day date")
    S.merge_partitions(spark, path, updates, "id", ["v"], "day")
    after = _files(path)
    untouched = {f for f in before if "day=2026-01-02" not in f}
    assert {f: after.get(f) for f in untouched} == {f: before[f] for f in untouched}
    got = {r.id: (r.v, r.w, str(r.day)) for r in spark.read.parquet(path).collect()}
    # id 1 lies on January 2nd and stays there; a null update keeps the old value
    assert len(got) == 41 and got[1] == ("new", 1, "2026-01-02") and got[5] == ("old", 5, "2026-01-02") and got[100] == ("added", 7, "2026-02-01")


def test_late_rows_of_more_than_a_hundred_batches(spark, tmp_path):
    source = tmp_path / "arrivals"
    source.mkdir()
    start = dt.datetime(2026, 1, 1)
    for n in range(120):
        times = [start + dt.timedelta(days=n), start - dt.timedelta(days=9)]  # from the third file on the second row is late
        pq.write_table(pa.table({"id": pa.array([2 * n, 2 * n + 1], pa.int64()), "t": pa.array(times, pa.timestamp("us", tz="UTC"))}),
                       source / f"part-{n:04d}.parquet")
        os.utime(source / f"part-{n:04d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema("id long, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        kept, late = run_counting_late(stream.withWatermark("t", "1 hour").dropDuplicatesWithinWatermark(["id"]))
        assert kept.count() + late == 240 and 117 <= late <= 119
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
