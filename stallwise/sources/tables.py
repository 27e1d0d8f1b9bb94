"""Reading and writing tables: raw text, clean Parquet, appended and updated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, columns_of, require_columns
from ..session import cut_lineage


def read_raw_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Raw rows as text with their place in the files (``_row``); the header must hold every column of the table."""
    header = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    require_columns(header, columns_of(table), table)
    # a file's parts may be read in any order: path and offset say which comes first
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return header.select(*[F.col(c).cast("string").alias(c) for c in columns_of(table)], place.alias("_row"))


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Typed rows; values that do not fit their type become null."""
    text = require_columns(spark.read.option("header", True).csv(path), columns_of(table), table)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 table: str = "table") -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else require_columns(df, columns, table).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """With a partition column, adaptive execution gathers each of its values into full-sized files and
    splits a value that holds too much for one task.
    """
    if partition_by:
        df.hint("rebalance", F.col(partition_by)).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_measured(df: DataFrame, path: str, partition_by: str | None = None, time: str | None = None, as_json: bool = False) -> dict[str, object]:
    """Write a table and return its ``rows`` (with ``time`` its ``first_time`` and ``last_time``, too).

    The figures are observed while the rows go by to the files, in the writing stage itself: no second scan, and a row that a retried
    task writes again counts once.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    figures = [F.count(F.lit(1)).alias("rows")]
    if time:
        figures += [stamp(F.min(time)).alias("first_time"), stamp(F.max(time)).alias("last_time")]
    seen = Observation()
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.observe(seen, *figures).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path) if as_json else writer.parquet(path)
    return seen.get


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def new_rows(existing: DataFrame, incoming: DataFrame, key: str | None) -> DataFrame:
    """Rows to append: unseen keys only, one row per key.  Without a key every row is new."""
    if key is None:
        return incoming
    once = incoming.groupBy(F.col(key).alias("_key")).agg(
        F.min(F.struct(*incoming.columns)).alias("_row")).select("_row.*")
    return once.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def append_rows(spark: SparkSession, path: str, incoming: DataFrame, key: str | None) -> None:
    new_rows(spark.read.parquet(path), incoming, key).write.mode("append").parquet(path)


def update_by_key(df: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where an update exists, old ones elsewhere."""
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return df.join(fresh, key, "left").select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def merge_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str, columns: list[str], partition_by: str) -> None:
    """New values of ``columns`` by key, and rows with unseen keys, into a partitioned table: only the partitions that hit are rewritten.

    ``updates`` has every column of the table.  A known key stays in its partition and keeps its other columns; of several
    updates of a key the smallest row counts.  The partitions are found by key over the two narrow columns, read, merged and
    written aside; then they replace the old ones, and all other files stay as they are.
    """
    table = spark.read.parquet(path)
    once = cut_lineage(updates.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*table.columns)).alias("_row")).select("_row.*"))
    places = table.select(key, F.col(partition_by).alias("_place"))
    found = cut_lineage(once.join(places, key, "left").withColumn("_seen", F.col("_place").isNotNull()).withColumn(
        "_place", F.coalesce("_place", partition_by)))
    touched = found.select(F.col("_place").alias(partition_by)).distinct()
    kept = table.join(touched, partition_by, "left_semi").select(*table.columns)
    merged = update_by_key(kept, found.filter("_seen"), key, columns).unionByName(found.filter("not _seen").select(*table.columns))
    staged = cut_lineage(merged)
    staged.hint("rebalance", F.col(partition_by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition_by).parquet(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
               for name, df in tables.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def event_record(source: str, df: DataFrame, time: str) -> DataFrame:
    """Lineage facts of a table in one row: its name, its first and last time, its rows."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.agg(F.lit(source).alias("source"), stamp(F.min(time)).alias("first_time"), stamp(F.max(time)).alias("last_time"),
                  F.count(F.lit(1)).alias("rows"))


def table_records(spark: SparkSession, measured: dict[str, dict[str, object]]) -> DataFrame:
    """(table_name, rows, first_time, last_time): what ``write_measured`` saw of each table of a run."""
    rows = [(name, m["rows"], m.get("first_time"), m.get("last_time")) for name, m in measured.items()]
    return spark.createDataFrame(rows, "table_name string, rows long, first_time string, last_time string")


def run_record(spark: SparkSession, **facts) -> DataFrame:
    """One row of lineage facts about a run."""
    values = {k: None if v is None else str(v) for k, v in facts.items()}
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()],
                                 F.current_timestamp().alias("run_at"))
