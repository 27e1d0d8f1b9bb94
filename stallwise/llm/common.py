"""What several operators share: column guards, scratch tables, word rules, exact prefix sums, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.session import cut_lineage

__all__ = ["SPACE", "WORD", "arrow_rows", "bucketed_sums", "components", "cut_lineage", "fresh", "read", "words"]

# The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch: texts may be long, and a batch is held in a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bucketed_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of ``group`` before this one, by (``bucket``, ``order``).

    A hot group is spread over its buckets: a first aggregate gives each bucket its offset, and only the rows of one
    bucket are sorted together.  ``bucket`` must rise with the order.  Exact, whatever executors are lost.
    """
    total, offset, inside = fresh(df, "total"), fresh(df, "offset"), fresh(df, "inside")
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*group, bucket).agg(F.sum(value).alias(total)).select(
        *[F.col(c).alias(f"{c}{offset}") for c in [*group, bucket]],
        F.coalesce(F.sum(total).over(earlier), F.lit(0)).cast("long").alias(offset))
    before = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn(inside, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}{offset}")) for c in [*group, bucket]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return inner.join(offsets, cond).withColumn(out, F.col(offset) + F.col(inside)).select(*df.columns, out)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star steps; each ends in a written table, so lineage stays short and a lost
    executor costs one step.  Every step is an aggregate by node (with map-side minimum) and a join back to it.
    Tables shrink to one row per node.
    """
    now = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(
            F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = cut_lineage(large)
        # small star: every node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "k")
        small = large.join(low, F.col("b") == F.col("k"))
        after = cut_lineage(small.select(F.col("m").alias("a"), "b").unionByName(
            small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        # stable when no node has two smaller neighbours and no root is below another node
        state = after.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")).first()
        roots = after.select(F.col("a").alias("b")).distinct().join(after.select("b").distinct(), "b", "left_semi")
        if (state["most"] or 1) == 1 and roots.isEmpty():
            break
        now = after
    return after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
