"""Pairs of members that share a group: baskets, co-visited items, users of an item.

Large groups are cut into blocks of members.  A pair of blocks is its own join key, so the work of
one hot group is spread over (blocks^2)/2 tasks and no task ever sees more than two blocks.  The
join streams straight into the partial aggregate: pairs are summed before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK_ROWS = 1024


def _blocked(df: DataFrame, group: str, member: str, block_rows: int) -> DataFrame:
    large = (
        df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
        .select(group, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    )
    return (
        df.join(large, group, "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    )


def pair_sums(df: DataFrame, group: str, member: str, value: str | None = None,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(a, b, shared, dot)`` for members ``a < b`` with at least one group in common.

    ``df`` holds each (group, member) once.  ``dot`` sums the products of ``value`` (1 if absent).
    """
    weight = F.col(value).cast("double") if value else F.lit(1.0)
    base = _blocked(df.select(group, member, weight.alias("_w")), group, member, block_rows)
    left = base.select(
        F.col(group).alias("_g"), F.col(member).alias("_x"), F.col("_w").alias("_wx"), F.col("_block").alias("_bx"),
        F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_by"))
    right = base.select(
        F.col(group).alias("_g"), F.col(member).alias("_y"), F.col("_w").alias("_wy"), F.col("_block").alias("_by"),
        F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_bx"))
    pairs = left.join(right, ["_g", "_bx", "_by"]).filter(
        ((F.col("_bx") < F.col("_by")) & (F.col("_x") != F.col("_y"))) | (F.col("_x") < F.col("_y")))
    return pairs.groupBy(
        F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")
    ).agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("_wx") * F.col("_wy")).alias("dot"))


def both_ways(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


