"""Small fixed axes used to make a result dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axes(spark: SparkSession, **values) -> DataFrame:
    """Every combination of a few literal lists."""
    out = spark.range(1).select()
    for name, items in values.items():
        literals = F.array(*[F.lit(v) for v in items])
        out = out.select("*", F.explode(literals).alias(name))
    return out


def ordered_axis(spark: SparkSession, name: str, items, position: str = "position") -> DataFrame:
    literals = F.array(*[F.lit(v) for v in items])
    return spark.range(1).select(F.posexplode(literals).alias(position, name))


def dense(df: DataFrame, axis: DataFrame, on: list[str], zero: list[str]) -> DataFrame:
    return axis.join(df, on, "left").fillna(0, subset=zero)
