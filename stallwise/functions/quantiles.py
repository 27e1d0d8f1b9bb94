"""Exact quantile edges and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_edges(df: DataFrame, column: str, bins: int) -> Column:
    """Distinct edges of equal-frequency bins as a scalar array.

    ``percentile`` is exact and keeps one counter per distinct value, so its state is bounded by the
    number of price points, not by the rows.  One price only falls back to equal width around it.
    """
    q = F.percentile(F.col(column).cast("double"), F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    edges = F.array_distinct(q)
    p = F.element_at(edges, 1)
    pad = F.when(p == 0, F.lit(0.001)).otherwise(F.abs(p) * 0.001)
    flat = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: p - pad + pad * 2 * i / bins)
    return df.agg(F.when(F.size(edges) < 2, flat).otherwise(edges).alias("edges")).scalar()


def bin_index(value, edges: Column) -> Column:
    """Right-closed bin number; values past the ends go to the outer bins."""
    upper = F.slice(edges, F.lit(2), F.size(edges) - 1)
    below = F.size(F.filter(upper, lambda e: e < value))
    return F.least(below, F.size(edges) - 2)
