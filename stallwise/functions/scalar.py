"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BEHAVIOR_TYPES

MICROS_PER_DAY = 86_400_000_000


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def safe_div(num, den, scale: int = 4) -> Column:
    """Rounded ratio; a null or zero denominator gives 0."""
    ratio = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    return F.coalesce(F.round(ratio, scale), F.lit(0.0))


def cents(amount) -> Column:
    """Money has two decimals; rounding sums drops what the order of addition left behind."""
    return F.round(as_col(amount), 2)


def micros_between(later, earlier) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later))


def elapsed_days(later, earlier) -> Column:
    """Whole 24-hour spans, rounded down: not the same as a calendar day difference."""
    return F.floor(micros_between(later, earlier) / F.lit(MICROS_PER_DAY)).cast("long")


def time_decay(ref_date, event_date, half_life: float) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(F.datediff(as_col(ref_date), as_col(event_date)), F.lit(0))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def weight_of(type_col, weights: dict[str, float]) -> Column:
    """Weight of a behaviour type; types without one weigh nothing."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = F.when(as_col(type_col) == name, F.lit(float(weight))).otherwise(out)
    return out


def by_maximum(value: Column | str, top: Column) -> Column:
    """Value over the largest value; 0 where nothing is above 0."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(top > 0, c / top).otherwise(F.lit(0.0))


def min_max(value, low, high) -> Column:
    """Scale to [0, 1]; a flat range gives 0."""
    value, low, high = as_col(value), as_col(low), as_col(high)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def type_counts(prefix: str = "", types=BEHAVIOR_TYPES, col="behavior_type") -> list[Column]:
    """One conditional count per behaviour type: a fixed schema without a pivot job."""
    return [F.count_if(as_col(col) == t).alias(f"{prefix}{t}") for t in types]


def weighted_counts(weights: dict[str, float], prefix: str = "") -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(f"{prefix}{name}") * F.lit(float(weight))
    return total


def scalar_row(df: DataFrame, **aggregates: Column) -> Column:
    """One-row aggregate as a scalar subquery: Spark runs it once and inlines the value."""
    fields = [expr.alias(name) for name, expr in aggregates.items()]
    return df.agg(F.struct(*fields).alias("row")).scalar()


def bin_score_low(value, bins) -> Column:
    """Smaller is better: below the first bound scores highest."""
    out = F.lit(1)
    for i, bound in reversed(list(enumerate(bins))):
        out = F.when(as_col(value) < bound, F.lit(len(bins) + 1 - i)).otherwise(out)
    return out


def bin_score_high(value, bins) -> Column:
    """Larger is better: one point more for every bound reached."""
    out = F.lit(1)
    for bound in bins:
        out = out + F.when(as_col(value) >= bound, 1).otherwise(0)
    return out


def first_rule(rules, columns: dict[str, Column] | None = None) -> Column:
    """First rule whose closed ranges all hold; the last rule is the default."""
    columns = columns or {}
    out = F.lit(rules[-1][0])
    for label, ranges in reversed(rules[:-1]):
        hit = F.lit(True)
        for name, (low, high) in ranges.items():
            value = columns.get(name, F.col(name))
            if low is not None:
                hit = hit & (value >= low)
            if high is not None:
                hit = hit & (value <= high)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def rule_labels(rules) -> list[str]:
    return list(dict.fromkeys(label for label, _ in rules))
