"""Small pieces of check SQL that recur in many queries."""

from __future__ import annotations

TYPES = ("pv", "click", "collect", "cart", "buy")


def sd(num: str, den: str, scale: int = 4) -> str:
    return f"coalesce({rnd(f'CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)', scale)}, 0.0)"


def rnd(expr: str, scale: int) -> str:
    """Half-up on the decimal value, which is how Spark rounds a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 9)), {scale}) AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def counts(prefix: str = "", types=TYPES) -> str:
    return ", ".join(f"count(*) FILTER (behavior_type = '{t}') AS {prefix}{t}" for t in types)


def summed(types=TYPES, prefix: str = "") -> str:
    return ", ".join(f"CAST(sum({prefix}{t}) AS BIGINT) AS {prefix}{t}" for t in types)


def zeroed(cols, alias: str = "") -> str:
    return ", ".join(f"CAST(coalesce({alias}{c}, 0) AS BIGINT) AS {c}" for c in cols)


def elapsed(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def day(expr: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR)"


def days_between(later: str, earlier: str) -> str:
    return f"date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE))"
