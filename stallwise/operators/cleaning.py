"""Rule-driven cleaning: every rule is a boolean column, every table is one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cents
from ..schemas import TABLES, columns_of, key_of, references, require_columns, ruled, times_of

_BLANKS = " \t\n\r\f\v"


def _any(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, rules, F.lit(False))


def trim_text(df: DataFrame) -> DataFrame:
    """Strip every text column; nulls stay null."""
    return df.select(*[
        F.trim(F.col(f.name), F.lit(_BLANKS)).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields])


def missing_rule(table: str) -> Column:
    return _any([F.col(c).isNull() | (F.col(c).cast("string") == "") for c in ruled(table, "required")])


def time_parse_rule(table: str) -> Column:
    return _any([F.col(c).isNotNull() & F.col(c).try_cast("timestamp_ntz").isNull() for c in times_of(table)])


def enum_rule(table: str) -> Column:
    return _any([F.coalesce(~F.col(c).cast("string").isin(values), F.lit(False)) for c, values in ruled(table, "allowed").items()])


def bounds_rule(table: str) -> Column:
    """A value that is given must be a number within its bounds."""
    breaks = {"low": lambda n, x: n < x, "high": lambda n, x: n > x, "over": lambda n, x: n <= x}
    bad = [F.col(c).isNotNull() & F.coalesce(test(F.col(c).try_cast("double"), bound), F.lit(True))
           for rule, test in breaks.items() for c, bound in ruled(table, rule).items()]
    return _any(bad)


def rebuild_date_hour(df: DataFrame) -> DataFrame:
    """Date and hour follow from the event time wherever that parses."""
    ts = F.col("event_time").try_cast("timestamp_ntz")
    return df.withColumns({
        "event_date": F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.col("event_date").cast("string")),
        "event_hour": F.coalesce(F.hour(ts).cast("string"), F.col("event_hour").cast("string")),
    })


def judge(raw: DataFrame, table: str) -> DataFrame:
    """Trimmed rows with the flags ``_missing`` and ``_illegal``.

    Missing is judged on what came in; date and hour are rebuilt only afterwards.
    """
    require_columns(raw, columns_of(table), table)
    df = trim_text(raw).withColumn("_missing", missing_rule(table))
    df = df.withColumn("_bad_time", time_parse_rule(table))
    if ruled(table, "follows"):
        df = rebuild_date_hour(df)
    return df.withColumn(
        "_illegal", F.col("_bad_time") | enum_rule(table) | bounds_rule(table)).drop("_bad_time")


def first_copies(judged: DataFrame, table: str, row_order: list[str] | None = None) -> DataFrame:
    """One row per key: the first copy, with how many copies there were and how they fared.

    An aggregate rather than a window: copies of a hot key are reduced before the shuffle.
    """
    data = [c for c in judged.columns if c not in ("_missing", "_illegal")]
    tallies = [F.count(F.lit(1)).alias("_copies"), F.count_if("_missing").alias("_n_missing"),
               F.count_if("_illegal").alias("_n_illegal")]
    flags = ["_missing", "_illegal"]
    key = key_of(table)
    if key is None:
        columns = columns_of(table)
        return judged.groupBy(*columns).agg(
            *[F.first(f).alias(f) for f in flags], *tallies)
    order = row_order or data
    grouped = judged.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*data, *flags), F.struct(*order)).alias("_row"), *tallies)
    return grouped.select("_row.*", "_copies", "_n_missing", "_n_illegal")


def deduplicate(df: DataFrame, key: str | None, row_order: list[str] | None = None) -> DataFrame:
    if key is None:
        return df.dropDuplicates()
    columns = df.columns
    return df.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*columns), F.struct(*(row_order or columns))).alias("_row")).select("_row.*")


def flag_references(df: DataFrame, table: str, known: dict[str, DataFrame]) -> DataFrame:
    """``_fk_<field>`` is true where the field points to no row; null references pass.

    ``known`` holds, by name, clean tables with the referenced keys.
    """
    for field, (target, key) in references(table).items():
        keys = known[target].select(F.col(key).alias(field)).distinct().withColumn("_found", F.lit(True))
        df = df.join(keys, field, "left").withColumn(
            f"_fk_{field}", F.col(field).isNotNull() & F.col("_found").isNull()).drop("_found")
    return df


def flag_times(df: DataFrame, table: str, users: DataFrame | None, data_end: str | None) -> DataFrame:
    """``_early``: before the user registered; ``_late``: after the end of the data."""
    column = next((c for c in ("event_time", "order_time") if c in columns_of(table)), None)
    early, late = F.lit(False), F.lit(False)
    if column:
        ts = F.col(column).try_cast("timestamp_ntz")
        if users is not None:
            since = users.groupBy("user_id").agg(
                F.min(F.col("register_time").try_cast("timestamp_ntz")).alias("_since"))
            df = df.join(since, "user_id", "left")
            early = F.coalesce(ts < F.col("_since"), F.lit(False))
        if data_end is not None:
            late = F.coalesce(ts > F.lit(f"{data_end} 23:59:59").cast("timestamp_ntz"), F.lit(False))
    return df.withColumns({"_early": early, "_late": late}).drop("_since")


def examine(raw: DataFrame, table: str, known: dict[str, DataFrame], data_end: str | None = None,
            row_order: list[str] | None = None) -> DataFrame:
    """First copies with all flags; both the clean table and the report come from this frame."""
    df = first_copies(judge(raw, table), table, row_order)
    if any(target == table for target, _ in references(table).values()):
        known = {**known, table: trim_text(raw)}
    df = flag_references(df, table, known)
    df = flag_times(df, table, known.get("users") if table != "users" else None, data_end)
    fk = _any([F.col(f"_fk_{f}") for f in references(table)])
    sound = ~F.col("_missing") & ~F.col("_illegal")
    return df.withColumns({
        "_fk": sound & fk, "_time": sound & ~fk & (F.col("_early") | F.col("_late")),
        "_kept": sound & ~fk & ~(F.col("_early") | F.col("_late"))})


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as numbers; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def clean_rows(examined: DataFrame, table: str) -> DataFrame:
    """Kept rows in the types of the table."""
    kinds = {f.name: f.dataType for f in TABLES[table].fields}
    def typed(name: str) -> Column:
        kind = kinds[name]
        if isinstance(kind, T.TimestampType):
            return F.col(name).try_cast("timestamp_ntz").alias(name)
        if isinstance(kind, T.IntegerType):
            return F.col(name).try_cast("double").cast("int").alias(name)
        return F.col(name).try_cast(kind).alias(name)
    return examined.filter("_kept").select(*[typed(c) for c in columns_of(table)])


def quality_row(examined: DataFrame, table: str) -> DataFrame:
    """Counts of one table.  Missing, illegal and duplicate rows may overlap."""
    fk = [F.count_if(~F.col("_missing") & ~F.col("_illegal") & F.col(f"_fk_{f}")) for f in references(table)]
    names = list(references(table))
    detail = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in zip(names, fk)]) \
        if names else F.lit("")
    live = ~F.col("_missing") & ~F.col("_illegal") & ~_any([F.col(f"_fk_{f}") for f in names])
    return examined.agg(
        F.lit(table).alias("table_name"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("_n_missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_n_illegal"), F.lit(0)).alias("illegal"),
        F.count_if("_fk").alias("fk"), F.count_if("_time").alias("time_rule"),
        F.count_if("_kept").alias("final_rows"),
        detail.alias("fk_detail"),
        F.concat_ws(",", F.concat(F.lit("before_register="), F.count_if(live & F.col("_early")).cast("string")),
                    F.concat(F.lit("after_end="), F.count_if(live & F.col("_late")).cast("string")))
        .alias("time_detail"),
    ).withColumn("dropped_rows", F.col("source_rows") - F.col("final_rows"))


def quality_report(examined: dict[str, DataFrame]) -> DataFrame:
    rows = [quality_row(df, name) for name, df in examined.items()]
    return reduce(DataFrame.unionByName, rows)


def quality_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("source_rows").alias("total_rows"), F.sum("duplicates").alias("duplicate_rows"),
        F.sum("missing").alias("missing_rows"), F.sum("illegal").alias("invalid_rows"),
        F.sum("final_rows").alias("final_rows"))


def reconcile_orders(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Order totals follow the sum of their lines; orders without lines keep theirs."""
    sums = order_items.groupBy("order_id").agg(cents(F.sum("amount")).alias("_lines"))
    differs = F.col("_lines").isNotNull() & (F.round("total_amount", 2) != F.col("_lines"))
    return orders.join(sums, "order_id", "left").withColumns({
        "corrected": differs,
        "total_amount": F.when(differs, F.col("_lines")).otherwise(F.col("total_amount")),
    }).drop("_lines")


def event_time_range(behaviors: DataFrame) -> DataFrame:
    return behaviors.agg(F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
