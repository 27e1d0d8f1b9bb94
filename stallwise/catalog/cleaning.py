"""Registered queries: scans, sinks, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..plans.cleaning import clean_tables
from ..schemas import LOAD_ORDER, columns_of, key_of
from ..session import cut_lineage, scratch_path
from ..sources import raw as X
from ..sources import tables as S
from ..sources.worlds import table
from .registry import ENTRIES, Entry, portable

DATA_END = "2024-01-28"

_RAW = """WITH base_users AS (
  SELECT c_custkey AS n, CASE WHEN c_custkey % 11 <> 0 THEN 18 + c_custkey % 43 END AS age,
         CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' END AS gender,
         CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS city,
         strftime(TIMESTAMP '2023-12-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER))
           + to_hours(CAST(c_custkey % 24 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS stamp
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
users_raw AS (
  SELECT CAST(CASE WHEN n % 40 = 39 THEN n - 1 ELSE n END AS VARCHAR) AS user_id,
         CASE WHEN n % 53 = 0 THEN 'abc' WHEN n % 59 = 0 THEN '70' ELSE CAST(age AS VARCHAR) END AS age,
         CASE WHEN n % 61 = 0 THEN 'X' ELSE gender END AS gender, city,
         CASE WHEN n % 67 = 0 THEN 'never' ELSE stamp END AS register_time, stamp AS created_at,
         CASE WHEN n % 71 = 0 THEN '' ELSE stamp END AS updated_at FROM base_users),
items_raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, 'R' || (p_partkey % 6) AS category_id, p_brand AS brand,
         CASE WHEN p_partkey % 37 = 0 THEN '-1' ELSE printf('%.2f', p_retailprice) END AS price,
         CASE WHEN p_partkey % 41 = 0 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS stock,
         CASE WHEN p_partkey % 43 = 0 THEN '2' WHEN p_partkey % 10 = 0 THEN '0' ELSE '1' END AS status,
         strftime(TIMESTAMP '2023-11-01 00:00:00' + to_days(CAST(p_partkey % 90 AS INTEGER))
           + to_hours(CAST(p_partkey % 24 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created_at FROM part),
behaviors_raw AS (
  SELECT CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS behavior_id,
         CASE WHEN event_id % 101 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
         CASE WHEN event_id % 79 = 0 THEN '99999999' ELSE regexp_extract(props, '([0-9]+)', 1) END AS item_id,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior_type,
         CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time,
         '1999-01-01' AS event_date,
         CASE WHEN event_id % 89 = 0 THEN '25' ELSE CAST(extract('hour' FROM ts) AS VARCHAR) END AS event_hour,
         CASE WHEN event_id % 83 = 0 THEN 'tv' ELSE CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'pc' ELSE 'tablet' END END AS device_type,
         CASE event_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'search' WHEN 2 THEN 'ads' WHEN 3 THEN 'campaign' ELSE 'recommendation' END AS channel
  FROM events),
orders_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN o_orderkey % 47 = 0 THEN '88888888' ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
         strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d %H:%M:%S') AS order_time,
         CASE WHEN o_orderkey % 73 = 0 THEN '-5' ELSE printf('%.2f', o_totalprice) END AS total_amount,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'cancelled' ELSE 'refunded' END AS status,
         o_orderpriority AS payment_method FROM orders),
order_items_raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey % 50 AS VARCHAR) AS item_id,
         CASE WHEN l_partkey % 31 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
         '10' AS unit_price, CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR) AS amount FROM lineitem),
categories_raw AS (
  SELECT 'R' || r_regionkey AS category_id, r_name AS category_name, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation)"""

_END = f"TIMESTAMP '{DATA_END} 23:59:59'"


def _miss(*cols):
    return "(" + " OR ".join(f"{c} IS NULL OR {c} = ''" for c in cols) + ")"


def _num(col, test):
    return (f"({col} IS NOT NULL AND (try_cast({col} AS DOUBLE) IS NULL OR {test.format(n=f'try_cast({col} AS DOUBLE)')}))")


def _when(col):
    return f"({col} IS NOT NULL AND try_cast({col} AS TIMESTAMP) IS NULL)"


_FLAGS = {
    "categories": (_miss("category_id", "category_name"), "FALSE"),
    "users": (_miss("user_id", "register_time", "created_at", "updated_at"),
              " OR ".join([_when("register_time"), _when("created_at"), _when("updated_at"),
                           "(gender IS NOT NULL AND gender NOT IN ('M', 'F'))", _num("age", "{n} < 18 OR {n} > 60")])),
    "items": (_miss("item_id", "item_name", "category_id", "price", "stock", "status", "created_at"),
              " OR ".join([_when("created_at"), "status NOT IN ('0', '1')", _num("price", "{n} < 0"), _num("stock", "{n} < 0")])),
    "user_behaviors": (_miss("behavior_id", "user_id", "item_id", "behavior_type", "event_time", "event_date", "event_hour",
                             "device_type", "channel"),
                       " OR ".join([_when("event_time"), "behavior_type NOT IN ('pv','click','collect','cart','buy')",
                                    "device_type NOT IN ('mobile','pc','tablet')",
                                    "channel NOT IN ('organic','search','ads','campaign','recommendation')",
                                    "(try_cast(event_time AS TIMESTAMP) IS NULL AND " + _num("event_hour", "{n} < 0 OR {n} > 23") + ")"])),
    "orders": (_miss("order_id", "user_id", "order_time", "total_amount", "status"),
               " OR ".join([_when("order_time"), "status NOT IN ('paid','cancelled','refunded')", _num("total_amount", "{n} < 0")])),
    "order_items": (_miss("order_id", "item_id", "quantity", "unit_price", "amount"),
                    " OR ".join([_num("quantity", "{n} <= 0"), _num("unit_price", "{n} < 0"), _num("amount", "{n} < 0")])),
}
_RAW_NAME = {"user_behaviors": "behaviors_raw"}
_KEYS = {"categories": "category_id", "users": "user_id", "items": "item_id", "user_behaviors": "behavior_id", "orders": "order_id"}
_REFS = {
    "categories": {"parent_id": "(SELECT category_id FROM categories_raw)"},
    "users": {}, "items": {"category_id": "(SELECT category_id FROM categories_kept)"},
    "user_behaviors": {"user_id": "(SELECT user_id FROM users_kept)", "item_id": "(SELECT item_id FROM items_kept)"},
    "orders": {"user_id": "(SELECT user_id FROM users_kept)"},
    "order_items": {"order_id": "(SELECT order_id FROM orders_kept)", "item_id": "(SELECT item_id FROM items_kept)"},
}
_TIMES = {"user_behaviors": "event_time", "orders": "order_time"}


def _steps(name: str) -> str:
    missing, illegal = _FLAGS[name]
    cols = columns_of(name)
    raw = _RAW_NAME.get(name, f"{name}_raw")
    part = _KEYS.get(name) or ", ".join(cols)
    fk = {f: f"({f} IS NOT NULL AND {f} NOT IN {q})" for f, q in _REFS[name].items()}
    ts = _TIMES.get(name)
    early = (f"coalesce(try_cast({ts} AS TIMESTAMP) < (SELECT min(try_cast(u.register_time AS TIMESTAMP)) FROM users_kept u "
             f"WHERE u.user_id = d.user_id), FALSE)") if ts else "FALSE"
    late = f"coalesce(try_cast({ts} AS TIMESTAMP) > {_END}, FALSE)" if ts else "FALSE"
    return f""",
{name}_judged AS (SELECT *, {missing} AS miss, coalesce({illegal}, FALSE) AS ill FROM {raw}),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {', '.join(c + ' NULLS FIRST' for c in cols)}) AS rn FROM {name}_judged),
{name}_flagged AS (SELECT *, {' OR '.join(fk.values()) or 'FALSE'} AS fk{''.join(f', {e} AS fk_{f}' for f, e in fk.items())},
   {early} AS early, {late} AS late FROM {name}_ranked d WHERE rn = 1),
{name}_kept AS (SELECT * FROM {name}_flagged WHERE NOT miss AND NOT ill AND NOT fk AND NOT early AND NOT late)"""


_ALL = _RAW + "".join(_steps(n) for n in LOAD_ORDER)


def _report_sql(name: str) -> str:
    detail = " || ',' || ".join(f"'{f}=' || count(*) FILTER (NOT miss AND NOT ill AND fk_{f})" for f in _REFS[name]) or "''"
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}_judged) AS source_rows,
  (SELECT count(*) FILTER (miss) FROM {name}_judged) AS missing, (SELECT count(*) FILTER (rn > 1) FROM {name}_ranked) AS duplicates,
  (SELECT count(*) FILTER (ill) FROM {name}_judged) AS illegal,
  count(*) FILTER (NOT miss AND NOT ill AND fk) AS fk, count(*) FILTER (NOT miss AND NOT ill AND NOT fk AND (early OR late)) AS time_rule,
  (SELECT count(*) FROM {name}_kept) AS final_rows, {detail} AS fk_detail,
  'before_register=' || count(*) FILTER (NOT miss AND NOT ill AND NOT fk AND early) || ',after_end='
    || count(*) FILTER (NOT miss AND NOT ill AND NOT fk AND late) AS time_detail,
  (SELECT count(*) FROM {name}_judged) - (SELECT count(*) FROM {name}_kept) AS dropped_rows FROM {name}_flagged"""


def _add(name, fn, sql=None):
    """``fn`` takes the session and the folder."""
    ENTRIES[name] = Entry(lambda spark, d: portable(fn(spark, d)), sql)


def _cleaned(spark, d):
    return clean_tables(X.raw_tables(spark, d), DATA_END)


_add("A01_table_scan", lambda s, d: S.read_parquet(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], "lineitem"),
     "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")


def _csv(spark, d):
    """Customers written as CSV and read back by the column names and types of a table."""
    path = scratch_path(spark, "csv")
    c = table(spark, d, "customer")
    S.write_csv(c.select(F.col("c_custkey").alias("order_id"), F.col("c_nationkey").alias("user_id"), F.lit("2024-01-05 10:00:00").alias("order_time"),
                         F.col("c_acctbal").alias("total_amount"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("payment_method")), path)
    return S.read_csv(spark, path, "orders").withColumn("order_time", F.date_format("order_time", "yyyy-MM-dd HH:mm:ss"))


_add("A01_csv_scan", _csv, """SELECT CAST(c_custkey AS VARCHAR) AS order_id, CAST(c_nationkey AS VARCHAR) AS user_id, '2024-01-05 10:00:00' AS order_time,
 c_acctbal AS total_amount, c_mktsegment AS status, c_name AS payment_method FROM customer""")
_add("A02_split_scan", lambda s, d: S.read_parquet(s, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(
    F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")),
    "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")


def _write_back(spark, d):
    path = scratch_path(spark, "behaviors")
    b = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("event_date"))
    S.write_table(b, path, "event_date")
    return spark.read.parquet(path).select("event_id", "user_id", "event_date")


_add("A04_clean_table_sink", _write_back,
     "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events")


def _append(spark, d):
    """Refresh with the paid orders, then append the whole table: seen keys must not repeat."""
    source = table(spark, d, "orders")
    orders = source.select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch_path(spark, "orders")
    S.write_table(source.filter("o_orderstatus = 'F'").select(*orders.columns), path)
    S.append_rows(spark, path, orders, "o_orderkey")
    return spark.read.parquet(path)


_add("A05_append_unseen_keys", _append, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")


def _update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return S.update_by_key(orders, sums, "o_orderkey", ["o_totalprice"])


_add("A06_update_by_key", _update, """SELECT o_orderkey, o_custkey, coalesce(s.t, o_totalprice) AS o_totalprice FROM orders
LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS t FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey""")



def _merge(spark, d):
    """Two events of one day and a new one of another are merged; per day the rows, the total, and whether its files are the old ones."""
    path = scratch_path(spark, "days")
    days = table(spark, d, "events").select("event_id", "user_id", "value", F.to_date("ts").alias("event_date"))
    S.write_table(days, path, "event_date")
    files = lambda name: spark.read.parquet(path).select("event_date", "_metadata.file_path", "_metadata.file_modification_time").groupBy(
        "event_date").agg(F.array_sort(F.collect_set(F.struct("file_path", "file_modification_time"))).alias(name))
    before = cut_lineage(files("before"))
    changed = days.filter("event_date = '2024-01-05' and event_id % 2 = 0").withColumn("value", F.lit(1.0)).withColumn(
        "event_date", F.lit("2024-01-09").cast("date"))  # a known key stays where it is
    new = days.agg((F.max("event_id") + 1).alias("event_id"), F.lit(7).cast(days.schema["user_id"].dataType).alias("user_id"), F.lit(2.0).alias("value"),
                   F.lit("2024-01-20").cast("date").alias("event_date"))
    S.merge_partitions(spark, path, changed.unionByName(new), "event_id", ["value"], "event_date")
    totals = spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))
    return totals.join(before, "event_date").join(files("after"), "event_date").select(
        "event_date", "rows", "total", (F.col("before") == F.col("after")).alias("untouched"))


_add("A06_merge_touched_days", _merge, """WITH e AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' AND event_id % 2 = 0 THEN 1.0 ELSE value END AS value
 FROM events UNION ALL SELECT DATE '2024-01-20', 2.0)
SELECT CAST(day AS VARCHAR) AS event_date, count(*) AS rows, round(sum(value), 2) AS total,
 CAST(day NOT IN (DATE '2024-01-05', DATE '2024-01-20') AS BIGINT) AS untouched FROM e GROUP BY day""")


def _measured(spark, d):
    """What a write observes of the rows that pass."""
    path = scratch_path(spark, "measured")
    e = table(spark, d, "events").withColumn("event_date", F.to_date("ts"))
    return S.table_records(spark, {"events": S.write_measured(e, path, "event_date", "ts"),
                                   "customer": S.write_measured(table(spark, d, "customer"), path + "-c")})


_add("A08_observed_write", _measured, """SELECT 'events' AS table_name, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time FROM events UNION ALL SELECT 'customer', count(*), NULL, NULL FROM customer""")

_CORE = ("customer", "part", "orders", "lineitem", "events", "nation")
_add("A07_row_counts", lambda s, d: S.row_counts({t: table(s, d, t) for t in _CORE}),
     " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _CORE))


def _record(spark, d):
    """The record as the runs write it, from the facts of a table."""
    facts = S.event_record("events", table(spark, d, "events"), "ts").first().asDict()
    return S.run_record(spark, **facts).select("source", "first_time", "last_time", F.col("rows").cast("long").alias("rows"))


_add("A08_run_record", _record, """SELECT 'events' AS source, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time, count(*) AS rows FROM events""")


def _json(spark, d):
    path = scratch_path(spark, "funnel")
    S.write_json(ENTRIES["D19_conversion_funnel"].run(spark, d), path)
    return spark.read.schema("step long, stage string, count long, step_conversion_rate double, overall_conversion_rate double").json(path)


_add("A09_json_sink", _json, ENTRIES["D19_conversion_funnel"].sql)

_add("B01_trim_text", lambda s, d: C.trim_text(X.raw_behaviors(s, d)).select("behavior_id", "user_id", "behavior_type"),
     _RAW + " SELECT behavior_id, user_id, behavior_type FROM behaviors_raw")


def _flag(name, rule):
    def run(s, d):
        key = key_of(name) or "order_id"
        return C.trim_text(X.raw_tables(s, d)[name]).select(key, rule(name).alias("bad"))
    return run


def _flag_sql(name, expr):
    raw = _RAW_NAME.get(name, f"{name}_raw")
    key = _KEYS.get(name, "order_id")
    return _RAW + f" SELECT {key}, CAST(coalesce({expr}, FALSE) AS BIGINT) AS bad FROM {raw}"


_add("B02_missing_rule", _flag("user_behaviors", C.missing_rule), _flag_sql("user_behaviors", _FLAGS["user_behaviors"][0]))
_add("B03_time_parse_rule", _flag("users", C.time_parse_rule),
     _flag_sql("users", " OR ".join(_when(c) for c in ("register_time", "created_at", "updated_at"))))
_add("B04_rebuild_date_hour",
     lambda s, d: C.rebuild_date_hour(X.raw_behaviors(s, d)).select("behavior_id", "event_time", "event_date", "event_hour"),
     _RAW + """ SELECT behavior_id, event_time, coalesce(strftime(try_cast(event_time AS TIMESTAMP), '%Y-%m-%d'), event_date) AS event_date,
 coalesce(CAST(extract('hour' FROM try_cast(event_time AS TIMESTAMP)) AS VARCHAR), event_hour) AS event_hour FROM behaviors_raw""")
_add("B05_enum_rule", _flag("user_behaviors", C.enum_rule), _flag_sql("user_behaviors", """behavior_type NOT IN ('pv','click','collect','cart','buy')
 OR device_type NOT IN ('mobile','pc','tablet') OR channel NOT IN ('organic','search','ads','campaign','recommendation')"""))
_add("B06_bounds_rule", _flag("users", C.bounds_rule), _flag_sql("users", _num("age", "{n} < 18 OR {n} > 60")))
_add("B06_bounds_rule_lines", _flag("order_items", C.bounds_rule), _flag_sql("order_items", _num("quantity", "{n} <= 0")))
_add("B07_numeric_coercion", lambda s, d: C.numeric(X.raw_items(s, d), ["price", "stock"]).select("item_id", "price", "stock"),
     _RAW + " SELECT item_id, try_cast(price AS DOUBLE) AS price, try_cast(stock AS DOUBLE) AS stock FROM items_raw")
_add("B08_deduplicate", lambda s, d: C.deduplicate(C.trim_text(X.raw_users(s, d)), "user_id"),
     _RAW + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY user_id, age NULLS FIRST, gender NULLS FIRST,
 city NULLS FIRST, register_time, created_at, updated_at) AS rn FROM users_raw) SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
_add("B08_deduplicate_rows", lambda s, d: C.deduplicate(X.raw_order_items(s, d), None), _RAW + " SELECT DISTINCT * FROM order_items_raw")


def _references(s, d):
    known = {"users": X.raw_users(s, d), "items": X.raw_items(s, d)}
    flagged = C.flag_references(C.trim_text(X.raw_behaviors(s, d)), "user_behaviors", known)
    return flagged.select("behavior_id", "user_id", "item_id", F.col("_fk_user_id").alias("bad_user"), F.col("_fk_item_id").alias("bad_item"))


_add("B09_reference_rule", _references, _RAW + """ SELECT behavior_id, user_id, item_id,
 CAST(user_id NOT IN (SELECT user_id FROM users_raw) AS BIGINT) AS bad_user, CAST(item_id NOT IN (SELECT item_id FROM items_raw) AS BIGINT) AS bad_item
 FROM behaviors_raw""")
_add("B10_self_reference", lambda s, d: C.flag_references(X.raw_categories(s, d), "categories", {"categories": X.raw_categories(s, d)})
     .select("category_id", "parent_id", F.col("_fk_parent_id").alias("bad")), _RAW + """ SELECT category_id, parent_id,
 CAST(parent_id IS NOT NULL AND parent_id NOT IN (SELECT category_id FROM categories_raw) AS BIGINT) AS bad FROM categories_raw""")
_add("B11_time_rule", lambda s, d: C.flag_times(C.trim_text(X.raw_behaviors(s, d)), "user_behaviors", C.trim_text(X.raw_users(s, d)), DATA_END)
     .select("behavior_id", F.col("_early").alias("early"), F.col("_late").alias("late")),
     _RAW + f""", r AS (SELECT user_id, min(try_cast(register_time AS TIMESTAMP)) AS since FROM users_raw GROUP BY 1)
 SELECT behavior_id, CAST(coalesce(try_cast(event_time AS TIMESTAMP) < since, FALSE) AS BIGINT) AS early,
 CAST(coalesce(try_cast(event_time AS TIMESTAMP) > {_END}, FALSE) AS BIGINT) AS late FROM behaviors_raw LEFT JOIN r USING (user_id)""")
_add("B12_kept_rows", lambda s, d: _cleaned(s, d).tables["user_behaviors"].select("behavior_id", "user_id", "item_id", "behavior_type", "event_hour"),
     _ALL + " SELECT behavior_id, user_id, item_id, behavior_type, CAST(extract('hour' FROM try_cast(event_time AS TIMESTAMP)) AS BIGINT) AS event_hour FROM user_behaviors_kept")


def _reconcile(s, d):
    from ..sources.worlds import order_world
    w = order_world(s, d)
    return C.reconcile_orders(w.orders, w.order_items).select("order_id", "user_id", "total_amount", "corrected")


_add("B13_reconcile_orders", _reconcile, """WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, o_custkey AS user_id, CASE WHEN t IS NOT NULL AND t <> round(o_totalprice, 2) THEN t ELSE o_totalprice END AS total_amount,
 CAST(t IS NOT NULL AND t <> round(o_totalprice, 2) AS BIGINT) AS corrected FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
_add("B14_quality_report", lambda s, d: _cleaned(s, d).report(), _ALL + " " + " UNION ALL ".join(_report_sql(n) for n in LOAD_ORDER))
_add("B14_quality_summary", lambda s, d: C.quality_summary(_cleaned(s, d).report()),
     _ALL + ", report AS (" + " UNION ALL ".join(_report_sql(n) for n in LOAD_ORDER) + """)
 SELECT CAST(sum(source_rows) AS BIGINT) AS total_rows, CAST(sum(duplicates) AS BIGINT) AS duplicate_rows, CAST(sum(missing) AS BIGINT) AS missing_rows,
 CAST(sum(illegal) AS BIGINT) AS invalid_rows, CAST(sum(final_rows) AS BIGINT) AS final_rows FROM report""")
_add("B15_event_time_range", lambda s, d: C.event_time_range(_cleaned(s, d).tables["user_behaviors"]).select(
    F.date_format("first_time", "yyyy-MM-dd HH:mm:ss").alias("first_time"), F.date_format("last_time", "yyyy-MM-dd HH:mm:ss").alias("last_time")),
    _ALL + """ SELECT strftime(min(try_cast(event_time AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(max(try_cast(event_time AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS last_time FROM user_behaviors_kept""")
