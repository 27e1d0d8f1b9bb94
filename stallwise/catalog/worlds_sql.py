"""SQL twins of the derived shop tables, used as the head of every check query."""

_SHARED = """WITH behaviors AS (
  SELECT event_id AS behavior_id, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'pv' WHEN 'purchase' THEN 'buy' ELSE event_type END AS behavior_type,
         ts AS event_time, CAST(ts AS DATE) AS event_date, CAST(extract('hour' FROM ts) AS INTEGER) AS event_hour,
         CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'pc' ELSE 'tablet' END AS device_type,
         CASE event_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'search' WHEN 2 THEN 'ads' WHEN 3 THEN 'campaign'
              ELSE 'recommendation' END AS channel
  FROM events),
w_users AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_custkey % 11 <> 0 THEN 18 + c_custkey % 43 END AS age,
         CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' END AS gender,
         CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS city,
         TIMESTAMP '2023-12-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER))
           + to_hours(CAST(c_custkey % 24 AS INTEGER)) AS register_time
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
w_items AS (
  SELECT p_partkey AS item_id, p_name AS item_name, p_type AS category_id, p_brand AS brand,
         p_retailprice AS price, p_size AS stock, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END AS status,
         TIMESTAMP '2023-11-01 00:00:00' + to_days(CAST(p_partkey % 90 AS INTEGER))
           + to_hours(CAST(p_partkey % 24 AS INTEGER)) AS created_at
  FROM part),
w_categories AS (
  SELECT 'R' || r_regionkey AS category_id, r_name AS category_name, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL
  SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation)"""

_EVENT = """,
w_orders AS (
  SELECT event_id AS order_id, user_id, ts AS order_time, value AS total_amount,
         CASE WHEN event_id % 10 < 8 THEN 'paid' WHEN event_id % 10 = 8 THEN 'cancelled' ELSE 'refunded' END AS status
  FROM events WHERE event_type = 'purchase'),
w_lines AS (
  SELECT event_id AS order_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
         CAST(1 AS BIGINT) AS quantity, value AS unit_price, value AS amount
  FROM events WHERE event_type = 'purchase')"""

_ORDER = """,
w_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_time, o_totalprice AS total_amount,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'cancelled' ELSE 'refunded' END AS status
  FROM orders),
w_lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / l_quantity AS unit_price, l_extendedprice AS amount
  FROM lineitem)"""

EVENT_HEAD = _SHARED + _EVENT
ORDER_HEAD = _SHARED + _ORDER
