"""DuckDB text of the canonical tables, used as CTEs by every oracle query.

``LINES`` is FIXTURES.md §3 (plus ``profit_ratio``); ``ORDERS`` mirrors
``order_rollup`` + ``engineer_features``.  Oracle queries are written as
``WITH <BASE> SELECT ...``.
"""

LINES = """
ship AS (SELECT l_orderkey AS ok, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT orders.*, abs(datediff('day', o_orderdate, first_ship)) AS d,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Same Day' WHEN '2' THEN 'First Class'
         WHEN '3' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
    (o_orderstatus = 'P' AND o_orderkey % 10 = 0) AS cancelled
  FROM orders JOIN ship ON ok = o_orderkey),
o2 AS (
  SELECT o.*,
    CAST(CASE shipping_mode WHEN 'Same Day' THEN 0 WHEN 'First Class' THEN 1 WHEN 'Second Class' THEN 2 ELSE 4 END AS INT) AS scheduled_days,
    CAST(CASE shipping_mode WHEN 'Same Day' THEN d % 2 WHEN 'First Class' THEN 2 ELSE 2 + d % 5 END AS INT) AS real_days
  FROM o),
lines AS (
SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, l_suppkey AS supplier_id,
  l_linenumber AS line_number, o_orderdate AS order_date, shipping_mode, scheduled_days, real_days,
  CAST(CASE WHEN NOT cancelled AND real_days > scheduled_days THEN 1 ELSE 0 END AS INT) AS late_delivery_risk,
  CASE WHEN cancelled THEN 'Shipping canceled' WHEN real_days > scheduled_days THEN 'Late delivery' ELSE 'Shipping on time' END AS delivery_status,
  o_orderstatus AS order_status, concat('TYPE_', CAST(o_orderkey % 4 AS VARCHAR)) AS payment_type,
  r_name AS market, n_name AS order_region, concat('CITY_', CAST(o_custkey % 97 AS VARCHAR)) AS order_city, c_mktsegment AS customer_segment,
  p_type AS department_name, p_brand AS category_name, p_name AS product_name,
  l_quantity AS quantity, l_extendedprice AS sales, l_discount AS discount_rate,
  l_extendedprice * l_discount AS discount, l_extendedprice * (1 - l_discount) AS order_item_total,
  p_retailprice AS product_price,
  l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
  (l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice) / NULLIF(l_extendedprice * (1 - l_discount), 0) AS profit_ratio,
  CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST((n_nationkey * 13) % 360 - 180 AS DOUBLE) AS longitude,
  CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS order_zipcode
FROM o2 JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""

ROLLUP = """
ord0 AS (
  SELECT order_id,
    round(sum(sales), 4) AS sales, round(sum(order_item_total), 4) AS order_item_total, round(sum(profit), 4) AS profit,
    round(sum(discount), 4) AS discount, round(sum(quantity), 4) AS quantity,
    round(sum(discount_rate), 4) / count(discount_rate) AS discount_rate,
    round(sum(profit_ratio), 10) / count(profit_ratio) AS profit_ratio,
    round(sum(product_price), 4) / count(product_price) AS product_price,
    max(shipping_mode) AS shipping_mode, max(scheduled_days) AS scheduled_days, max(real_days) AS real_days,
    max(delivery_status) AS delivery_status, max(late_delivery_risk) AS late_delivery_risk,
    max(payment_type) AS payment_type, max(order_status) AS order_status, max(market) AS market,
    max(order_region) AS order_region, max(order_city) AS order_city, max(customer_segment) AS customer_segment,
    max(customer_id) AS customer_id, max(latitude) AS latitude, max(longitude) AS longitude,
    max(order_date) AS order_date,
    count(*) AS n_items, count(DISTINCT product_id) AS n_distinct_products,
    first(category_name ORDER BY sales DESC, line_number, product_id, supplier_id, quantity, discount_rate) AS category_name,
    first(department_name ORDER BY sales DESC, line_number, product_id, supplier_id, quantity, discount_rate) AS department_name
  FROM lines GROUP BY order_id)
"""


def features_sql(src: str, name: str) -> str:
    """Feature CTE ``name`` over CTE ``src`` (mirror of ``engineer_features``)."""
    return f"""
{name}_c AS (
  SELECT *, year(order_date) AS order_year, month(order_date) AS order_month,
    isodow(order_date) - 1 AS order_dayofweek, hour(order_date) AS order_hour,
    quarter(order_date) AS order_quarter,
    CASE WHEN isodow(order_date) - 1 >= 5 THEN 1 ELSE 0 END AS order_is_weekend
  FROM {src}),
{name} AS (
  SELECT *,
    sin(2 * pi() * order_month / 12) AS month_sin, cos(2 * pi() * order_month / 12) AS month_cos,
    sin(2 * pi() * order_dayofweek / 7) AS dow_sin, cos(2 * pi() * order_dayofweek / 7) AS dow_cos,
    CAST(count(*) OVER (PARTITION BY CAST(order_date AS DATE)) AS DOUBLE) AS daily_order_volume,
    coalesce(discount / NULLIF(sales, 0), 0) AS discount_depth,
    coalesce(sales / NULLIF(quantity, 0), 0) AS unit_value,
    ln(1 + greatest(product_price, 0)) AS log_product_price,
    ln(1 + greatest(order_item_total, 0)) AS log_order_value,
    2 * 6371.0 * asin(sqrt(least(greatest(
      pow(sin((radians(latitude) - radians((SELECT median(latitude) FROM {src}))) / 2), 2)
      + cos(radians((SELECT median(latitude) FROM {src}))) * cos(radians(latitude))
        * pow(sin((radians(longitude) - radians((SELECT median(longitude) FROM {src}))) / 2), 2),
      0), 1))) AS distance_km
  FROM {name}_c)
"""


BASE = LINES + "," + ROLLUP + "," + features_sql("ord0", "ord")


def with_base(body: str, extra: str = "") -> str:
    """``WITH lines, ord0, ord[, extra] <body>``."""
    ctes = BASE + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"
