"""Sources, adapter and order-grain roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.functions.rounding import dround

from shipcast.operators import rollup
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import lines, orders_frame

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S"

LINE_COLS = [
    "order_id", "customer_id", "product_id", "supplier_id", "line_number", "shipping_mode",
    "scheduled_days", "real_days", "late_delivery_risk", "delivery_status", "order_status",
    "payment_type", "market", "order_region", "order_city", "customer_segment", "department_name",
    "category_name", "product_name", "quantity", "sales", "discount_rate", "discount",
    "order_item_total", "product_price", "profit", "profit_ratio", "latitude", "longitude",
    "order_zipcode",
]


@query(
    "scan_parquet",
    with_base(
        f"SELECT {', '.join(LINE_COLS)}, strftime(order_date, '{TS_FMT_DUCK}') AS order_date FROM lines"
    ),
)
def q_scan_parquet(spark, sf_dir):
    return lines(spark, sf_dir).select(*LINE_COLS, F.date_format("order_date", TS_FMT_SPARK).alias("order_date"))


ROLLUP_NUM = rollup.SUM_COLS + rollup.MEAN_COLS
ROLLUP_KEEP = [c for c in rollup.INVARIANT_COLS if c not in ("order_date", "latitude", "longitude")]


@query(
    "order_rollup",
    with_base(
        "SELECT order_id, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in rollup.SUM_COLS)
        + ", "
        + ", ".join(f"round({c}, 6) AS {c}" for c in rollup.MEAN_COLS)
        + ", "
        + ", ".join(ROLLUP_KEEP)
        + ", latitude, longitude, n_items, "
        + f"strftime(order_date, '{TS_FMT_DUCK}') AS order_date FROM ord0"
    ),
)
def q_order_rollup(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    return o.select(
        "order_id",
        *[dround(c, 4).alias(c) for c in rollup.SUM_COLS],
        *[dround(c, 6).alias(c) for c in rollup.MEAN_COLS],
        *ROLLUP_KEEP,
        "latitude",
        "longitude",
        "n_items",
        F.date_format("order_date", TS_FMT_SPARK).alias("order_date"),
    )


@query(
    "order_distinct_products",
    with_base("SELECT order_id, n_items, n_distinct_products FROM ord0"),
)
def q_order_distinct_products(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", "n_items", "n_distinct_products")


@query(
    "order_dominant",
    with_base("SELECT order_id, category_name, department_name FROM ord0"),
)
def q_order_dominant(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", "category_name", "department_name")


_GRAIN_COLS = rollup.INVARIANT_COLS
_grain_sql = with_base(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(v_{c} AS BIGINT) AS orders_varying, CAST(n_orders AS BIGINT) AS n_orders, "
        f"CAST(n_lines AS BIGINT) AS n_lines, round(n_lines / n_orders, 4) AS lines_per_order FROM gsum"
        for c in _GRAIN_COLS
    ),
    "gper AS (SELECT order_id, count(*) AS n_lines, "
    + ", ".join(f"min({c}) < max({c}) AS v_{c}" for c in _GRAIN_COLS)
    + " FROM lines GROUP BY order_id), gsum AS (SELECT count(*) AS n_orders, sum(n_lines) AS n_lines, "
    + ", ".join(f"count_if(v_{c}) AS v_{c}" for c in _GRAIN_COLS)
    + " FROM gper)",
)


@query("grain_check", _grain_sql)
def q_grain_check(spark, sf_dir):
    return rollup.grain_check(lines(spark, sf_dir), _GRAIN_COLS)
