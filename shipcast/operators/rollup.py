"""Order-grain roll-up of the line table.

One ``groupBy(order_id)``: every aggregate is partial-aggregable, so a hot
order is combined map-side before the shuffle.  Invariant columns use ``max``
(deterministic; equal to ``first`` when the value truly is constant per order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipcast.functions.rounding import dround

SUM_COLS = ["sales", "order_item_total", "profit", "discount", "quantity"]
MEAN_COLS = ["discount_rate", "profit_ratio", "product_price"]
INVARIANT_COLS = [
    "shipping_mode", "scheduled_days", "real_days", "delivery_status", "late_delivery_risk",
    "payment_type", "order_status", "market", "order_region", "order_city", "customer_segment",
    "customer_id", "latitude", "longitude", "order_date",
]


def dominant_line_key(df: DataFrame):
    """Highest sales first; ties go to the smallest line key (deterministic)."""
    return F.struct(-F.col("sales"), "line_number", "product_id", "supplier_id", "quantity", "discount_rate")


# Money columns carry at most 4 decimals; summing doubles in a different order
# changes the last bit, so sums are rounded back to 4 dp (the exact decimal).
# Ratios are not decimal data and keep 10 dp.
SUM_DP = {"profit_ratio": 10}


def exact_sum(c: str):
    return dround(F.sum(c), SUM_DP.get(c, 4))


def order_rollup(lines: DataFrame) -> DataFrame:
    tie = dominant_line_key(lines)
    present = set(lines.columns)
    aggs = (
        [exact_sum(c).alias(c) for c in SUM_COLS if c in present]
        + [F.try_divide(exact_sum(c), F.count(c)).alias(c) for c in MEAN_COLS if c in present]
        + [F.max(c).alias(c) for c in INVARIANT_COLS if c in present]
        + [
            F.count(F.lit(1)).alias("n_items"),
            F.min_by("category_name", tie).alias("category_name"),
            F.min_by("department_name", tie).alias("department_name"),
        ]
    )
    main = lines.groupBy("order_id").agg(*aggs)
    # distinct products as a separate hash aggregation on numeric keys: a
    # distinct aggregate inside the text-buffer aggregate above would add a
    # second sort-based level; both sides end hash-partitioned by order_id,
    # so the join adds no exchange
    products = (
        lines.where(F.col("product_id").isNotNull())
        .groupBy("order_id", "product_id")
        .agg(F.count(F.lit(1)).alias("__c"))
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n_distinct_products"))
    )
    return main.join(products, "order_id", "left").withColumn(
        "n_distinct_products", F.coalesce(F.col("n_distinct_products"), F.lit(0)).cast("bigint")
    )


def grain_check(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lines per order and, per column, the orders where it is not constant."""
    cols = columns or [c for c in INVARIANT_COLS if c in lines.columns]
    # "more than one distinct value" == min < max: no distinct-aggregate expand
    per_order = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"), *[(F.min(c) < F.max(c)).alias(c) for c in cols]
    )
    summary = per_order.agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("n_lines").alias("n_lines"),
        *[F.count_if(F.col(c)).alias(c) for c in cols],
    )
    stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
    return summary.selectExpr(
        "n_orders",
        "n_lines",
        f"stack({len(cols)}, {stacked}) AS (column, orders_varying)",
    ).select(
        "column",
        F.col("orders_varying").cast("bigint").alias("orders_varying"),
        F.col("n_orders").cast("bigint").alias("n_orders"),
        F.col("n_lines").cast("bigint").alias("n_lines"),
        dround(F.col("n_lines") / F.col("n_orders"), 4).alias("lines_per_order"),
    )
