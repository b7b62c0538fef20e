"""Exploratory aggregates at order grain (rate tables, distributions,
temporal, transit, correlation, KPIs).

Common-scan reuse is explicit: the ten rate tables are one ``groupingSets``
pass, and per-field statistics run over one ``unpivot`` instead of one scan per
field.  Quantiles are exact (``shipcast.functions.prefix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipcast.functions.rounding import dround

from shipcast.functions.comoments import co_moments
from shipcast.functions.prefix import exact_quantiles

# Categorical dimensions of the rate tables, in report order
# (the reference's Order Country maps to order_city on the test tables).
CATEGORICAL_DIMS = [
    "shipping_mode", "market", "order_region", "customer_segment", "category_name",
    "department_name", "order_status", "order_city", "payment_type", "delivery_status",
]
# Numeric fields of the EDA selector.
NUMERIC_FIELDS = [
    "sales", "order_item_total", "profit", "quantity", "discount", "discount_rate",
    "profit_ratio", "product_price", "scheduled_days", "real_days", "n_items",
    "distance_km", "daily_order_volume",
]
# Fields of the correlation matrix (target last).
CORRELATION_FIELDS = [
    "scheduled_days", "discount", "discount_rate", "product_price", "quantity", "sales",
    "order_item_total", "profit", "profit_ratio", "n_items", "distance_km",
    "daily_order_volume", "late_delivery_risk",
]
TARGET = "late_delivery_risk"
PROFIT = "profit"
MIN_SUPPORT = 200


def pct(c) -> F.Column:
    return dround(100 * c, 2)


def target_summary(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(TARGET).cast("bigint").alias("late_count"),
        (F.count(F.lit(1)) - F.sum(TARGET)).cast("bigint").alias("ontime_count"),
        pct(F.avg(TARGET)).alias("late_rate"),
    )


def rate_table(orders: DataFrame, dims: Sequence[str] = CATEGORICAL_DIMS) -> DataFrame:
    """Orders, late %, mean and total profit per level of every dimension, in
    one grouping-sets aggregation."""
    dims = [d for d in dims if d in orders.columns]
    proj = orders.select(*[F.col(d).cast("string").alias(d) for d in dims], TARGET, PROFIT)
    g = proj.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("__gid"),
        F.count(F.lit(1)).alias("orders"),
        pct(F.avg(TARGET)).alias("late_rate"),
        dround(F.avg(PROFIT), 2).alias("avg_profit"),
        dround(F.sum(PROFIT), 4).alias("total_profit"),
    )
    n = len(dims)
    dim_name = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # all bits set except this dim's
        dim_name = F.when(F.col("__gid") == gid, F.lit(d)).otherwise(dim_name)
        level = F.when(F.col("__gid") == gid, F.col(d)).otherwise(level)
    return g.select(
        dim_name.alias("dimension"), level.alias("level"), "orders", "late_rate", "avg_profit", "total_profit"
    ).where(F.col("level").isNotNull())


def _long_numeric(orders: DataFrame, fields: Sequence[str]) -> DataFrame:
    fields = [f for f in fields if f in orders.columns]
    return orders.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot(
        [], fields, "field", "value"
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))


def describe_numeric(orders: DataFrame, fields: Sequence[str] = NUMERIC_FIELDS) -> DataFrame:
    long = _long_numeric(orders, fields)
    basic = long.groupBy("field").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["field"], names=["q1", "median", "q3"])
    return basic.join(qs.drop("n"), "field").select(
        "field",
        "count",
        *[dround(c, 3).alias(c) for c in ["mean", "median", "std", "min", "max", "q1", "q3"]],
    )


def histogram(orders: DataFrame, fields: Sequence[str] = NUMERIC_FIELDS, bins: int = 40) -> DataFrame:
    """Equal-width bins on values clipped to the 0.1% / 99.9% quantiles.

    Values are first rounded to 9 dp so a bin edge never depends on the last
    bit of a floating-point aggregate."""
    long = _long_numeric(orders, fields).withColumn("value", dround("value", 9))
    qs = exact_quantiles(long, "value", [0.001, 0.999], ["field"], names=["qlo", "qhi"])
    mm = long.groupBy("field").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    rng = qs.join(mm, "field").select(
        "field",
        F.when(F.col("qlo") == F.col("qhi"), F.col("vmin")).otherwise(F.col("qlo")).alias("lo0"),
        F.when(F.col("qlo") == F.col("qhi"), F.when(F.col("vmax") != 0, F.col("vmax")).otherwise(F.lit(1.0)))
        .otherwise(F.col("qhi"))
        .alias("hi0"),
    )
    # numpy widens a zero-width range by 0.5 on both sides
    rng = rng.select(
        "field",
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    clipped = F.least(F.greatest(F.col("value"), F.col("lo")), F.col("hi"))
    b = F.least(F.floor((clipped - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = (
        long.join(F.broadcast(rng), "field")  # one row per field
        .groupBy("field", b.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = rng.select("field", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, ["field", "bin"], "left").select(
        "field",
        "bin",
        dround(F.col("lo") + F.col("bin") * width, 3).alias("edge_lo"),
        dround(F.col("lo") + (F.col("bin") + 1) * width, 3).alias("edge_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def boxplot(orders: DataFrame, fields: Sequence[str] = NUMERIC_FIELDS) -> DataFrame:
    long = _long_numeric(orders, fields)
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["field"], names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = qs.select("field", "q1", "median", "q3", (F.col("q1") - 1.5 * iqr).alias("flo"), (F.col("q3") + 1.5 * iqr).alias("fhi"))
    inside = (F.col("value") >= F.col("flo")) & (F.col("value") <= F.col("fhi"))
    agg = long.join(F.broadcast(fences), "field").groupBy("field", "q1", "median", "q3", "flo", "fhi").agg(  # one row per field
        F.min(F.when(inside, F.col("value"))).alias("imin"),
        F.max(F.when(inside, F.col("value"))).alias("imax"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return agg.select(
        "field",
        dround("q1", 3).alias("q1"),
        dround("median", 3).alias("median"),
        dround("q3", 3).alias("q3"),
        dround(F.coalesce("imin", "flo"), 3).alias("lower"),
        dround(F.coalesce("imax", "fhi"), 3).alias("upper"),
        F.col("n_outliers").cast("bigint").alias("n_outliers"),
    )


def profit_by_late(orders: DataFrame) -> DataFrame:
    med = exact_quantiles(orders, PROFIT, [0.5], [TARGET], names=["median_profit"])
    base = orders.groupBy(TARGET).agg(F.avg(PROFIT).alias("avg_profit"), F.count(F.lit(1)).alias("orders"))
    return base.join(med.drop("n"), TARGET).select(
        F.when(F.col(TARGET) == 0, "On time").otherwise("Late").alias("level"),
        dround("avg_profit", 2).alias("avg_profit"),
        dround("median_profit", 2).alias("median_profit"),
        "orders",
    )


def monthly_trend(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            pct(F.avg(TARGET)).alias("late_rate"),
            dround(F.sum(PROFIT), 4).alias("profit"),
        )
    )


def date_coverage(orders: DataFrame) -> DataFrame:
    per_year = orders.groupBy(F.year("order_date").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.array_join(F.array_sort(F.collect_set(F.month("order_date"))).cast("array<string>"), ",").alias("months_present"),
        F.date_format(F.min("order_date"), "yyyy-MM-dd").alias("year_min"),
        F.date_format(F.max("order_date"), "yyyy-MM-dd").alias("year_max"),
    )
    w = Window.partitionBy(F.lit(0))
    return per_year.select(
        F.col("year").cast("bigint").alias("year"),
        "orders",
        F.min("year_min").over(w).alias("date_min"),
        F.max("year_max").over(w).alias("date_max"),
        (F.col("year") == F.max("year").over(w)).alias("is_final_year"),
        F.when(F.col("year") == F.max("year").over(w), F.col("months_present")).alias("months_present"),
    )


def mode_transit(orders: DataFrame, mode_col: str = "shipping_mode") -> DataFrame:
    med = exact_quantiles(orders, "real_days", [0.5], [mode_col], names=["actual_median"], bounded=True)
    base = orders.groupBy(mode_col).agg(
        F.count(F.lit(1)).alias("orders"),
        pct(F.avg(TARGET)).alias("late_rate"),
        F.avg("real_days").alias("actual_mean"),
        F.stddev_samp("real_days").alias("actual_std"),
        F.max("scheduled_days").cast("bigint").alias("promised"),
    )
    return base.join(med.drop("n"), mode_col).select(
        F.col(mode_col).alias("mode"),
        "orders",
        "late_rate",
        dround("actual_mean", 3).alias("actual_mean"),
        dround("actual_std", 3).alias("actual_std"),
        dround("actual_median", 3).alias("actual_median"),
        "promised",
    )


def transit_distribution(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("shipping_mode", "real_days").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shipping_mode")
    return counts.select(
        F.col("shipping_mode").alias("mode"),
        F.col("real_days").cast("bigint").alias("days"),
        "n",
        dround(100 * F.col("n") / F.sum("n").over(w), 2).alias("share"),
    )


def correlation_matrix(orders: DataFrame, fields: Sequence[str] = CORRELATION_FIELDS) -> DataFrame:
    """All Pearson pairs (pairwise complete), long form, both triangles, from
    one pass of co-moments; null where a column does not vary."""
    fields = [f for f in fields if f in orders.columns]
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i:]]
    found = co_moments(orders, fields).withColumn("c", F.try_divide(F.col("sp"), F.sqrt("ss_a") * F.sqrt("ss_b")))
    grid = orders.sparkSession.createDataFrame(pairs, "var_a string, var_b string")
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c")))
    both = grid.join(found, ["var_a", "var_b"], "left").select(
        F.inline(F.array_distinct(F.array(F.struct("var_a", "var_b", "c"), F.struct(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "c"))))
    )
    return both.select("var_a", "var_b", dround(F.when(~F.isnan("c"), c), 4).alias("correlation"))


def correlation_top(corr_long: DataFrame, target: str = TARGET, k: int | None = None) -> DataFrame:
    """Every variable ranked from both ends; ``k`` keeps the first of each."""
    with_t = corr_long.where((F.col("var_a") == target) & (F.col("var_b") != target) & F.col("correlation").isNotNull())
    hi = Window.partitionBy(F.lit(0)).orderBy(F.desc("correlation"), "var_b")
    lo = Window.partitionBy(F.lit(0)).orderBy(F.asc("correlation"), "var_b")
    ranked = with_t.select(
        F.col("var_b").alias("variable"),
        "correlation",
        F.row_number().over(hi).alias("rank_pos"),
        F.row_number().over(lo).alias("rank_neg"),
    )
    first = lambda c: F.lit(True) if k is None else F.col(c) <= k
    pos = ranked.where(first("rank_pos")).select(F.lit("positive").alias("direction"), F.col("rank_pos").alias("rank"), "variable", "correlation")
    neg = ranked.where(first("rank_neg")).select(F.lit("negative").alias("direction"), F.col("rank_neg").alias("rank"), "variable", "correlation")
    return pos.unionByName(neg).withColumn("rank", F.col("rank").cast("bigint"))


def segment_top(rates: DataFrame, k: int | None = None, min_orders: int = MIN_SUPPORT, by: str = "late_rate") -> DataFrame:
    """Levels with at least ``min_orders`` orders, ranked per dimension; ``k`` keeps the first."""
    w = Window.partitionBy("dimension").orderBy(F.desc(by), F.desc("orders"), "level")
    return (
        rates.where(F.col("orders") >= min_orders)
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .where(F.lit(True) if k is None else F.col("rank") <= k)
    )


def riskiest_level(rates: DataFrame, min_orders: int = MIN_SUPPORT) -> DataFrame:
    dims = ["market", "order_region", "category_name", "customer_segment"]
    key_hi = F.struct(F.col("late_rate"), F.col("orders"), F.col("level"))
    risky = (
        rates.where(F.col("dimension").isin(dims) & (F.col("orders") >= min_orders))
        .groupBy("dimension")
        .agg(F.max_by("level", key_hi).alias("level"), F.max("late_rate").alias("late_rate"))
        .select(F.concat(F.lit("worst_"), F.col("dimension")).alias("item"), "level", "late_rate")
    )
    modes = rates.where(F.col("dimension") == "shipping_mode").agg(
        F.max_by("level", F.struct("late_rate", F.col("level"))).alias("worst"),
        F.max("late_rate").alias("worst_rate"),
        F.min_by("level", F.struct("late_rate", F.col("level"))).alias("best"),
        F.min("late_rate").alias("best_rate"),
    )
    mode_rows = modes.select(F.lit("worst_mode").alias("item"), F.col("worst").alias("level"), F.col("worst_rate").alias("late_rate")).unionByName(
        modes.select(F.lit("best_mode").alias("item"), F.col("best").alias("level"), F.col("best_rate").alias("late_rate"))
    )
    return risky.unionByName(mode_rows)


def profit_vs_late(orders: DataFrame) -> DataFrame:
    corr = orders.agg(F.corr(F.col(PROFIT), F.col(TARGET).cast("double")).alias("c"))
    med = exact_quantiles(orders, PROFIT, [0.5], [TARGET], names=["median_profit"])
    groups = orders.groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("orders"), F.avg(PROFIT).alias("mean_profit"), F.sum(PROFIT).alias("total_profit")
    ).join(med.drop("n"), TARGET)
    # the reference subtracts the two means after rounding them to 3 dp
    m3 = dround("mean_profit", 3)
    diff = groups.agg(
        (F.max(F.when(F.col(TARGET) == 0, m3)) - F.max(F.when(F.col(TARGET) == 1, m3))).alias("d")
    )
    return groups.select(
        F.when(F.col(TARGET) == 1, "Late").otherwise("On time").alias("status"),
        "orders",
        dround("mean_profit", 3).alias("mean_profit"),
        dround("median_profit", 3).alias("median_profit"),
        dround("total_profit", 4).alias("total_profit"),
        dround(corr.select("c").scalar(), 5).alias("correlation"),
        dround(diff.select("d").scalar(), 3).alias("mean_difference"),
    )
