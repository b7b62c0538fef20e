"""Exploratory aggregates with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.operators import eda
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import orders_frame

T = eda.TARGET


def _num_src(f: str) -> str:
    return f"(SELECT CAST({f} AS DOUBLE) AS v FROM ord WHERE {f} IS NOT NULL AND NOT isnan(CAST({f} AS DOUBLE)))"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@query(
    "target_summary",
    with_base(
        f"SELECT count(*) AS n_orders, CAST(sum({T}) AS BIGINT) AS late_count, "
        f"CAST(count(*) - sum({T}) AS BIGINT) AS ontime_count, round(100 * avg({T}), 2) AS late_rate FROM ord"
    ),
)
def q_target_summary(spark, sf_dir):
    return eda.target_summary(orders_frame(spark, sf_dir))


RATE_SQL_BODY = _union(
    [
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, count(*) AS orders, "
        f"round(100 * avg({T}), 2) AS late_rate, round(avg(profit), 2) AS avg_profit, "
        f"round(sum(profit), 4) AS total_profit FROM ord WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in eda.CATEGORICAL_DIMS
    ]
)
RATE_CTE = f"rates AS ({RATE_SQL_BODY})"


@query("rate_table", with_base("SELECT * FROM rates", RATE_CTE))
def q_rate_table(spark, sf_dir):
    return eda.rate_table(orders_frame(spark, sf_dir))


@query(
    "describe_numeric",
    with_base(
        _union(
            [
                f"SELECT '{f}' AS field, count(v) AS count, round(avg(v), 3) AS mean, round(median(v), 3) AS median, "
                f"round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max, "
                f"round(quantile_cont(v, 0.25), 3) AS q1, round(quantile_cont(v, 0.75), 3) AS q3 FROM {_num_src(f)}"
                for f in eda.NUMERIC_FIELDS
            ]
        )
    ),
)
def q_describe_numeric(spark, sf_dir):
    return eda.describe_numeric(orders_frame(spark, sf_dir))


def _hist_sql(f: str) -> str:
    return f"""SELECT * FROM (WITH v AS (SELECT round(v, 9) AS v FROM {_num_src(f)}),
r0 AS (SELECT CASE WHEN qlo = qhi THEN vmin ELSE qlo END AS lo0,
  CASE WHEN qlo = qhi THEN (CASE WHEN vmax <> 0 THEN vmax ELSE 1.0 END) ELSE qhi END AS hi0
  FROM (SELECT quantile_cont(v, 0.001) AS qlo, quantile_cont(v, 0.999) AS qhi, min(v) AS vmin, max(v) AS vmax FROM v)),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
c AS (SELECT least(floor((least(greatest(v, lo), hi) - lo) / (hi - lo) * 40), 39) AS bin, count(*) AS cnt FROM v, r GROUP BY 1)
SELECT '{f}' AS field, CAST(b.bin AS BIGINT) AS bin, round(lo + b.bin * ((hi - lo) / 40), 3) AS edge_lo,
  round(lo + (b.bin + 1) * ((hi - lo) / 40), 3) AS edge_hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM r, (SELECT range AS bin FROM range(40)) b LEFT JOIN c ON c.bin = b.bin)"""


@query("histogram", with_base(_union([_hist_sql(f) for f in eda.NUMERIC_FIELDS])))
def q_histogram(spark, sf_dir):
    return eda.histogram(orders_frame(spark, sf_dir)).withColumn("bin", F.col("bin").cast("bigint"))


def _box_sql(f: str) -> str:
    return f"""SELECT * FROM (WITH v AS {_num_src(f)},
q AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM v),
fe AS (SELECT q1, med, q3, q1 - 1.5 * (q3 - q1) AS flo, q3 + 1.5 * (q3 - q1) AS fhi FROM q)
SELECT '{f}' AS field, round(q1, 3) AS q1, round(med, 3) AS median, round(q3, 3) AS q3,
  round(coalesce(min(CASE WHEN v >= flo AND v <= fhi THEN v END), flo), 3) AS lower,
  round(coalesce(max(CASE WHEN v >= flo AND v <= fhi THEN v END), fhi), 3) AS upper,
  CAST(sum(CASE WHEN v >= flo AND v <= fhi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM v, fe GROUP BY q1, med, q3, flo, fhi)"""


@query("boxplot", with_base(_union([_box_sql(f) for f in eda.NUMERIC_FIELDS])))
def q_boxplot(spark, sf_dir):
    return eda.boxplot(orders_frame(spark, sf_dir))


@query(
    "profit_by_late",
    with_base(
        f"SELECT CASE WHEN {T} = 0 THEN 'On time' ELSE 'Late' END AS level, round(avg(profit), 2) AS avg_profit, "
        f"round(median(profit), 2) AS median_profit, count(*) AS orders FROM ord GROUP BY {T}"
    ),
)
def q_profit_by_late(spark, sf_dir):
    return eda.profit_by_late(orders_frame(spark, sf_dir))


@query(
    "monthly_trend",
    with_base(
        f"SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders, round(100 * avg({T}), 2) AS late_rate, "
        "round(sum(profit), 4) AS profit FROM ord GROUP BY 1"
    ),
)
def q_monthly_trend(spark, sf_dir):
    return eda.monthly_trend(orders_frame(spark, sf_dir))


@query(
    "date_coverage",
    with_base(
        "SELECT CAST(y.year AS BIGINT) AS year, y.orders, g.date_min, g.date_max, (y.year = g.maxy) AS is_final_year, "
        "CASE WHEN y.year = g.maxy THEN y.months_present END AS months_present FROM "
        "(SELECT year(order_date) AS year, count(*) AS orders, "
        "array_to_string(list_sort(list_distinct(list(month(order_date)))), ',') AS months_present FROM ord GROUP BY 1) y, "
        "(SELECT strftime(min(order_date), '%Y-%m-%d') AS date_min, strftime(max(order_date), '%Y-%m-%d') AS date_max, "
        "max(year(order_date)) AS maxy FROM ord) g"
    ),
)
def q_date_coverage(spark, sf_dir):
    return eda.date_coverage(orders_frame(spark, sf_dir))


@query(
    "mode_transit",
    with_base(
        f"SELECT shipping_mode AS mode, count(*) AS orders, round(100 * avg({T}), 2) AS late_rate, "
        "round(avg(real_days), 3) AS actual_mean, round(stddev_samp(real_days), 3) AS actual_std, "
        "round(median(real_days), 3) AS actual_median, CAST(max(scheduled_days) AS BIGINT) AS promised "
        "FROM ord GROUP BY shipping_mode"
    ),
)
def q_mode_transit(spark, sf_dir):
    return eda.mode_transit(orders_frame(spark, sf_dir))


@query(
    "transit_distribution",
    with_base(
        "SELECT shipping_mode AS mode, CAST(real_days AS BIGINT) AS days, count(*) AS n, "
        "round(100 * count(*) / sum(count(*)) OVER (PARTITION BY shipping_mode), 2) AS share "
        "FROM ord GROUP BY shipping_mode, real_days"
    ),
)
def q_transit_distribution(spark, sf_dir):
    return eda.transit_distribution(orders_frame(spark, sf_dir))


_CF = eda.CORRELATION_FIELDS
_PAIRS = [(a, b) for a in _CF for b in _CF]
CORR_CTE = (
    "corr_wide AS (SELECT "
    + ", ".join(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS "{a}|{b}"' for a, b in _PAIRS)
    + " FROM ord), corr_long AS (SELECT split_part(pair, '|', 1) AS var_a, split_part(pair, '|', 2) AS var_b, "
    "round(CASE WHEN isnan(c) THEN NULL ELSE c END, 4) AS correlation FROM "
    "corr_wide UNPIVOT INCLUDE NULLS (c FOR pair IN ("
    + ", ".join(f'"{a}|{b}"' for a, b in _PAIRS)
    + ")))"
)


@query("correlation_matrix", with_base("SELECT * FROM corr_long", CORR_CTE))
def q_correlation_matrix(spark, sf_dir):
    return eda.correlation_matrix(orders_frame(spark, sf_dir))


@query(
    "correlation_top",
    with_base(
        "SELECT direction, CAST(rank AS BIGINT) AS rank, variable, correlation FROM ("
        "SELECT 'positive' AS direction, row_number() OVER (ORDER BY correlation DESC, var_b) AS rank, var_b AS variable, correlation FROM t "
        "UNION ALL SELECT 'negative', row_number() OVER (ORDER BY correlation ASC, var_b), var_b, correlation FROM t)",
        CORR_CTE + f", t AS (SELECT * FROM corr_long WHERE var_a = '{T}' AND var_b <> '{T}' AND correlation IS NOT NULL)",
    ),
)
def q_correlation_top(spark, sf_dir):
    return eda.correlation_top(eda.correlation_matrix(orders_frame(spark, sf_dir)))


@query(
    "segment_top",
    with_base(
        "SELECT dimension, level, orders, late_rate, avg_profit, total_profit, rank FROM ("
        "SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY late_rate DESC, orders DESC, level) AS BIGINT) AS rank "
        "FROM rates WHERE orders >= 200)",
        RATE_CTE,
    ),
)
def q_segment_top(spark, sf_dir):
    return eda.segment_top(eda.rate_table(orders_frame(spark, sf_dir)))


# Dimensions and lengths of the segment charts.
SEGMENT_CHARTS = {"shipping_mode": 10, "market": 10, "order_region": 12, "category_name": 12}


@query(
    "segment_charts",
    with_base(
        "SELECT ranked_by, dimension, level, orders, late_rate, avg_profit, rank FROM ("
        + _union(
            [
                f"SELECT '{by}' AS ranked_by, *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY {by} DESC, orders DESC, level) AS BIGINT) AS rank "
                "FROM rates WHERE orders >= 200"
                for by in ("late_rate", "orders")
            ]
        )
        + ") WHERE "
        + " OR ".join(f"(dimension = '{d}' AND rank <= {n})" for d, n in SEGMENT_CHARTS.items()),
        RATE_CTE,
    ),
)
def q_segment_charts(spark, sf_dir):
    """The first levels of every charted dimension, by late rate and by orders."""
    rates = eda.rate_table(orders_frame(spark, sf_dir), list(SEGMENT_CHARTS))
    shown = F.create_map(*[F.lit(x) for pair in SEGMENT_CHARTS.items() for x in pair])
    parts = [eda.segment_top(rates, by=by).where(F.col("rank") <= shown[F.col("dimension")]).withColumn("ranked_by", F.lit(by)) for by in ("late_rate", "orders")]
    return parts[0].unionByName(parts[1]).select("ranked_by", "dimension", "level", "orders", "late_rate", "avg_profit", "rank")


@query(
    "riskiest_level",
    with_base(
        "SELECT 'worst_' || dimension AS item, level, late_rate FROM ("
        "SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY late_rate DESC, orders DESC, level DESC) AS rk "
        "FROM rates WHERE orders >= 200 AND dimension IN ('market', 'order_region', 'category_name', 'customer_segment')) WHERE rk = 1 "
        "UNION ALL SELECT 'worst_mode', level, late_rate FROM (SELECT *, row_number() OVER (ORDER BY late_rate DESC, level DESC) AS rk "
        "FROM rates WHERE dimension = 'shipping_mode') WHERE rk = 1 "
        "UNION ALL SELECT 'best_mode', level, late_rate FROM (SELECT *, row_number() OVER (ORDER BY late_rate ASC, level ASC) AS rk "
        "FROM rates WHERE dimension = 'shipping_mode') WHERE rk = 1",
        RATE_CTE,
    ),
)
def q_riskiest_level(spark, sf_dir):
    return eda.riskiest_level(eda.rate_table(orders_frame(spark, sf_dir)))


@query(
    "profit_vs_late",
    with_base(
        f"SELECT CASE WHEN {T} = 1 THEN 'Late' ELSE 'On time' END AS status, orders, round(mp, 3) AS mean_profit, "
        "round(med, 3) AS median_profit, round(tp, 4) AS total_profit, round(cc.c, 5) AS correlation, "
        "round(dd.d, 3) AS mean_difference FROM g, cc, dd",
        f"g AS (SELECT {T}, count(*) AS orders, avg(profit) AS mp, median(profit) AS med, sum(profit) AS tp FROM ord GROUP BY {T}), "
        f"cc AS (SELECT corr(profit, CAST({T} AS DOUBLE)) AS c FROM ord), "
        f"dd AS (SELECT max(CASE WHEN {T} = 0 THEN round(mp, 3) END) - max(CASE WHEN {T} = 1 THEN round(mp, 3) END) AS d FROM g)",
    ),
)
def q_profit_vs_late(spark, sf_dir):
    return eda.profit_vs_late(orders_frame(spark, sf_dir))
