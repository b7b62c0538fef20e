"""Model-evaluation queries.

The evaluated scores are SQL-computable (train late rates by mode x market,
by mode, by market), so every metric has an oracle; the Spark ML models feed
the same functions (see ``shipcast.operators.ml``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.functions.lookup import lookup
from shipcast.functions.rounding import dround
from shipcast.operators import metrics as M
from shipcast.operators.cleaning import filter_cancelled
from shipcast.operators.decision import KEY_OF, current_p, not_cancelled, sql_scores, split_flag
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import lines, orders_frame

SPLIT = "(((order_id * 7919 + 42) % 10007) % 100 < 20)"
ROW_SPLIT = "((((order_id * 31 + product_id) * 31 + supplier_id) * 31 + line_number) % 10007) % 100 < 20"
TIME_CUTOFF = "1998-01-01"
MODELS = ["full", "mode_only", "market_only"]
LOOKUP = [0.0, 0.333, 0.5, 0.555, 0.95, 1.2]

_CURP = "CASE l.shipping_mode " + " ".join(f"WHEN '{m}' THEN s.p_{k}" for m, k in KEY_OF.items()) + " END"
EVAL_CTE = (
    "otrain AS (SELECT * FROM ord WHERE delivery_status <> 'Shipping canceled' AND NOT " + SPLIT + "), "
    "cells AS (SELECT shipping_mode, market, avg(late_delivery_risk) AS p FROM otrain GROUP BY 1, 2), "
    "pmode AS (SELECT shipping_mode, avg(late_delivery_risk) AS p_mode_only FROM otrain GROUP BY 1), "
    "pmarket AS (SELECT market, avg(late_delivery_risk) AS p_market_only FROM otrain GROUP BY 1), "
    "mk AS (SELECT DISTINCT market FROM ord WHERE delivery_status <> 'Shipping canceled'), "
    "sgrid AS (SELECT mk.market, m.shipping_mode FROM mk, (VALUES " + ", ".join(f"('{m}')" for m in KEY_OF) + ") m(shipping_mode)), "
    "scores AS (SELECT g.market, " + ", ".join(
        f"max(CASE WHEN g.shipping_mode = '{m}' THEN coalesce(c.p, a.p_mode_only) END) AS p_{k}" for m, k in KEY_OF.items()
    ) + " FROM sgrid g LEFT JOIN cells c ON c.shipping_mode = g.shipping_mode AND c.market = g.market "
    "LEFT JOIN pmode a ON a.shipping_mode = g.shipping_mode GROUP BY g.market), "
    "etest AS (SELECT l.*, " + ", ".join(f"s.p_{k}" for k in KEY_OF.values()) + ", " + _CURP + " AS p_full, pm.p_mode_only, pk.p_market_only "
    "FROM lines l LEFT JOIN scores s ON s.market = l.market LEFT JOIN pmode pm ON pm.shipping_mode = l.shipping_mode "
    "LEFT JOIN pmarket pk ON pk.market = l.market WHERE l.delivery_status <> 'Shipping canceled' AND " + SPLIT.replace("order_id", "l.order_id") + "), "
    "elong AS (SELECT 'full' AS model, p_full AS score, late_delivery_risk AS y FROM etest UNION ALL "
    "SELECT 'mode_only', p_mode_only, late_delivery_risk FROM etest UNION ALL SELECT 'market_only', p_market_only, late_delivery_risk FROM etest), "
    "ecnt AS (SELECT model, CAST(score AS DOUBLE) AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM elong "
    "WHERE score IS NOT NULL GROUP BY 1, 2), "
    "easc AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg FROM ecnt), "
    "eauc AS (SELECT model, sum(pos * (cneg + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM easc GROUP BY model), "
    "edesc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, CAST(row_number() OVER w AS BIGINT) AS position, "
    "sum(pos) OVER (PARTITION BY model) AS pp, sum(neg) OVER (PARTITION BY model) AS nn, count(*) OVER (PARTITION BY model) AS n_scores FROM ecnt "
    "WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), "
    "eap AS (SELECT model, sum(CASE WHEN pos > 0 THEN pos / pp * tp / (tp + fp) ELSE 0.0 END) AS pr_auc FROM edesc GROUP BY model)"
)


def eval_frame(spark, sf_dir):
    """Held-out lines with the three SQL scores, written once per session."""
    from shipcast.sources.materialize import materialized

    return materialized(spark, "eval_frame", sf_dir, lambda: _eval_frame(spark, sf_dir))


def _eval_frame(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    train = not_cancelled(o).where(~split_flag(F.col("order_id")))
    pm = train.groupBy("shipping_mode").agg(F.avg("late_delivery_risk").alias("p_mode_only"))
    pk = train.groupBy("market").agg(F.avg("late_delivery_risk").alias("p_market_only"))
    test = filter_cancelled(lines(spark, sf_dir)).where(split_flag(F.col("order_id")))
    df = lookup(lookup(lookup(test, sql_scores(o), ["market"]), pm, ["shipping_mode"]), pk, ["market"])
    return df.withColumn("p_full", current_p(df))


def _long(df):
    return df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score"), F.col("late_delivery_risk").alias("y")) for m in MODELS]
            )
        )
    )


def _counts(spark, sf_dir):
    return M.score_counts(_long(eval_frame(spark, sf_dir)), "score", "y", ["model"])


@query(
    "split_group",
    with_base(
        f"SELECT CASE WHEN {SPLIT} THEN 'test' ELSE 'train' END AS side, count(*) AS n_lines, count(DISTINCT order_id) AS n_orders, "
        "round(avg(late_delivery_risk), 4) AS late_rate FROM lines WHERE delivery_status <> 'Shipping canceled' GROUP BY 1"
    ),
)
def q_split_group(spark, sf_dir):
    pop = filter_cancelled(lines(spark, sf_dir))
    return pop.groupBy(F.when(split_flag(F.col("order_id")), "test").otherwise("train").alias("side")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("order_id").alias("n_orders"), dround(F.avg("late_delivery_risk"), 4).alias("late_rate")
    )


@query(
    "split_time",
    with_base(
        f"SELECT CASE WHEN (SELECT count(DISTINCT order_date < TIMESTAMP '{TIME_CUTOFF}') FROM lines WHERE delivery_status <> 'Shipping canceled') < 2 "
        f"THEN CASE WHEN {SPLIT} THEN 'test' ELSE 'train' END "
        f"WHEN order_date < TIMESTAMP '{TIME_CUTOFF}' THEN 'train' ELSE 'test' END AS side, count(*) AS n_lines, "
        "count(DISTINCT order_id) AS n_orders FROM lines WHERE delivery_status <> 'Shipping canceled' GROUP BY 1"
    ),
)
def q_split_time(spark, sf_dir):
    pop = filter_cancelled(lines(spark, sf_dir))
    return pop.groupBy(time_split(pop, TIME_CUTOFF).alias("side")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("order_id").alias("n_orders")
    )


def time_split(pop, cutoff: str):
    """Side of a line by its order date; the group split by order where one
    side would be empty."""
    early = F.col("order_date") < F.lit(cutoff).cast("timestamp_ntz")
    both = pop.agg((F.coalesce(F.bool_or(early), F.lit(False)) & F.coalesce(F.bool_or(~early), F.lit(False))).alias("b")).select("b").scalar()
    return F.when(F.when(both, ~early).otherwise(split_flag(F.col("order_id"))), "test").otherwise("train")


def row_split_flag():
    k = ((F.col("order_id") * 31 + F.col("product_id")) * 31 + F.col("supplier_id")) * 31 + F.col("line_number")
    return (k % 10007) % 100 < 20


@query(
    "split_random",
    with_base(
        f"SELECT CASE WHEN {ROW_SPLIT} THEN 'test' ELSE 'train' END AS side, count(*) AS n_lines FROM lines "
        "WHERE delivery_status <> 'Shipping canceled' GROUP BY 1"
    ),
)
def q_split_random(spark, sf_dir):
    pop = filter_cancelled(lines(spark, sf_dir))
    return pop.groupBy(F.when(row_split_flag(), "test").otherwise("train").alias("side")).agg(F.count(F.lit(1)).alias("n_lines"))


def _conf_sql(tp, fp, tn, fn, with_acc=True):
    r = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0 END"
    sens, spec = r(tp, f"{tp} + {fn}"), r(tn, f"{tn} + {fp}")
    cols = []
    if with_acc:
        cols.append(f"round({r(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')}, 4) AS accuracy")
    cols += [
        f"round({r(tp, f'{tp} + {fp}')}, 4) AS precision", f"round({sens}, 4) AS recall",
        f"round({r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 4) AS f1", f"round({spec}, 4) AS specificity",
        f"round({sens}, 4) AS sensitivity", f"round({sens} + {spec} - 1, 4) AS youden_j",
    ]
    return ", ".join(cols)


@query(
    "eval_metrics",
    with_base(
        "SELECT " + _conf_sql("tp", "fp", "tn", "fn") + ", round((SELECT roc_auc FROM eauc WHERE model = 'full'), 4) AS roc_auc, "
        "round((SELECT pr_auc FROM eap WHERE model = 'full'), 4) AS pr_auc, round(brier, 4) AS brier, 0.5 AS threshold, "
        "CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM "
        "(SELECT CAST(count(*) FILTER (WHERE p_full >= 0.5 AND late_delivery_risk = 1) AS DOUBLE) AS tp, "
        "CAST(count(*) FILTER (WHERE p_full >= 0.5 AND late_delivery_risk = 0) AS DOUBLE) AS fp, "
        "CAST(count(*) FILTER (WHERE p_full < 0.5 AND late_delivery_risk = 0) AS DOUBLE) AS tn, "
        "CAST(count(*) FILTER (WHERE p_full < 0.5 AND late_delivery_risk = 1) AS DOUBLE) AS fn, "
        "avg((p_full - late_delivery_risk) * (p_full - late_delivery_risk)) AS brier FROM etest WHERE p_full IS NOT NULL)",
        EVAL_CTE,
    ),
)
def q_eval_metrics(spark, sf_dir):
    return M.eval_metrics(eval_frame(spark, sf_dir), "p_full", "late_delivery_risk")


@query("roc_auc", with_base("SELECT model, round(roc_auc, 6) AS roc_auc FROM eauc", EVAL_CTE))
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(_counts(spark, sf_dir), ["model"]).select("model", dround("roc_auc", 6).alias("roc_auc"))


@query("average_precision", with_base("SELECT model, round(pr_auc, 6) AS pr_auc FROM eap", EVAL_CTE))
def q_average_precision(spark, sf_dir):
    return M.average_precision(_counts(spark, sf_dir), ["model"]).select("model", dround("pr_auc", 6).alias("pr_auc"))


@query(
    "roc_curve",
    with_base(
        "SELECT model, position, round(threshold, 6) AS threshold, round(fpr, 5) AS fpr, round(tpr, 5) AS tpr FROM ("
        "SELECT model, position, score AS threshold, fp / nn AS fpr, tp / pp AS tpr, n_scores + 1 AS np FROM edesc UNION ALL "
        "SELECT model, CAST(0 AS BIGINT), NULL, 0.0, 0.0, max(n_scores) + 1 FROM edesc GROUP BY model)",
        EVAL_CTE,
    ),
)
def q_roc_curve(spark, sf_dir):
    return M.roc_curve(_counts(spark, sf_dir), ["model"])


@query(
    "pr_curve",
    with_base(
        "SELECT model, position, round(threshold, 6) AS threshold, round(precision, 5) AS precision, round(recall, 5) AS recall FROM ("
        "SELECT model, position, score AS threshold, tp / (tp + fp) AS precision, tp / pp AS recall, n_scores + 1 AS np FROM edesc UNION ALL "
        "SELECT model, CAST(0 AS BIGINT), NULL, 1.0, 0.0, max(n_scores) + 1 FROM edesc GROUP BY model)",
        EVAL_CTE,
    ),
)
def q_pr_curve(spark, sf_dir):
    return M.pr_curve(_counts(spark, sf_dir), ["model"])


@query(
    "youden_point",
    with_base(
        "SELECT model, round(CASE WHEN j > 0 THEN thr END, 4) AS threshold, round(greatest(j, 0.0), 4) AS j, "
        "round(CASE WHEN j > 0 THEN tpr ELSE 0.0 END, 4) AS tpr, round(CASE WHEN j > 0 THEN fpr ELSE 0.0 END, 4) AS fpr FROM ("
        "SELECT model, arg_max(score, (tp / pp - fp / nn, -position)) AS thr, max(tp / pp - fp / nn) AS j, "
        "arg_max(tp / pp, (tp / pp - fp / nn, -position)) AS tpr, arg_max(fp / nn, (tp / pp - fp / nn, -position)) AS fpr FROM edesc GROUP BY model)",
        EVAL_CTE,
    ),
)
def q_youden_point(spark, sf_dir):
    return M.youden_point(_counts(spark, sf_dir), ["model"])


_BUCKET = (
    "least(greatest(CASE WHEN (floor(p_full * 100) + 1) / 100.0 <= p_full THEN floor(p_full * 100) + 1 "
    "WHEN floor(p_full * 100) / 100.0 > p_full THEN floor(p_full * 100) - 1 ELSE floor(p_full * 100) END, 9), 90)"
)
SWEEP_CTE = (
    EVAL_CTE
    + f", sb AS (SELECT {_BUCKET} AS b, CAST(sum(late_delivery_risk) AS DOUBLE) AS pos, CAST(sum(1 - late_delivery_risk) AS DOUBLE) AS neg "
    "FROM etest WHERE p_full IS NOT NULL GROUP BY 1), "
    "sw0 AS (SELECT g.i, coalesce(sum(sb.pos), 0.0) AS tp, coalesce(sum(sb.neg), 0.0) AS fp, (SELECT sum(pos) FROM sb) AS pp, "
    "(SELECT sum(neg) FROM sb) AS nn FROM range(10, 91) g(i) LEFT JOIN sb ON sb.b >= g.i GROUP BY g.i), "
    "sweep AS (SELECT round(i / 100.0, 2) AS threshold, "
    + _conf_sql("tp", "fp", "(nn - fp)", "(pp - tp)", with_acc=False)
    + ", CAST(tp + fp AS BIGINT) AS n_flagged, round(100 * (tp + fp) / (pp + nn), 2) AS flagged_pct, CAST(nn - fp AS BIGINT) AS tn, "
    "CAST(fp AS BIGINT) AS fp, CAST(pp - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM sw0)"
)


@query("threshold_sweep", with_base("SELECT * FROM sweep", SWEEP_CTE))
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(eval_frame(spark, sf_dir), "p_full", "late_delivery_risk")


@query(
    "threshold_lookup",
    with_base(
        "SELECT r.requested, s.* FROM (SELECT requested, round((CASE WHEN abs(b / 100.0 - requested) < abs(a / 100.0 - requested) THEN b ELSE a END) / 100.0, 2) AS t "
        "FROM (SELECT requested, least(greatest(floor(requested * 100), 10), 90) AS a, least(greatest(ceil(requested * 100), 10), 90) AS b FROM "
        "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in LOOKUP) + ") v(requested))) r LEFT JOIN sweep s ON s.threshold = r.t",
        SWEEP_CTE,
    ),
)
def q_threshold_lookup(spark, sf_dir):
    sweep = M.threshold_sweep(eval_frame(spark, sf_dir), "p_full", "late_delivery_risk")
    req = spark.createDataFrame([(float(t),) for t in LOOKUP], "requested double")
    return M.threshold_lookup(sweep, req)


@query(
    "calibration",
    with_base(
        "SELECT CAST(bin AS BIGINT) AS bin, format('{:.1f}-{:.1f}', bin / 10.0, (bin + 1) / 10.0) AS label, round(avg(p_full), 4) AS predicted, "
        "round(avg(late_delivery_risk), 4) AS observed, count(*) AS count FROM (SELECT *, least(greatest(CASE WHEN (floor(p_full * 10) + 1) / 10.0 <= p_full "
        "THEN floor(p_full * 10) + 1 WHEN floor(p_full * 10) / 10.0 > p_full THEN floor(p_full * 10) - 1 ELSE floor(p_full * 10) END, 0), 9) AS bin "
        "FROM etest WHERE p_full IS NOT NULL) GROUP BY bin",
        EVAL_CTE,
    ),
)
def q_calibration(spark, sf_dir):
    return M.calibration(eval_frame(spark, sf_dir), "p_full", "late_delivery_risk")


@query(
    "model_select",
    with_base(
        "SELECT model, round(roc_auc, 4) AS roc_auc, row_number() OVER (ORDER BY round(roc_auc, 4) DESC, CASE model "
        + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS))
        + " END) = 1 AS selected FROM eauc",
        EVAL_CTE,
    ),
)
def q_model_select(spark, sf_dir):
    aucs = M.roc_auc(_counts(spark, sf_dir), ["model"]).select("model", dround("roc_auc", 4).alias("roc_auc"))
    return M.model_select(aucs, MODELS)


REG_CTE = (
    "rtrain AS (SELECT * FROM lines WHERE delivery_status <> 'Shipping canceled' AND NOT " + SPLIT + "), "
    "rcat AS (SELECT category_name, avg(coalesce(profit, 0.0)) AS pred FROM rtrain GROUP BY 1), "
    "rtest AS (SELECT coalesce(l.profit, 0.0) AS y, coalesce(c.pred, (SELECT avg(coalesce(profit, 0.0)) FROM rtrain)) AS f FROM lines l "
    "LEFT JOIN rcat c ON c.category_name = l.category_name WHERE l.delivery_status <> 'Shipping canceled' AND " + SPLIT.replace("order_id", "l.order_id") + ")"
)


@query(
    "regression_metrics",
    with_base(
        "SELECT round(CASE WHEN ss_tot > 0 THEN 1 - ss_res / ss_tot ELSE 0.0 END, 4) AS r2, round(mae, 3) AS mae, round(sqrt(mse), 3) AS rmse, "
        "round(mean_actual, 3) AS mean_actual, round(std_actual, 3) AS std_actual, n_test FROM (SELECT sum((y - f) * (y - f)) AS ss_res, "
        "sum((y - (SELECT avg(y) FROM rtest)) * (y - (SELECT avg(y) FROM rtest))) AS ss_tot, avg(abs(y - f)) AS mae, avg((y - f) * (y - f)) AS mse, "
        "avg(y) AS mean_actual, stddev_pop(y) AS std_actual, count(*) AS n_test FROM rtest)",
        REG_CTE,
    ),
)
def q_regression_metrics(spark, sf_dir):
    pop = filter_cancelled(lines(spark, sf_dir)).withColumn("profit", F.coalesce("profit", F.lit(0.0)))
    train = pop.where(~split_flag(F.col("order_id")))
    test = pop.where(split_flag(F.col("order_id")))
    by_cat = train.groupBy("category_name").agg(F.avg("profit").alias("pred"))
    overall = train.agg(F.avg("profit").alias("m")).select("m").scalar()
    scored = lookup(test, by_cat, ["category_name"]).withColumn("pred", F.coalesce("pred", overall))
    return M.regression_metrics(scored, "profit", "pred")
