"""Report tables, KPIs, mode share and scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.functions.rounding import dround
from shipcast.operators import decision as D
from shipcast.operators import eda
from shipcast.operators import metrics as M
from shipcast.operators import reporting as R
from shipcast.operators import stats as S
from shipcast.operators.cleaning import filter_cancelled
from shipcast.plans import q_decision as QD
from shipcast.plans import q_eda as QE
from shipcast.plans import q_leakage as QL
from shipcast.plans import q_metrics as QM
from shipcast.plans import q_stats as QS
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import MODES, lines, orders_frame

MODE_RATES_CTE = QE.RATE_CTE + ", mrates AS (SELECT level AS mode, orders, late_rate, avg_profit, total_profit FROM rates WHERE dimension = 'shipping_mode')"


def _mode_rates(o):
    return eda.rate_table(o, ["shipping_mode"]).select(
        F.col("level").alias("mode"), "orders", "late_rate", "avg_profit", "total_profit"
    )


@query(
    "mode_share",
    with_base(
        "SELECT r.mode, r.orders, round(100.0 * r.orders / sum(r.orders) OVER (), 2) AS order_share, r.late_rate, "
        "CAST(p.promised_days AS BIGINT) AS promised_days, p.mean_transit, r.avg_profit, r.total_profit FROM mrates r LEFT JOIN prof p ON p.mode = r.mode",
        QD.BASE_CTE + ", " + MODE_RATES_CTE,
    ),
)
def q_mode_share(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    from pyspark.sql import Window

    r = _mode_rates(o)
    p = D.mode_profile(o).select("mode", F.col("promised_days").cast("bigint").alias("promised_days"), "mean_transit")
    w = Window.partitionBy(F.lit(0))
    return r.join(p, "mode", "left").select(
        "mode", "orders", dround(100.0 * F.col("orders") / F.sum("orders").over(w), 2).alias("order_share"), "late_rate",
        "promised_days", "mean_transit", "avg_profit", "total_profit",
    )


@query(
    "kpis",
    with_base(
        "SELECT count(*) AS n_orders, round(100 * avg(late_delivery_risk), 2) AS late_rate, round(avg(profit), 3) AS mean_profit, "
        "round(median(profit), 3) AS median_profit, round(sum(profit), 4) AS total_profit, "
        "(SELECT flagged_pct FROM sweep WHERE threshold = 0.5) AS flagged_pct_050, round(avg(order_item_total), 3) AS avg_order_value FROM ord",
        QM.SWEEP_CTE,
    ),
)
def q_kpis(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    sweep = M.threshold_sweep(QM.eval_frame(spark, sf_dir), "p_full", "late_delivery_risk")
    flagged = sweep.where(F.col("threshold") == 0.5).select("flagged_pct").scalar()
    med = eda.exact_quantiles(o, "profit", [0.5], names=["m"]).select("m").scalar()
    return o.agg(
        F.count(F.lit(1)).alias("n_orders"),
        dround(100 * F.avg("late_delivery_risk"), 2).alias("late_rate"),
        dround(F.avg("profit"), 3).alias("mean_profit"),
        dround(F.sum("profit"), 4).alias("total_profit"),
        dround(F.avg("order_item_total"), 3).alias("avg_order_value"),
    ).withColumns({"median_profit": dround(med, 3), "flagged_pct_050": flagged})


SCORED_COLS = [
    "order_id", "product_id", "supplier_id", "line_number", "shipping_mode", "order_item_total", "profit", "market",
    "order_region", "customer_segment", "department_name", "category_name", "late_delivery_risk",
]
_P_NAMES = {k: f"p_late__{m.split()[0].lower()}" for m, k in D.KEY_OF.items()}
_SCORED_SQL_COLS = ", ".join(
    [c for c in SCORED_COLS] + [f"round(p_{k}, 6) AS {n}" for k, n in _P_NAMES.items()] + ["round(p_full, 6) AS p_late_current"]
)


def _scored(spark, sf_dir):
    df = QM.eval_frame(spark, sf_dir)
    return df.select(
        *SCORED_COLS, *[dround(f"p_{k}", 6).alias(n) for k, n in _P_NAMES.items()], dround("p_full", 6).alias("p_late_current")
    )


@query("scored_table", with_base(f"SELECT {_SCORED_SQL_COLS} FROM etest", QM.EVAL_CTE))
def q_scored_table(spark, sf_dir):
    return _scored(spark, sf_dir)


#: share of orders, by hash, that the sampled table holds
SAMPLE_SHARE = 0.25


@query(
    "scored_sample",
    with_base(
        f"SELECT {_SCORED_SQL_COLS} FROM etest WHERE ((order_id % 1000003) * 7919 + 42) % 1000003 < {SAMPLE_SHARE} * 1000003",
        QM.EVAL_CTE,
    ),
)
def q_scored_sample(spark, sf_dir):
    df = QM.eval_frame(spark, sf_dir)
    return (
        df.where(D.seeded_order(F.col("order_id")) < SAMPLE_SHARE * 1000003)
        .select(*SCORED_COLS, *[dround(f"p_{k}", 6).alias(n) for k, n in _P_NAMES.items()], dround("p_full", 6).alias("p_late_current"))
    )


# ------------------------------------------------------------------ exports
_STAT_COLS = ["factor", "type", "test", "statistic", "dof", "p_value", "p_display", "effect_size", "effect_name", "effect_label", "n", "significant"]


@query("export_statistics", with_base(f"SELECT {', '.join(_STAT_COLS)} FROM fam", QS.ALL_CTE))
def q_export_statistics(spark, sf_dir):
    return QS.test_family(spark, sf_dir).select(*_STAT_COLS)


@query(
    "export_shipping_mode",
    with_base(
        "SELECT p.mode, p.orders, p.late_rate, CAST(p.promised_days AS BIGINT) AS promised_days, p.mean_transit, p.median_transit, p.std_transit, "
        "r.orders AS orders_all, r.late_rate AS late_rate_pct_all, r.avg_profit, r.total_profit FROM prof p LEFT JOIN mrates r ON r.mode = p.mode",
        QD.BASE_CTE + ", " + MODE_RATES_CTE,
    ),
)
def q_export_shipping_mode(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    r = _mode_rates(o).select(
        "mode", F.col("orders").alias("orders_all"), F.col("late_rate").alias("late_rate_pct_all"), "avg_profit", "total_profit"
    )
    p = D.mode_profile(o).select(
        "mode", "orders", "late_rate", F.col("promised_days").cast("bigint").alias("promised_days"), "mean_transit", "median_transit", "std_transit"
    )
    return p.join(r, "mode", "left")


_SHARE = {m: f"share_{m.split()[0].lower()}" for m in MODES}


@query(
    "export_decision",
    with_base(
        "SELECT c.policy, c.total_cost, c.avg_cost, c.expected_late_rate, c.n_modes_used, c.saving_vs_best_single, c.saving_pct, c.rank, "
        + ", ".join(f"coalesce(round(x.{n}, 4), 0.0) AS {n}" for n in _SHARE.values())
        + " FROM cmp c LEFT JOIN (SELECT policy, "
        + ", ".join(f"sum(CASE WHEN mode = '{m}' THEN n_rows END) / sum(n_rows) AS {n}" for m, n in _SHARE.items())
        + " FROM ch GROUP BY policy) x ON x.policy = c.policy",
        QD.BASE_CTE + ", " + QD.costed_cte([QD._scen("default", QD.DEFAULT)]) + ", " + QD.choices_cte() + ", " + QD.SUMMARY_CTE,
    ),
)
def q_export_decision(spark, sf_dir):
    _, rows, prof = QD._rows(spark, sf_dir)
    ch = D.evaluate(rows, prof, [D.scenario_struct("default", QD.DEFAULT)])
    cmp = D.policy_compare(ch)
    mix = ch.groupBy("policy").pivot("mode", MODES).agg(F.sum("n_rows"))
    tot = ch.groupBy("policy").agg(F.sum("n_rows").alias("__n"))
    shares = mix.join(tot, "policy").select(
        "policy", *[F.coalesce(dround(F.col(f"`{m}`") / F.col("__n"), 4), F.lit(0.0)).alias(n) for m, n in _SHARE.items()]
    )
    return cmp.join(shares, "policy", "left").select(
        "policy", "total_cost", "avg_cost", "expected_late_rate", "n_modes_used", "saving_vs_best_single", "saving_pct", "rank", *_SHARE.values()
    )


@query("export_break_even", QD._break_even_sql(QD.DEFAULT))
def q_export_break_even(spark, sf_dir):
    _, rows, prof = QD._rows(spark, sf_dir)
    return D.break_even(prof, QD._median_value_col(rows), QD.DEFAULT)


@query("export_eda", with_base("SELECT * FROM rates", QE.RATE_CTE))
def q_export_eda(spark, sf_dir):
    return eda.rate_table(orders_frame(spark, sf_dir))


@query(
    "executive_summary",
    with_base(
        "SELECT 'headline' AS section, 'n_orders' AS item, CAST(count(*) AS VARCHAR) AS value FROM ord UNION ALL "
        "SELECT 'headline', 'late_rate_pct', CAST(round(100 * avg(late_delivery_risk), 2) AS VARCHAR) FROM ord UNION ALL "
        "SELECT 'headline', 'n_tests', CAST(max(n_tests) AS VARCHAR) FROM fam UNION ALL "
        "SELECT 'headline', 'n_significant', CAST(max(n_significant) AS VARCHAR) FROM fam UNION ALL "
        "SELECT 'headline', 'n_material', CAST(max(n_material) AS VARCHAR) FROM fam UNION ALL "
        "SELECT 'worst_level', 'worst_' || dimension, level FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY late_rate DESC, orders DESC, level DESC) AS rk "
        "FROM rates WHERE orders >= 200 AND dimension IN ('market', 'order_region', 'category_name', 'customer_segment')) WHERE rk = 1 UNION ALL "
        "SELECT 'mode', 'worst_mode', arg_max(level, (late_rate, level)) FROM rates WHERE dimension = 'shipping_mode' UNION ALL "
        "SELECT 'mode', 'best_mode', arg_min(level, (late_rate, level)) FROM rates WHERE dimension = 'shipping_mode' UNION ALL "
        "SELECT 'policy', 'baseline_policy', policy FROM cmp WHERE letter = 'A' UNION ALL "
        "SELECT 'policy', 'baseline_avg_cost', printf('%.3f', avg_cost) FROM cmp WHERE letter = 'A' UNION ALL "
        "SELECT 'policy', 'best_avg_cost', printf('%.3f', avg_cost) FROM cmp WHERE rank = 1 UNION ALL "
        "SELECT 'policy', 'best_policy', policy FROM cmp WHERE rank = 1 UNION ALL "
        "SELECT 'policy', 'best_saving_pct', CAST(saving_pct AS VARCHAR) FROM cmp WHERE rank = 1 UNION ALL "
        "SELECT 'drivers', 'material_factor_' || CAST(rank AS VARCHAR), factor FROM fam WHERE significant AND effect_size >= 0.10 UNION ALL "
        "SELECT 'recommendation', 'align_second_class_promise', printf('%.0f points, %d orders', 100 * round(l_sec - l_std, 4), o_sec) FROM pw "
        "WHERE abs(t_sec - t_std) < 0.05 UNION ALL "
        "SELECT 'recommendation', 'adopt_best_policy', printf('%s: %.3f to %.3f an order, late rate %.1f to %.1f %%', b.policy, a.avg_cost, b.avg_cost, "
        "100 * a.expected_late_rate, 100 * b.expected_late_rate) FROM cmp a, cmp b WHERE a.letter = 'A' AND b.rank = 1 AND b.saving_pct > 0 UNION ALL "
        "SELECT 'recommendation', 'review_commitment_of_worst_mode', printf('%s: %.1f %% late', arg_max(level, (late_rate, level)), max(late_rate)) "
        "FROM rates WHERE dimension = 'shipping_mode'",
        QS.ALL_CTE + ", " + QE.RATE_CTE + ", " + QD.BASE_CTE + ", " + QD.costed_cte([QD._scen("default", QD.DEFAULT)]) + ", " + QD.choices_cte() + ", " + QD.SUMMARY_CTE,
    ),
)
def q_executive_summary(spark, sf_dir):
    return R.summary(_findings(spark, sf_dir))


def _findings(spark, sf_dir, **more):
    o = orders_frame(spark, sf_dir)
    _, rows, prof = QD._rows(spark, sf_dir)
    return R.findings(
        o,
        rates=eda.rate_table(o, ["shipping_mode", *R.WORST_LEVELS]),
        family=QS.test_family(spark, sf_dir),
        policies=D.policy_compare(D.evaluate(rows, prof, [D.scenario_struct("default", QD.DEFAULT)])),
        promise=D.promise_redesign(prof),
        one_by_one=True,
        **more,
    )


@query("executive_summary_model")
def q_executive_summary_model(spark, sf_dir):
    """The summary with what the models add: the permutation drivers and what
    is left to predict without the shipping mode."""
    from shipcast.plans import q_ml

    perm = q_ml.q_permutation_importance(spark, sf_dir)
    return R.summary(_findings(spark, sf_dir, importance=perm, ablation=q_ml.q_ablation(spark, sf_dir)))


@query(
    "monitoring_baseline",
    with_base(
        "SELECT 'late_rate' AS metric, round(avg(late_delivery_risk), 4) AS value FROM ord UNION ALL "
        "SELECT 'n_features', CAST(count(*) AS DOUBLE) FROM (" + QL.FULL_FEATURES_SQL + ") UNION ALL "
        "SELECT 'n_modes', CAST(count(DISTINCT shipping_mode) AS DOUBLE) FROM ord UNION ALL "
        "SELECT 'mean_profit', round(avg(profit), 4) FROM ord UNION ALL "
        "SELECT 'roc_auc', round(roc_auc, 4) FROM eauc WHERE model = 'full' UNION ALL "
        "SELECT 'brier', round(avg((p_full - late_delivery_risk) * (p_full - late_delivery_risk)), 4) FROM etest WHERE p_full IS NOT NULL",
        QM.EVAL_CTE + ", " + QL.FLAGS_CTE,
    ),
)
def q_monitoring_baseline(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    ev = QM.eval_frame(spark, sf_dir)
    sums = [a for c in ("late_delivery_risk", "profit") for a in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]

    def mean(c):
        return dround(F.sum(f"s_{c}") / F.sum(f"n_{c}"), 4)

    def in_rows(one_row, *names):
        return one_row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))

    # one scan of the orders: sums per mode, then of the modes
    by_mode = o.groupBy("shipping_mode").agg(*sums)
    of_orders = by_mode.agg(
        mean("late_delivery_risk").alias("late_rate"), F.count("shipping_mode").alias("n_modes"), mean("profit").alias("mean_profit")
    )
    features = QL.q_feature_select(spark, sf_dir).where(F.col("variant") == "full").agg(F.count("*").alias("n_features"))
    auc = M.roc_auc(M.score_counts(ev, "p_full", "late_delivery_risk")).select(dround("roc_auc", 4).alias("roc_auc"))
    brier = ev.agg(dround(F.avg((F.col("p_full") - F.col("late_delivery_risk")) ** 2), 4).alias("brier"))
    return (
        in_rows(of_orders, "late_rate", "n_modes", "mean_profit")
        .union(in_rows(features, "n_features"))
        .union(in_rows(auc, "roc_auc"))
        .union(in_rows(brier, "brier"))
    )
