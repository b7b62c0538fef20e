"""Modelling queries (SURVEY §2.7 rows marked R, plus the SQL-checkable
design matrix, covariance table and model metadata)."""

from __future__ import annotations

import threading
import uuid

from pyspark.ml import Pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F

from shipcast.functions.rounding import dround
from shipcast.operators import ml as ML
from shipcast.operators.cleaning import HIGH_CARDINALITY_TOP_N, filter_cancelled
from shipcast.operators.decision import not_cancelled, split_flag
from shipcast.operators.features import engineer_features
from shipcast.plans.registry import query
from shipcast.plans.sql_base import features_sql, with_base
from shipcast.sources.adapter import lines, orders_frame

#: what tells one order line from another
LINE_KEY = ["order_id", "product_id", "supplier_id", "line_number", "sales", "quantity", "discount_rate"]
# Features of the test tables' model population.
META_CATEGORICAL = [
    "shipping_mode", "payment_type", "market", "order_region", "order_city", "customer_segment", "department_name", "category_name",
]
META_NUMERIC = [
    "quantity", "sales", "discount_rate", "discount", "order_item_total", "product_price", "latitude", "longitude", "order_year",
    "order_month", "order_dayofweek", "order_quarter", "order_is_weekend", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "daily_order_volume", "discount_depth", "unit_value", "log_product_price", "log_order_value", "distance_km",
]
_LOCK = threading.RLock()
_PREP: dict = {}
_MODELS: dict = {}


def prepared(spark, sf_dir) -> ML.Prepared:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _PREP:
            from shipcast.sources.materialize import materialized

            # the features follow row by row: two passes compute them, no table stores them
            base = ML.model_population(engineer_features(lines(spark, sf_dir)))
            _PREP[key] = ML.pooled_population(
                base, lambda df: materialized(spark, "model_pop", sf_dir, lambda: df)
            )
        return _PREP[key]


def model(spark, sf_dir, name: str, variant: str = "full"):
    """Fitted pipeline, memoised per session (a fit is a Spark job; the
    fitted model is a small driver-side object)."""
    key = (spark.sparkContext.applicationId, sf_dir, name, variant)
    prep = prepared(spark, sf_dir)
    with _key_lock(("model", *key)):
        if key not in _MODELS:
            _MODELS[key] = ML.fit(prep, name, _variant_features(prep, variant))
        return _MODELS[key]


_KEY_LOCKS: dict = {}


def _key_lock(key):
    """One lock per result, so that independent fits run side by side."""
    with _LOCK:
        return _KEY_LOCKS.setdefault(key, threading.RLock())


def _variant_features(prep, variant):
    if variant == "mode_only":
        return ["shipping_mode"]
    if variant == "without_mode":
        return [f for f in prep.features if f != "shipping_mode"]
    return prep.features


_EVALS: dict = {}


def _eval(spark, sf_dir, name, variant="full"):
    """Held-out metrics of one fitted model: a one-row result, kept per
    session so the comparison, ablation and selection queries reuse it."""
    key = (spark.sparkContext.applicationId, sf_dir, name, variant)
    prep = prepared(spark, sf_dir)
    with _key_lock(("eval", *key)):
        if key not in _EVALS:
            feats = _variant_features(prep, variant)
            from shipcast.sources.materialize import materialized

            tag = f"scored_{name.replace(' ', '_').lower()}_{variant}"
            df = ML.evaluate(
                prep, model(spark, sf_dir, name, variant), feats, materialize=lambda d: materialized(spark, tag, sf_dir, lambda: d)
            ).select(
                F.lit(name).alias("model"), F.lit(variant).alias("variant"), "*",
                F.lit(ML.n_trees(model(spark, sf_dir, name, variant).stages[-1])).cast("int").alias("n_trees"),
            )
            _EVALS[key] = (df.schema, df.collect())
        schema, rows = _EVALS[key]
    return spark.createDataFrame(rows, schema)


@query("preprocess")
def q_preprocess(spark, sf_dir):
    prep = prepared(spark, sf_dir)
    train = prep.lines.where(~F.col("is_test"))
    stages = ML.preprocess_stages(prep.numeric, prep.categorical, True, prep.fills)
    slots = ML.feature_slots(Pipeline(stages=stages).fit(train), prep.numeric, prep.categorical)
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(slots)], "slot int, slot_name string, feature string")


@query("train_logistic")
def q_train_logistic(spark, sf_dir):
    return _eval(spark, sf_dir, "Logistic Regression")


@query("train_tree")
def q_train_tree(spark, sf_dir):
    return _eval(spark, sf_dir, "Decision Tree")


@query("train_forest")
def q_train_forest(spark, sf_dir):
    return _eval(spark, sf_dir, "Random Forest")


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    return _eval(spark, sf_dir, "Gradient Boosting")


def _side_by_side(tasks):
    """Short Spark jobs of independent fits share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=6) as pool:
        return list(pool.map(lambda t: _eval(*t), tasks))


def _comparison(spark, sf_dir, variant="full"):
    parts = _side_by_side([(spark, sf_dir, name, variant) for name in ML.MODEL_ORDER])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ML.select_best(out)


@query("export_model_comparison")
def q_export_model_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


FOLDS_SQL = with_base(
    "SELECT order_id, n_lines, n_late, CAST((row_number() OVER (PARTITION BY n_lines, n_late ORDER BY (order_id * 7919 + 42) % 10007, order_id) - 1) % 4 "
    "AS INTEGER) AS fold FROM (SELECT order_id, count(*) AS n_lines, CAST(sum(late_delivery_risk) AS BIGINT) AS n_late FROM lines "
    "WHERE delivery_status <> 'Shipping canceled' AND NOT (((order_id * 7919 + 42) % 10007) % 100 < 20) GROUP BY order_id)"
)


@query("cv_folds", FOLDS_SQL)
def q_cv_folds(spark, sf_dir):
    """The fold of every training order."""
    return ML.order_folds(filter_cancelled(lines(spark, sf_dir)).where(~split_flag(F.col("order_id"))))


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    from shipcast.sources.materialize import materialized

    return ML.cross_validate(
        prepared(spark, sf_dir), ML.MODEL_ORDER, materialize=lambda df: materialized(spark, "model_folds", sf_dir, lambda: df)
    )


@query("ablation")
def q_ablation(spark, sf_dir):
    prep = prepared(spark, sf_dir)
    out = None
    variants = ("full", "mode_only", "without_mode")
    _side_by_side([(spark, sf_dir, name, v) for v in variants for name in reversed(ML.MODEL_ORDER)])
    for variant in variants:
        best = _comparison(spark, sf_dir, variant).where("selected").select(
            F.lit(variant).alias("ablation"), F.lit(len(_variant_features(prep, variant))).alias("n_features"), "model", "roc_auc", "pr_auc", "f1"
        )
        out = best if out is None else out.unionByName(best)
    return out


@query("train_profit")
def q_train_profit(spark, sf_dir):
    return ML.train_profit(prepared(spark, sf_dir))


def _best_name(spark, sf_dir):
    return _comparison(spark, sf_dir).where("selected").first()["model"]


@query("tree_importance")
def q_tree_importance(spark, sf_dir):
    return ML.tree_importance(prepared(spark, sf_dir), model(spark, sf_dir, "Random Forest"))


@query("coef_importance")
def q_coef_importance(spark, sf_dir):
    return ML.coef_importance(prepared(spark, sf_dir), model(spark, sf_dir, "Logistic Regression"))


@query("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """Written once per session (it scores every feature x repeat variant)."""
    from shipcast.sources.materialize import materialized

    best = model(spark, sf_dir, _best_name(spark, sf_dir))
    return materialized(
        spark, "perm_importance", sf_dir,
        lambda: ML.permutation_importance(
            prepared(spark, sf_dir), best,
            materialize=lambda df: materialized(spark, "perm_pairs", sf_dir, lambda: df),
        ),
    )


@query("driver_interpretation")
def q_driver_interpretation(spark, sf_dir):
    from shipcast.plans import q_stats

    perm = q_permutation_importance(spark, sf_dir)
    return ML.driver_interpretation(perm, q_stats.test_family(spark, sf_dir))


@query("export_importance")
def q_export_importance(spark, sf_dir):
    w = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("importance"), "feature"))
    parts = [
        q_permutation_importance(spark, sf_dir).select(F.lit("permutation").alias("method"), "feature", "importance", "importance_std"),
        q_tree_importance(spark, sf_dir).select(F.lit("tree").alias("method"), "feature", "importance"),
        q_coef_importance(spark, sf_dir).select(F.lit("coefficients").alias("method"), "feature", "importance"),
    ]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.withColumn("rank", w)


def _inference_pop(spark, sf_dir):
    return not_cancelled(orders_frame(spark, sf_dir))


@query("logit_inference")
def q_logit_inference(spark, sf_dir):
    return ML.logit_inference(_inference_pop(spark, sf_dir))


@query("odds_ratios")
def q_odds_ratios(spark, sf_dir):
    return ML.odds_ratios(ML.logit_inference(_inference_pop(spark, sf_dir)))


@query("vif")
def q_vif(spark, sf_dir):
    return ML.vif(_inference_pop(spark, sf_dir))


@query("export_diagnostics")
def q_export_diagnostics(spark, sf_dir):
    from shipcast.operators import metrics as M
    from shipcast.plans.q_metrics import eval_frame

    coefs = ML.logit_inference(_inference_pop(spark, sf_dir)).select(F.lit("logistic").alias("section"), "variable", "coef", "std_err", "p_value", "odds_ratio")
    v = ML.vif(_inference_pop(spark, sf_dir)).select(F.lit("vif").alias("section"), "variable", "vif")
    cal = M.calibration(eval_frame(spark, sf_dir), "p_full", "late_delivery_risk").select(
        F.lit("calibration").alias("section"), F.col("label").alias("variable"), "predicted", "observed", "count"
    )
    return coefs.unionByName(v, allowMissingColumns=True).unionByName(cal, allowMissingColumns=True)


# ------------------------------------------------------------- S-checkable
_INF_CTE = "ipop AS (SELECT * FROM ord WHERE delivery_status <> 'Shipping canceled')"


def _design_sql() -> str:
    parts = []
    for c in ML.INFERENCE_CATEGORICAL:
        parts.append(
            f"SELECT '{c}=' || level AS variable, '{c}' AS source, ref AS reference, round(n / tot, 6) AS mean FROM "
            f"(SELECT CAST({c} AS VARCHAR) AS level, count(*) AS n, sum(count(*)) OVER () AS tot FROM ipop WHERE {c} IS NOT NULL GROUP BY 1) x, "
            f"(SELECT arg_min(level, (-n, level)) AS ref FROM (SELECT CAST({c} AS VARCHAR) AS level, count(*) AS n FROM ipop WHERE {c} IS NOT NULL GROUP BY 1)) r "
            "WHERE level <> ref"
        )
    for c in ML.INFERENCE_NUMERIC:
        parts.append(f"SELECT '{c}', '{c}', CAST(NULL AS VARCHAR), round(avg(CAST({c} AS DOUBLE)), 6) FROM ipop")
    return with_base(" UNION ALL ".join(parts), _INF_CTE)


@query("design_matrix", _design_sql())
def q_design_matrix(spark, sf_dir):
    frame, cols, refs = ML.design_matrix(_inference_pop(spark, sf_dir))
    ref_map = {r["column"]: r["reference"] for r in refs.collect()}
    means = frame.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    rows = []
    for c in cols:
        src = c.split("=", 1)[0]
        rows.append((c, src, ref_map.get(src) if "=" in c else None, None if means[c] is None else float(means[c])))
    df = spark.createDataFrame(rows, "variable string, source string, reference string, mean double")
    return df.withColumn("mean", dround("mean", 6))


def _vif_cov_sql() -> str:
    from shipcast.sources.adapter import MODES

    modes = sorted(MODES)
    cols = list(ML.VIF_NUMERIC) + [f"mode={m}" for m in modes] + ["scheduled_days"]
    expr = {c: f"CAST({c} AS DOUBLE)" for c in ML.VIF_NUMERIC}
    expr.update({f"mode={m}": f"CASE WHEN shipping_mode = '{m}' THEN 1.0 ELSE 0.0 END" for m in modes})
    expr["scheduled_days"] = "CAST(scheduled_days AS DOUBLE)"
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    ref = "(SELECT 'mode=' || arg_min(shipping_mode, (-n, shipping_mode)) FROM (SELECT shipping_mode, count(*) AS n FROM ipop GROUP BY 1))"
    body = " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(covar_samp({expr[a]}, {expr[b]}), 6) AS covariance FROM ipop" for a, b in pairs
    )
    return with_base(f"SELECT * FROM ({body}) WHERE var_a <> {ref} AND var_b <> {ref}", _INF_CTE)


@query("vif_covariance", _vif_cov_sql())
def q_vif_covariance(spark, sf_dir):
    frame, cols = ML.vif_inputs(_inference_pop(spark, sf_dir))
    return ML.covariance_table(frame, cols).withColumn("covariance", dround("covariance", 6))


def _metadata_sql() -> str:
    """Model population as text: bucketed and pooled by the training rows."""
    from shipcast.plans.q_quality import _MODEL_POP

    train = "NOT (((order_id * 7919 + 42) % 10007) % 100 < 20)"
    ctes, parts = [features_sql("lines", "lf"), _MODEL_POP, "fpop AS (SELECT * FROM lf WHERE delivery_status <> 'Shipping canceled')"], []
    for c in META_CATEGORICAL:
        level = f"CAST({c} AS VARCHAR)"
        if c in HIGH_CARDINALITY_TOP_N:
            ctes.append(
                f"top_{c} AS (SELECT level FROM (SELECT {level} AS level, count(*) AS n FROM fpop WHERE {train} AND {c} IS NOT NULL GROUP BY 1) "
                f"ORDER BY n DESC, level LIMIT {HIGH_CARDINALITY_TOP_N[c]})"
            )
            level = f"CASE WHEN {level} IN (SELECT level FROM top_{c}) THEN {level} ELSE 'Other' END"
        ctes.append(f"b_{c} AS (SELECT order_id, {level} AS level FROM fpop)")
        ctes.append(
            f"p_{c} AS (SELECT CASE WHEN level IS NULL OR level IN (SELECT level FROM b_{c} WHERE {train} GROUP BY level HAVING count(*) >= 20) "
            f"THEN level ELSE '__rare__' END AS level FROM b_{c})"
        )
        parts.append(
            f"SELECT '{c}' AS feature, 'categorical' AS kind, level, count(*) AS n_rows, "
            f"row_number() OVER (ORDER BY count(*) DESC, level) AS rank, CAST(NULL AS DOUBLE) AS median FROM p_{c} WHERE level IS NOT NULL GROUP BY level"
        )
    for c in META_NUMERIC:
        parts.append(
            f"SELECT '{c}', 'numeric', CAST(NULL AS VARCHAR), count({c}), CAST(NULL AS BIGINT), round(median(CAST({c} AS DOUBLE)), 4) FROM fpop"
        )
    return with_base(" UNION ALL ".join(parts), ", ".join(ctes))


@query("model_metadata", _metadata_sql())
def q_model_metadata(spark, sf_dir):
    """One row per level of a categorical feature, ranked from its most
    frequent one (the default of a request), and one per numeric feature."""
    prep = prepared(spark, sf_dir)
    return ML.model_metadata(prep.lines, prep.numeric, prep.categorical).withColumn("median", dround("median", 4))


def request_defaults(spark, sf_dir):
    """``feature, default, median``: one row per feature."""
    meta = q_model_metadata(spark, sf_dir)
    return meta.where("rank = 1 OR kind = 'numeric'").select("feature", "kind", F.col("level").alias("default"), "median")


# ------------------------------------------------------------- what-if
def _whatif_sql() -> str:
    """Asked fields as given, the others from the model population, then what
    follows from price, quantity and rate."""
    meta = _metadata_sql().rsplit("\n", 1)
    num = {c: f"(SELECT median FROM meta WHERE feature = '{c}')" for c in META_NUMERIC}
    cat = {c: f"(SELECT level FROM meta WHERE feature = '{c}' AND rank = 1)" for c in META_CATEGORICAL}

    def asked(c: str) -> str:
        train = "NOT (((order_id * 7919 + 42) % 10007) % 100 < 20)"
        seen = f"(SELECT CAST({c} AS VARCHAR) FROM fpop WHERE {train} GROUP BY {c} HAVING count(*) >= 20)"
        return f"CASE WHEN CAST({c} AS VARCHAR) IN {seen} THEN CAST({c} AS VARCHAR) ELSE '__rare__' END"

    num |= {"quantity": "quantity", "product_price": "product_price"}
    rate = f"coalesce({num['discount_rate']}, 0)"
    total = "(product_price * quantity - product_price * quantity * rate)"
    num |= {
        "sales": "product_price * quantity", "discount": "product_price * quantity * rate", "order_item_total": total,
        "unit_value": "coalesce(product_price * quantity / nullif(quantity, 0), 0)", "discount_depth": "rate",
        "log_product_price": "ln(1 + greatest(product_price, 0))", "log_order_value": f"ln(1 + greatest({total}, 0))",
    }
    cat |= {c: asked(c) for c in ("shipping_mode", "market")}
    key = "concat_ws('|', " + ", ".join(LINE_KEY) + ")"
    cols = [f"round(CAST({e} AS DOUBLE), 4) AS {c}" for c, e in num.items()] + [f"{e} AS {c}" for c, e in cat.items()]
    return (
        f"{meta[0]}, meta AS ({meta[1]}) SELECT {key} AS request_id, {', '.join(cols)} FROM (SELECT *, {rate} AS rate FROM fpop) "
        "WHERE ((order_id * 7919 + 42) % 10007) % 100 < 20"
    )


@query("whatif_fill", _whatif_sql())
def q_whatif_fill(spark, sf_dir):
    """Requests from every held-out line: mode, market, quantity and price as
    text, plus an unknown key and an unparsable number (both ignored)."""
    from shipcast.operators.whatif import whatif_fill

    prep = prepared(spark, sf_dir)
    test = prep.lines.where(F.col("is_test")).select(
        F.concat_ws("|", *LINE_KEY).alias("request_id"),
        "shipping_mode", "market", "quantity", "product_price",
    )
    req = test.select(
        "request_id",
        F.inline(
            F.array(
                F.struct(F.lit("shipping_mode").alias("key"), F.col("shipping_mode").alias("value")),
                F.struct(F.lit("market").alias("key"), F.col("market").alias("value")),
                F.struct(F.lit("quantity").alias("key"), F.col("quantity").cast("string").alias("value")),
                F.struct(F.lit("product_price").alias("key"), F.col("product_price").cast("string").alias("value")),
                F.struct(F.lit("not_a_feature").alias("key"), F.lit("1").alias("value")),
                F.struct(F.lit("discount_rate").alias("key"), F.lit("n/a").alias("value")),
            )
        ),
    )
    defaults = request_defaults(spark, sf_dir)
    filled = whatif_fill(req, defaults, prep.numeric, prep.categorical)
    return filled.select("request_id", *[dround(c, 4).alias(c) for c in prep.numeric], *prep.categorical)


def _score_modes(best, rows):
    """``p_<mode>`` of the model for every row under every mode, row by row."""
    from shipcast.operators.decision import KEY_OF

    rows = rows.withColumn("actual_mode", F.col("shipping_mode"))
    for m, k in KEY_OF.items():
        kept = [c for c in rows.columns if c != "shipping_mode"]
        rows = best.transform(rows.withColumn("shipping_mode", F.lit(m))).select(*kept, F.lit(m).alias("shipping_mode"), vector_p().alias(f"p_{k}"))
    return rows


#: fields that a filled request derives from price, quantity and discount rate
FOLLOWING = ("sales", "discount", "order_item_total", "unit_value", "discount_depth", "log_product_price", "log_order_value")


def _changed(key: str, new_value, features):
    """A request per line: every feature as text, the named one replaced."""
    return F.inline(
        F.array(*[F.struct(F.lit(c).alias("key"), (new_value if c == key else F.col(c)).cast("string").alias("value")) for c in features])
    )


@query("whatif_delta")
def q_whatif_delta(spark, sf_dir):
    """Held-out lines asked again with twice the quantity: requests are filled,
    dependent fields derived, the selected model scores every mode, and the
    recommendation, its cost and the late risk are compared with before."""
    from shipcast.operators import decision as D
    from shipcast.operators.whatif import whatif_fill
    from shipcast.plans.q_decision import CONSTRAINED
    from shipcast.sources.materialize import materialized

    prep = prepared(spark, sf_dir)
    best = model(spark, sf_dir, _best_name(spark, sf_dir))
    test = prep.lines.where(F.col("is_test")).withColumn("request_id", F.concat_ws("|", *LINE_KEY))
    asked = test.dropDuplicates(["request_id"])
    defaults = request_defaults(spark, sf_dir)
    prof = D.mode_profile(orders_frame(spark, sf_dir))

    def decide(tag, new_value):
        given = [c for c in prep.features if c not in FOLLOWING]  # the others follow from these
        requests = asked.select("request_id", _changed("quantity", new_value, given))
        scored = _score_modes(best, whatif_fill(requests, defaults, prep.numeric, prep.categorical))
        asked_rows = scored.select(
            F.col("request_id").alias("order_id"), "market", F.col("actual_mode").alias("shipping_mode"),
            (dround("order_item_total", 4) / D.VALUE_SCALE).alias("value"), F.lit(0.0).alias("profit_k"), *[f"p_{k}" for k in D.KEY_OF.values()],
        )
        # read for the costs and for the risk: filled and scored once
        rows = materialized(spark, f"whatif_{tag}", sf_dir, lambda: asked_rows)
        first = D.compare_modes(rows, prof, CONSTRAINED).where(F.col("cost_rank") == 1)
        risk = rows.select("order_id", D.current_p(rows).alias("p"))
        return first.select("order_id", "recommended", "recommended_cost").join(risk, "order_id")

    old, new = decide("old", F.col("quantity")).alias("o"), decide("new", F.col("quantity") * 2).alias("n")
    return old.join(new, "order_id").select(
        F.col("order_id").alias("request_id"),
        F.col("o.recommended").alias("rec_base"),
        F.col("n.recommended").alias("rec_new"),
        (F.col("o.recommended") != F.col("n.recommended")).alias("recommendation_changed"),
        dround(F.col("n.recommended_cost") - F.col("o.recommended_cost"), 2).alias("delta_best_cost"),
        dround(100 * (F.col("n.p") - F.col("o.p")), 2).alias("delta_p_points"),
    )


# ------------------------------------------------------------------ sinks
@query(
    "sink_results",
    with_base(
        "SELECT order_id, line_number, product_id, supplier_id, CASE WHEN quantity = 10 THEN NULL ELSE round(sales / quantity, 6) END AS unit_value "
        "FROM lines"
    ),
)
def q_sink_results(spark, sf_dir):
    """A result with non-finite doubles (every tenth-quantity line is made so)
    written by the sink and read back: those cells are null."""
    from shipcast.session import checkpoint_dir
    from shipcast.sources.adapter import lines
    from shipcast.sources.sinks import sink_results

    bad = F.when(F.col("quantity") == 10, F.lit(float("inf"))).otherwise(dround(F.col("sales") / F.col("quantity"), 6))
    table = lines(spark, sf_dir).select("order_id", "line_number", "product_id", "supplier_id", bad.alias("unit_value"))
    paths = sink_results({"unit_value": table}, f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}")
    return spark.read.schema(table.schema).parquet(paths["unit_value"])


_NESTED = "CASE WHEN quantity = 10 THEN NULL ELSE round(sales / quantity, 6) END"


@query(
    "sink_results_nested",
    with_base(
        f"SELECT fmt, order_id, line_number, product_id, supplier_id, {_NESTED} AS in_struct, {_NESTED} AS in_array, {_NESTED} AS in_map, "
        "round(sales, 4) AS next_to_it FROM lines, (VALUES ('parquet'), ('json')) f(fmt)"
    ),
)
def q_sink_results_nested(spark, sf_dir):
    """Non-finite doubles inside a struct, an array of structs and a map,
    written as Parquet and as JSON and read back from both."""
    from shipcast.session import checkpoint_dir
    from shipcast.sources.sinks import sink_results

    bad = F.when(F.col("quantity") == 10, F.lit(float("nan"))).otherwise(dround(F.col("sales") / F.col("quantity"), 6))
    key = ["order_id", "line_number", "product_id", "supplier_id"]
    one = F.struct(bad.alias("unit"), dround("sales", 4).alias("sales"))
    table = lines(spark, sf_dir).select(
        *key, one.alias("one"), F.array(one, one).alias("many"), F.create_map(F.lit("unit"), -bad, F.lit("again"), bad).alias("named")
    )
    base, out = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}", None
    for fmt in ("parquet", "json"):
        path = sink_results({fmt: table}, base, fmt)[fmt]
        back = spark.read.schema(table.schema).format(fmt).load(path).select(
            F.lit(fmt).alias("fmt"), *key, F.col("one.unit").alias("in_struct"), F.col("many")[1]["unit"].alias("in_array"),
            F.col("named")["again"].alias("in_map"), F.col("one.sales").alias("next_to_it"),
        )
        out = back if out is None else out.unionByName(back)
    return out


@query("sink_model")
def q_sink_model(spark, sf_dir):
    """The fitted logistic pipeline saved, loaded and scored again over the
    held-out lines: rows whose scores differ (none) and their mean."""
    from pyspark.ml import PipelineModel

    from shipcast.session import checkpoint_dir
    from shipcast.sources.sinks import sink_model

    fitted = model(spark, sf_dir, "Logistic Regression")
    again = PipelineModel.load(sink_model(fitted, f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"))
    test = prepared(spark, sf_dir).lines.where(F.col("is_test"))
    names = [c for c in test.columns]
    both = again.transform(fitted.transform(test).select(*names, vector_p().alias("p_saved"))).select("p_saved", vector_p().alias("p_loaded"))
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("p_saved") - F.col("p_loaded")) > 1e-12).alias("n_different"),
        dround(F.avg("p_loaded"), 4).alias("mean_p"),
    )


# ------------------------------------------------ model scores -> decisions
def model_counterfactuals(spark, sf_dir):
    """Every held-out line scored by the selected model under every mode: one
    row-local transform per mode, so nothing is shuffled and each line keeps
    its seven-column key."""
    prep = prepared(spark, sf_dir)
    return _score_modes(model(spark, sf_dir, _best_name(spark, sf_dir)), prep.lines.where(F.col("is_test")))


def vector_p():
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


@query("counterfactual_scores_model")
def q_counterfactual_scores_model(spark, sf_dir):
    from shipcast.operators.decision import KEY_OF

    rows = model_counterfactuals(spark, sf_dir)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), dround(F.col(f"p_{k}"), 6).alias("p_late")) for m, k in KEY_OF.items()])
    return rows.select(*LINE_KEY, F.inline(modes))


@query("policy_compare_model")
def q_policy_compare_model(spark, sf_dir):
    """Policies A-E on model scores for held-out lines (value in thousands)."""
    from shipcast.operators import decision as D
    from shipcast.plans.q_decision import DEFAULT

    rows = model_counterfactuals(spark, sf_dir).select(
        F.concat_ws("|", *LINE_KEY).alias("order_id"), "market", "order_region", F.col("actual_mode").alias("shipping_mode"),
        (dround(F.col("order_item_total"), 4) / D.VALUE_SCALE).alias("value"), (dround(F.col("profit"), 4) / D.VALUE_SCALE).alias("profit_k"),
        *[f"p_{k}" for k in D.KEY_OF.values()],
    )
    prof = D.mode_profile(orders_frame(spark, sf_dir))
    return D.policy_compare(D.evaluate(rows, prof, [D.scenario_struct("default", DEFAULT)]))
