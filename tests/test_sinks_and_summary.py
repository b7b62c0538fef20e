"""Nested sinks, rules of the summary, families of distinct counts, lookups."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipcast.functions import lookup as L
from shipcast.operators import quality as Q
from shipcast.operators import reporting as R
from shipcast.sources.sinks import finite, sink_results

NAN, INF = float("nan"), float("inf")
SCHEMA = "id long, plain double, arr array<double>, deep array<struct<x:float,tags:array<string>>>, named map<string,array<double>>, box struct<y:double,z:struct<w:double>>"
ROWS = [
    (1, NAN, [1.0, INF, None], [(NAN, ["a"]), (2.0, None)], {"k": [-INF, 3.0], "none": None}, (INF, (4.0,))),
    (2, 5.0, None, [None], None, None),
    (3, None, [], [], {}, (1.0, (NAN,))),
    (4, -0.5, [0.0], None, {"k": []}, (None, None)),
]
WANT = [
    (1, None, [1.0, None, None], [(None, ["a"]), (2.0, None)], {"k": [None, 3.0], "none": None}, (None, (4.0,))),
    (2, 5.0, None, [None], None, None),
    (3, None, [], [], {}, (1.0, (None,))),
    (4, -0.5, [0.0], None, {"k": []}, (None, None)),
]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_non_finite_numbers_at_any_depth(spark, tmp_path, fmt):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    path = sink_results({"r": frame}, str(tmp_path), fmt)["r"]
    back = spark.read.schema(frame.schema).format(fmt).load(path).orderBy("id").collect()
    assert [tuple(r) for r in back] == WANT
    assert finite(frame.select("id")).schema == frame.select("id").schema


def test_large_ids_stay_apart(spark):
    frame = spark.createDataFrame([(2**53,), (2**53 + 1,), (None,)], T.StructType([T.StructField("i", T.LongType())]))
    assert Q.profile_columns(frame).first()["unique"] == 2


def test_lookup_beyond_the_bound(spark):
    table = spark.createDataFrame([(k, k * 10) for k in range(30)], "k int, v int")
    rows = spark.range(300).select((F.col("id") % 40).cast("int").alias("k"), "id")
    got = {(r.id, r.k, r.v) for r in L.lookup(rows, table, ["k"], bound=5).collect()}
    assert got == {(i, i % 40, i % 40 * 10 if i % 40 < 30 else None) for i in range(300)}


def found(spark, **change):
    orders = spark.createDataFrame([(1,), (0,)], "late_delivery_risk int")
    rates = spark.createDataFrame(
        [("shipping_mode", "First", 300, 90.0), ("shipping_mode", "Std", 10, 30.0), ("market", "A", 199, 99.0), ("market", "B", 200, 50.0)],
        "dimension string, level string, orders long, late_rate double",
    )
    family = spark.createDataFrame(
        [("mode", 1, True, 0.6, 2, 1, 1), ("market", 2, False, 0.3, 2, 1, 1)],
        "factor string, rank int, significant boolean, effect_size double, n_tests int, n_significant int, n_material int",
    )
    saving = change.get("saving", 4.0)
    policies = spark.createDataFrame(
        [("single_mode:Std", 5.0, 0.4, 0.0, 2), ("mode_per_order", 4.8, 0.35, saving, 1)],
        "policy string, avg_cost double, expected_late_rate double, saving_pct double, rank long",
    )
    promise = spark.createDataFrame(
        [(True, change.get("same", True), 0.386, 1234)], "available boolean, transit_identical boolean, late_rate_reduction double, orders_affected long"
    )
    models = {}
    if change.get("models"):
        models["importance"] = spark.createDataFrame([(f"f{i}", i / 1000) for i in range(8)], "feature string, importance double")
        models["ablation"] = spark.createDataFrame([("full", 0.8), ("without_mode", 0.535)], "ablation string, roc_auc double")
    return R.summary(R.findings(orders, rates, family, policies, promise, **models))


def test_rules_say_what_holds(spark):
    rows = {(r.section, r.item): r.value for r in found(spark, models=True).collect()}
    said = {i: v for (s, i), v in rows.items() if s == "recommendation"}
    assert said == {
        "align_second_class_promise": "39 points, 1234 orders",
        "adopt_best_policy": "mode_per_order: 5.000 to 4.800 an order, late rate 40.0 to 35.0 %",
        "review_commitment_of_worst_mode": "First: 90.0 % late",
        "no_forecast_without_mode": "AUC 0.535 without the mode",
    }
    assert [i for s, i in rows if s == "permutation_drivers"] == ["f7", "f6", "f5", "f4", "f3"]
    assert rows["worst_level", "worst_market"] == "B"
    assert ("worst_level", "worst_order_region") not in rows
    assert rows["drivers", "material_factor_1"] == "mode"


def test_rules_that_fail_say_nothing(spark):
    items = {r.item for r in found(spark, saving=0.0, same=False).where("section = 'recommendation'").collect()}
    assert items == {"review_commitment_of_worst_mode"}


def test_findings_evaluate_each_input_once(spark):
    """One scalar subquery per input, whatever the number of rules."""
    plan = found(spark, models=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 8
