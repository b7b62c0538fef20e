"""CSV reader, LFS pointer check, dictionary, reconcile, resolver, sinks."""

import math

import pytest
from pyspark.sql import functions as F

from shipcast.functions.columns import match_columns, select_requested
from shipcast.operators import decision as D
from shipcast.sources.csv_source import (
    DatasetError,
    load_dictionary,
    load_raw_dataset,
    reconcile_dictionary,
)
from shipcast.sources.sinks import finite, sink_results


def test_latin1_csv_with_schema(spark, tmp_path):
    p = tmp_path / "data.csv"
    p.write_bytes("Order Id,Order City,Sales\n1,Japón,10.5\n2,Turquía,3\n".encode("latin-1"))
    df = load_raw_dataset(spark, [str(tmp_path / "missing.csv"), str(p)], "`Order Id` long, `Order City` string, Sales double")
    rows = sorted(df.collect())
    assert [r["Order City"] for r in rows] == ["Japón", "Turquía"]
    assert rows[0].Sales == 10.5


def test_lfs_pointer_and_missing(spark, tmp_path):
    p = tmp_path / "ptr.csv"
    p.write_text("version https://git-lfs.github.com/spec/v1\noid sha256:abc\nsize 95729629\n")
    with pytest.raises(DatasetError):
        load_raw_dataset(spark, str(p), "a string")
    with pytest.raises(DatasetError):
        load_raw_dataset(spark, str(tmp_path / "nope.csv"), "a string")


def test_dictionary_and_reconcile(spark, tmp_path):
    p = tmp_path / "dict.csv"
    p.write_bytes(b"FIELDS,DESCRIPTION\nOrder Id ,:  Order code\nShipping date (DateOrders),:  Ship date\nLegacy,: gone\n")
    d = load_dictionary(spark, str(p))
    got = {r.field: r.description for r in d.collect()}
    assert got["Order Id"] == "Order code" and got["Shipping date (DateOrders)"] == "Ship date"
    rec = {(r.kind, r.csv_name, r.dictionary_name) for r in reconcile_dictionary(
        spark, ["Order Id", "shipping date (DateOrders)", "Order Zipcode"], d).collect()}
    assert ("undocumented", "Order Zipcode", None) in rec
    assert ("missing_from_csv", None, "Legacy") in rec
    assert ("spelling_mismatch", "shipping date (DateOrders)", "Shipping date (DateOrders)") in rec
    assert load_dictionary(spark, str(tmp_path / "none.csv")) is None


def test_match_columns(spark):
    table = spark.createDataFrame([(1, 2)], "`Order  Id` int, `shipping date (DateOrders)` int")
    got = {r.requested: r.actual for r in match_columns(table, [" order id ", "Shipping date (DateOrders)", "missing"]).collect()}
    assert got == {" order id ": "Order  Id", "Shipping date (DateOrders)": "shipping date (DateOrders)", "missing": None}
    assert select_requested(table, ["ORDER ID"]).first()["ORDER ID"] == 1
    with pytest.raises(ValueError):
        select_requested(table, ["missing"])


def test_override_table_equals_the_resolver(spark):
    given = {"late_penalty_fixed": "abc", "late_penalty_rate": " 0.1 ", "freight_cost": {"Nope": 3, "Same Day": "x", "First Class": "20"}}
    table = {r.parameter: r.value for r in D.override_table(spark, given).collect()}
    a = D.resolve_assumptions(given)
    assert table["late_penalty_fixed"] == a.late_penalty_fixed and table["late_penalty_rate"] == a.late_penalty_rate == 0.1
    assert {m: table[f"freight:{m}"] for m in a.freight_cost} == a.freight_cost


def test_sinks_write_non_finite_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert [r.x for r in finite(df).collect()] == [1.0, None, None]
    out = sink_results({"t": df}, str(tmp_path / "res"))
    back = spark.read.parquet(out["t"]).collect()
    assert sorted([r.x for r in back], key=lambda v: (v is None, v)) == [1.0, None, None]


def test_whatif_fill(spark):
    from shipcast.operators.whatif import whatif_fill

    req = spark.createDataFrame(
        [(1, "quantity", "2"), (1, "product_price", "10"), (1, "bogus", "x"), (1, "discount_rate", "n/a"), (2, "market", "EUROPE")],
        "request_id long, key string, value string",
    )
    defaults = spark.createDataFrame(
        [("quantity", "numeric", None, 1.0), ("product_price", "numeric", None, 5.0), ("discount_rate", "numeric", None, 0.1),
         ("market", "categorical", "ASIA", None)],
        "feature string, kind string, default string, median double",
    )
    out = {r.request_id: r for r in whatif_fill(req, defaults, ["quantity", "product_price", "discount_rate"], ["market"]).collect()}
    assert out[1].sales == 20.0 and out[1].discount_rate == 0.1 and out[1].market == "ASIA"
    assert math.isclose(out[1].order_item_total, 18.0)
    assert out[2].market == "EUROPE" and out[2].sales == 5.0


def test_sink_model_roundtrip(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from shipcast.sources.sinks import sink_model

    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.0, 0.2), (1.0, 0.9)], "label double, x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()]).fit(df)
    path = sink_model(model, str(tmp_path / "m"))
    again = PipelineModel.load(path)
    assert again.transform(df).count() == 4


def test_sweep_parameter_and_presets():
    from shipcast.operators import decision as D

    base = D.resolve_assumptions()
    a = D.with_parameter(base, "freight:Same Day", 40)
    assert a.freight_cost["Same Day"] == 40.0 and base.freight_cost["Same Day"] == 32.0
    b = D.with_parameter(base, "speed_value_per_day", 0)
    assert b.speed_value_per_day == 0.0
    assert len(D.sweep_scenarios(base)) == sum(len(v) for v in D.SWEEPS.values())


def test_tables_that_threads_of_a_build_need(spark):
    """A build may wait for threads that store tables of their own."""
    from concurrent.futures import ThreadPoolExecutor

    from shipcast.sources.materialize import materialized

    def part(k):
        return materialized(spark, f"part-{k}", "here", lambda: spark.range(k)).count()

    def build():
        with ThreadPoolExecutor(max_workers=2) as pool:
            return spark.range(sum(f.result(timeout=60) for f in [pool.submit(part, k) for k in (3, 4)]))

    assert materialized(spark, "whole", "here", build).count() == 7


def test_lines_of_an_order_lie_together(spark):
    """Part joins the narrow items, orders come last: without broadcasts no
    order's lines are spread by part key, and nothing wide is shuffled by it."""
    from shipcast.sources.adapter import canonical_lines

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = canonical_lines(spark, "/root/testdata/sf0.001").select("order_id", F.spark_partition_id().alias("at"))
        spread = found.groupBy("order_id").agg(F.countDistinct("at").alias("n")).agg(F.max("n"), F.sum("n"), F.countDistinct("order_id")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert spread[0] == 1 and spread[1] == spread[2] > 1000
