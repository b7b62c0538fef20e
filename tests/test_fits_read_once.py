"""Fits read their rows once; boosted models know their label."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipcast.operators import ml as ML


def _lines(spark):
    at = F.col("id")
    return spark.range(3000).select(
        (at % 900).alias("order_id"), (at % 3).cast("double").alias("quantity"), F.concat(F.lit("m"), at % 4).alias("shipping_mode"),
        ((at % 4 == 0) | (at % 7 == 0)).cast("int").alias(ML.TARGET), (at % 5 == 0).alias("is_test"),
    )


def _counted(spark, rows, name="shipping_mode"):
    """``rows`` with a column that counts every time it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return rows.withColumn(name, F.udf(look, T.StringType()).asNondeterministic()(name)), seen


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree"])
def test_a_fit_reads_its_rows_once(spark, name):
    """Once for what is stored, and once to count the rows that the share is taken of."""
    data, seen = _counted(spark, _lines(spark))
    fills = ML.Fills({"quantity": 1.0}, {"shipping_mode": "m0"})
    prep = ML.Prepared(data, ["quantity", "shipping_mode"], ["quantity"], ["shipping_mode"], pooled=True, fills=fills)
    ML.fit(prep, name)
    assert seen.value <= 2 * 2400


@pytest.mark.parametrize("dealt", [ML.ROWS_A_TASK, 1_000_000])
@pytest.mark.parametrize("name", ["Decision Tree", "Gradient Boosting"])
def test_a_fit_takes_all_training_rows(spark, monkeypatch, name, dealt):
    """More than the 20,000 that were once drawn, kept in tasks or read where they are stored."""
    monkeypatch.setattr(ML, "CLASSIFIER_ROUNDS", 1)
    monkeypatch.setattr(ML, "DEALT_ROWS", dealt, raising=False)
    at = F.col("id")
    rows = spark.range(30_000).select(
        at.alias("order_id"), (at % 3).cast("double").alias("quantity"), F.concat(F.lit("m"), at % 4).alias("shipping_mode"),
        (at % 4 == 0).cast("int").alias(ML.TARGET), (at % 10 == 0).alias("is_test"),
    )
    fills = ML.Fills({"quantity": 1.0}, {"shipping_mode": "m0"})
    prep = ML.Prepared(rows, ["quantity", "shipping_mode"], ["quantity"], ["shipping_mode"], pooled=True, fills=fills)
    last = ML.fit(prep, name).stages[-1]
    held = rows.where(~F.col("is_test") & ML.held_for_validation()).count() if name == "Gradient Boosting" else 0
    tree = last._java_obj if name == "Decision Tree" else last._java_obj.trees()[0]
    assert tree.rootNode().impurityStats().rawCount() == 27_000 - held


def test_a_boosted_model_names_its_label(spark, monkeypatch):
    monkeypatch.setattr(ML, "CLASSIFIER_ROUNDS", 2)
    rows = _lines(spark)
    prep = ML.Prepared(rows, ["quantity", "shipping_mode"], ["quantity"], ["shipping_mode"], pooled=True, fills=ML.fit_fills(rows, ["quantity"], ["shipping_mode"]))
    boosted = ML.fit(prep, "Gradient Boosting")
    assert boosted.stages[-1].getLabelCol() == ML.TARGET
    from pyspark.ml import PipelineModel

    scored = PipelineModel(boosted.stages[:-1]).transform(rows.withColumn(ML.TARGET, F.col(ML.TARGET).cast("double")))
    assert boosted.stages[-1].evaluateEachIteration(scored)


def test_logit_reads_the_orders_a_fixed_number_of_times(spark):
    """A hundred iterations, since m0 is always late, do not read a row a hundred times."""
    at = F.col("id")
    orders = spark.range(400).select(
        *[F.lit("x").alias(c) for c in ML.INFERENCE_CATEGORICAL if c != "shipping_mode"],
        *[((at * (i + 3)) % 11).cast("double").alias(c) for i, c in enumerate(ML.INFERENCE_NUMERIC)],
        F.concat(F.lit("m"), at % 2).alias("shipping_mode"), ((at % 2 == 0) | (at % 5 == 0)).cast("int").alias(ML.TARGET),
    )
    orders, seen = _counted(spark, orders)
    assert ML.logit_inference(orders).count()
    assert seen.value <= 4 * 400
