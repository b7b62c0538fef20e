"""Trees grown from packed blocks against Spark's own, and what a round costs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from shipcast.operators import boosting as B
from shipcast.operators import ml as ML
from shipcast.operators.leakage import constant_columns

NUM, CAT = ["x", "z"], ["c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=3000).tolist(), rng.integers(0, 40, 3000).tolist()
    c, d = rng.integers(0, 5, 3000).tolist(), rng.integers(0, 9, 3000).tolist()
    rows = [(i, a, float(b), f"c{k}", f"d{m}", a * a + 0.1 * b + 2.0 * (k == 2) - (m == 4) * a) for i, (a, b, k, m) in enumerate(zip(x, z, c, d))]
    return spark.createDataFrame(rows, "order_id int, x double, z double, c string, d string, y double").repartition(5, "order_id").persist()


@pytest.fixture(scope="module")
def before(frame):
    return Pipeline(stages=ML.preprocess_stages(NUM, CAT, False, ML.fit_fills(frame, NUM, CAT))).fit(frame)


def fitted(frame, before, rounds, held):
    rows = before.transform(frame).withColumn("__is_val", held)
    slots = [source for _, source in ML.feature_slots(before, NUM, CAT)]
    return B.fit_boosted(rows, ["__num_x", "__num_z"], {f"__idx_{c}": slots.count(c) for c in CAT}, "y", B.SQUARED, rounds, 0.1, 5, 40)


def test_a_round_grows_the_tree_of_spark(frame, before):
    rows = before.transform(frame)
    mean = frame.agg(F.avg("y")).first()[0]
    own = fitted(frame, before, 1, F.lit(False))
    assert own.trees[0].predict(rows.first().features) == pytest.approx(mean)
    spark_tree = DecisionTreeRegressor(labelCol="off", maxDepth=5, minInstancesPerNode=40).fit(rows.withColumn("off", F.col("y") - mean))
    assert own.trees[1].numNodes == spark_tree.numNodes > 20
    assert own.trees[1].featureImportances.toArray() == pytest.approx(spark_tree.featureImportances.toArray())
    for r in spark_tree.transform(rows).select("features", "prediction").limit(300).collect():
        assert own.trees[1].predict(r.features) == pytest.approx(r.prediction)


def test_cuts_are_those_of_spark_beyond_the_rows_they_are_taken_from(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=13_000), np.maximum(rng.normal(size=13_000), 0)
    rows = [(i, float(a), float(b), f"c{i % 5}", "d", float(np.sin(3 * a) + b)) for i, (a, b) in enumerate(zip(x, z))]
    frame = spark.createDataFrame(rows, "order_id int, x double, z double, c string, d string, y double").repartition(3, "order_id").persist()
    before = Pipeline(stages=ML.preprocess_stages(NUM, CAT, False, ML.fit_fills(frame, NUM, CAT))).fit(frame)
    own = fitted(frame, before, 1, F.lit(False)).trees[1]
    mean = frame.agg(F.avg("y")).first()[0]
    rows = before.transform(frame).withColumn("off", F.col("y") - mean)
    theirs = DecisionTreeRegressor(labelCol="off", maxDepth=5, minInstancesPerNode=40, seed=42).fit(rows)
    cuts = [[float(p.rsplit(" ", 1)[1][:-1]) for p in t.toDebugString.splitlines() if " <= " in p] for t in (own, theirs)]
    assert len(cuts[0]) > 20 and cuts[0] == pytest.approx(cuts[1])


def test_a_round_is_a_job_a_level(spark, frame, before):
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "rounds")
    try:
        model = fitted(frame, before, 8, F.col("order_id") % 10 == 0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert ML.n_trees(model) == 8
    assert len(sc.statusTracker().getJobIdsForGroup("rounds")) <= 8 * 5 + 8


def test_blocks_hold_every_row_once(monkeypatch, frame, before):
    """More blocks than one, spread over tasks, give the trees of one block."""
    whole = fitted(frame, before, 2, F.lit(False))
    monkeypatch.setattr(B, "BLOCK_ROWS", 500)
    parts = fitted(frame, before, 2, F.lit(False))
    assert [t.numNodes for t in parts.trees] == [t.numNodes for t in whole.trees]
    assert parts.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray())


def test_null_labels_are_refused(frame, before):
    with pytest.raises(Exception, match="a label is null"):
        fitted(frame.withColumn("y", F.when(F.col("order_id") != 7, F.col("y"))), before, 1, F.lit(False))


def test_columns_that_vary_late_are_not_constant(spark):
    rows = spark.range(0, 5000, numPartitions=1).select(
        F.lit(1).alias("one"), F.when(F.col("id") > 4000, "b").otherwise("a").alias("late"), F.lit(None).cast("int").alias("none"),
        F.when(F.col("id") == 4500, 1).alias("single"), "id",
    )
    assert constant_columns(rows, rows.columns) == ["one", "none", "single"]
    assert constant_columns(rows, []) == []


def test_only_the_last_checkpoint_is_kept(spark, monkeypatch, frame, before):
    """And none once the model is there."""
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(spark.sparkContext.getCheckpointDir())
    disk = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def held():
        return sum(1 for s in disk.listStatus(root) if s.getPath().getName().startswith("rdd-"))

    at_first, most, level = held(), [0], B._level

    def watched(*args):
        out = level(*args)
        most.append(held() - at_first)
        return out

    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    monkeypatch.setattr(B, "_level", watched)
    fitted(frame, before, 9, F.lit(False))
    assert max(most) in (1, 2) and held() == at_first
