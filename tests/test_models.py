"""Training, slot names and permutation importance on the small tables."""

import pytest

from shipcast.operators import ml as ML
from shipcast.plans import q_ml

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prep(spark):
    return q_ml.prepared(spark, SF)


def test_slots_name_their_features(spark, prep):
    slots = q_ml.q_preprocess(spark, SF).collect()
    assert {r.feature for r in slots} == set(prep.features)
    numeric = [r.slot_name for r in sorted(slots, key=lambda r: r.slot)][: len(prep.numeric)]
    assert numeric == prep.numeric
    assert {r.feature for r in q_ml.q_coef_importance(spark, SF).collect()} == set(prep.features)


def test_permutation_finds_the_mode(spark, prep):
    model = q_ml.model(spark, SF, "Logistic Regression")
    drops = {r.feature: r.importance for r in ML.permutation_importance(prep, model, repeats=2).collect()}
    assert set(drops) == set(prep.features)
    assert max(drops, key=drops.get) == "shipping_mode"


def test_medians_are_of_the_training_rows(prep):
    train = prep.data.where("not is_test")
    got = ML.train_medians(train, ["quantity", "discount_rate"])
    rows = sorted(r.quantity for r in train.select("quantity").collect())
    n = len(rows)
    assert got["quantity"] == (rows[(n - 1) // 2] + rows[n // 2]) / 2


def test_saved_model_scores_the_same(spark):
    row = q_ml.q_sink_model(spark, SF).first()
    assert row.n_rows > 0 and row.n_different == 0


def test_time_split_falls_back_to_groups(spark):
    from pyspark.sql import functions as F

    from shipcast.operators.decision import split_flag
    from shipcast.plans.q_metrics import time_split
    from shipcast.sources.adapter import lines

    pop = lines(spark, SF)
    sides = pop.select(time_split(pop, "1900-01-01").alias("side"), split_flag(F.col("order_id")).alias("test"))
    assert sides.where((F.col("side") == "test") != F.col("test")).count() == 0
    assert sides.select("side").distinct().count() == 2


def test_logit_survives_a_singular_design(spark):
    rows = q_ml.q_logit_inference(spark, SF).collect()
    assert rows and all(r.coef is not None for r in rows)


def test_boosting_keeps_its_best_prefix():
    falling = [1.0, 0.9, 0.8, 0.85, 0.7] + [0.75] * 10
    assert ML.kept_rounds(falling) == (5, True)
    assert ML.kept_rounds(falling[:-1]) == (5, False)
    assert ML.kept_rounds([0.5] * 11) == (1, True)


def test_boosting_beats_one_tree(spark, prep):
    from pyspark.ml import PipelineModel
    from pyspark.sql import functions as F

    boosted = q_ml.model(spark, SF, "Gradient Boosting")
    row = q_ml.q_train_gbt(spark, SF).first()
    assert row.n_trees == ML.n_trees(boosted.stages[-1]) > 1
    test = PipelineModel(boosted.stages[:-1]).transform(prep.data.where("is_test").withColumn(ML.TARGET, F.col(ML.TARGET).cast("double")))
    constant, one, *_, last = boosted.stages[-1].evaluateEachIteration(test)
    assert last < one < constant
    assert boosted.stages[-1].featureImportances.size == len(ML.feature_slots(boosted, prep.numeric, prep.categorical))


def test_boosted_model_is_saved(spark, prep, tmp_path):
    from pyspark.ml import PipelineModel

    boosted = q_ml.model(spark, SF, "Gradient Boosting")
    boosted.write().save(str(tmp_path / "model"))
    test = prep.data.where("is_test")
    again = ML.score(PipelineModel.load(str(tmp_path / "model")), test).agg({"p": "avg"}).first()[0]
    assert again == pytest.approx(ML.score(boosted, test).agg({"p": "avg"}).first()[0])


def test_folds_are_grouped_and_stratified(spark, prep):
    train = prep.data.where("not is_test")
    folds = ML.order_folds(train)
    assert folds.count() == train.select("order_id").distinct().count()
    for r in folds.groupBy("n_lines", "n_late").pivot("fold", list(range(ML.CV_FOLDS))).count().fillna(0).collect():
        sizes = [r[str(k)] for k in range(ML.CV_FOLDS)]
        assert max(sizes) - min(sizes) <= 1
    assert train.select("order_id", "fold").distinct().count() == folds.count()


def test_preprocessing_after_save_and_load(spark, tmp_path):
    """Nulls take the median and the most frequent level; a level that the
    training rows lack has zeros in all slots."""
    from pyspark.ml import Pipeline, PipelineModel

    rows = [("a'b", 1.0), ("a'b", 3.0), ("c\\d", 8.0), (None, None)]
    train = spark.createDataFrame(rows, "level string, x double")
    fills = ML.fit_fills(train, ["x"], ["level"])
    assert fills == ML.Fills({"x": 3.0}, {"level": "a'b"})
    fitted = Pipeline(stages=ML.preprocess_stages(["x"], ["level"], False, fills)).fit(train)
    assert [s for s, _ in ML.feature_slots(fitted, ["x"], ["level"])] == ["x", "level=a'b", "level=c\\d"]
    fitted.write().overwrite().save(str(tmp_path / "stages"))
    again = PipelineModel.load(str(tmp_path / "stages"))
    asked = spark.createDataFrame([("c\\d", 1.0), (None, None), ("new", 2.0)], train.schema)
    assert [r.features.toArray().tolist() for r in again.transform(asked).collect()] == [[1.0, 0.0, 1.0], [3.0, 1.0, 0.0], [2.0, 0.0, 0.0]]


def test_unchanged_scores_are_shared(spark, prep, monkeypatch):
    """Features that no tree tests drop nothing, scored or not."""
    model = q_ml.model(spark, SF, "Decision Tree")
    tested = ML.tested_features(prep, model)
    assert 0 < len(tested) < len(prep.features)
    drops = {r.feature: r.importance for r in ML.permutation_importance(prep, model, repeats=1).collect()}
    monkeypatch.setattr(ML, "tested_features", lambda p, m: set(p.features))
    assert drops == {r.feature: r.importance for r in ML.permutation_importance(prep, model, repeats=1).collect()}
    assert all(drops[f] == 0 for f in set(prep.features) - tested)
