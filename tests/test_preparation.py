"""Preparing the models stores one population and shuffles no line; folds are joined where asked."""

import pytest

from shipcast.operators import ml as ML
from shipcast.operators.features import engineer_features
from shipcast.plans import q_ml
from shipcast.sources import materialize
from shipcast.sources.adapter import lines

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_stored_population_needs_no_shuffle_by_order(spark):
    stored = []
    prep = ML.pooled_population(ML.model_population(engineer_features(lines(spark, SF))), lambda df: stored.append(df) or df)
    assert len(stored) == 1
    assert "hashpartitioning(order_id" not in _plan(stored[0])
    assert set(prep.data.columns) == {*stored[0].columns, "fold"}


def test_features_of_all_lines_are_not_stored_besides(spark):
    own = SF + "/"  # a name of its own, so that tables of other tests stay as they are
    prep = q_ml.prepared(spark, own)
    assert {name for name, source in materialize._WRITTEN if source == own} == {"lines", "model_pop"}
    assert prep.lines.count() == prep.data.count()


@pytest.mark.parametrize("stored", [False, True])
def test_folds_are_joined_once(spark, monkeypatch, stored):
    """Every fold is validated on its own orders, whether the rows with folds are stored or not."""
    prep, asked, seen = q_ml.prepared(spark, SF), [], []

    def keep(df):
        asked.append(df)
        return df.persist()

    def auc(p, name, k, *rest):
        seen.append((k, p.data.where(f"not is_test and fold = {k}").count()))
        return 0.5

    monkeypatch.setattr(ML, "fold_auc", auc)
    ML.cross_validate(prep, ["Decision Tree"], **({"materialize": keep} if stored else {}))
    assert len(asked) == stored
    counts = {r.fold: r["count"] for r in prep.data.where("not is_test").groupBy("fold").count().collect()}
    assert dict(seen) == counts and len(counts) == ML.CV_FOLDS
