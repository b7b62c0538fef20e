"""Bracketed quantiles, co-moments and the policy cube: values and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcast.functions import prefix
from shipcast.functions.comoments import co_moments
from shipcast.operators import decision as D
from shipcast.operators import eda
from shipcast.plans import q_decision as QD
from shipcast.sources.adapter import orders_frame

SF = "/root/testdata/sf0.001"
PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_bracketed_quantiles(spark, monkeypatch, accuracy):
    """Rough bounds only make the brackets wider."""
    monkeypatch.setattr(prefix, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(4001)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 7.0]) for _ in range(3000)],
        "one": [5.0],
        None: [float(i) for i in range(10)],
        "nothing": [None, None],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    names = [f"p{i}" for i in range(len(PROBS))]
    got = {r.g: r for r in prefix.exact_quantiles(frame, "v", PROBS, ["g"], names).collect()}
    assert set(got) == set(values) - {"nothing"}
    for g, r in got.items():
        assert r.n == len(values[g])
        assert [r[c] for c in names] == pytest.approx(np.quantile(values[g], PROBS).tolist())
    whole = prefix.exact_quantiles(frame, "v", [0.5]).first()
    known = [v for _, v in rows if v is not None]
    assert (whole.n, whole.q0) == (len(known), pytest.approx(np.median(known)))
    none = prefix.exact_quantiles(frame.where("false"), "v", [0.5]).first()
    assert (none.n, none.q0) == (0, None)


@pytest.mark.parametrize("accuracy", [1_000, 20])
def test_quantiles_of_columns_side_by_side(spark, monkeypatch, accuracy):
    """As of one column each; rows are never multiplied by the columns."""
    monkeypatch.setattr(prefix, "COLUMN_ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [(rng.gauss(0, 1), rng.choice([1, 2, 2, 2, 7, None]), None, float(i) if i < 2 else None) for i in range(3001)]
    frame = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(5)
    names = [f"p{i}" for i in range(len(PROBS))]
    got = {r.column: r for r in prefix.column_quantiles(frame, ["a", "b", "c", "d"], PROBS, names).collect()}
    assert set(got) == {"a", "b", "d"}
    for k, c in enumerate("abcd"):
        values = [r[k] for r in rows if r[k] is not None]
        if values:
            assert got[c].n == len(values)
            assert [got[c][x] for x in names] == pytest.approx(np.quantile(values, PROBS).tolist())
    assert prefix.column_quantiles(frame.where("false"), ["a", "b"], [0.5], ["m"]).count() == 0
    assert prefix.column_quantiles(frame, [], [0.5], ["m"]).count() == 0


def test_too_many_groups_go_through_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BRACKET_GROUPS", 3)
    frame = spark.range(100).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r.q0 for r in prefix.exact_quantiles(frame, "v", [0.5], ["g"]).collect()}
    assert got == {g: 47.5 + g for g in range(5)}


def test_co_moments_merge_stably(spark):
    """Values far from zero, one constant column, nulls pair by pair."""
    rng = np.random.default_rng(5)
    x = 1e9 + rng.normal(size=3000)
    rows = [
        (float(a), None if i % 7 == 0 else float(a * 2 + e), 0.1, None if i % 2 else float(e)) for i, (a, e) in enumerate(zip(x, rng.normal(size=3000)))
    ]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    got = {(r.var_a, r.var_b): r for r in co_moments(frame, ["a", "b", "c", "d"]).collect()}
    cols = dict(zip("abcd", zip(*rows)))
    for (p, q), r in got.items():
        both = [(u, v) for u, v in zip(cols[p], cols[q]) if u is not None and v is not None]
        u, v = (np.array(z) - z[0] for z in zip(*both))
        u, v = u - u.mean(), v - v.mean()
        assert r.n == len(both)
        assert (r.ss_a, r.ss_b, r.sp) == pytest.approx((u @ u, v @ v, u @ v), rel=1e-6, abs=1e-6)
    assert got["c", "c"].ss_a == 0.0


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_correlation_reads_the_orders_once(spark):
    assert scans(eda.correlation_matrix(orders_frame(spark, SF))) == 1


def test_policies_cost_the_rows_once(spark):
    """One scan of the costed rows for all five policies (their profile and
    scores come in as scalars of their own)."""
    _, rows, prof = QD._rows(spark, SF)
    alone = scans(D.evaluate(rows, prof, [D.scenario_struct("default", QD.DEFAULT)], "D"))
    assert scans(D.evaluate(rows, prof, [D.scenario_struct("default", QD.DEFAULT)])) == alone
