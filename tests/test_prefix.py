"""Distributed exact helpers against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcast.functions.prefix import exact_quantiles, prefix_sums
from shipcast.operators import metrics as M


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, 2000)
    v = np.round(rng.normal(size=2000) * 100, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    res = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"], names=["a", "b", "c", "d", "e"]).collect()}
    for k in range(3):
        expect = np.percentile(v[g == k], [p * 100 for p in probs])
        got = [res[k].a, res[k].b, res[k].c, res[k].d, res[k].e]
        assert got == pytest.approx(list(expect), rel=1e-12, abs=1e-9)


def test_prefix_sums_match_cumsum(spark):
    vals = list(range(500))
    df = spark.createDataFrame([(float(x), float(x % 7)) for x in vals], "k double, w double")
    out = sorted(prefix_sums(df, "k", ["w"], buckets=8).collect(), key=lambda r: r.k)
    w = np.array([x % 7 for x in vals], dtype=float)
    assert [r.cum_w for r in out] == list(np.concatenate([[0.0], np.cumsum(w)[:-1]]))
    assert out[0].tot_w == w.sum()


def test_auc_and_ap_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    counts = M.score_counts(df, "s", "y")
    auc = M.roc_auc(counts).first().roc_auc
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc == pytest.approx(brute, rel=1e-12)
    ap = M.average_precision(counts).first().pr_auc
    thr = np.unique(s)[::-1]
    prev_r, total = 0.0, 0.0
    for t in thr:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        r = tp / (y == 1).sum()
        total += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert ap == pytest.approx(total, rel=1e-9)


def test_threshold_bucket_exact(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.095,), (0.95,), (0.5,)], "p double")
    got = [r.b for r in df.select(M.threshold_bucket(F.col("p")).alias("b")).collect()]
    assert got == [29, 30, 9, 90, 50]
