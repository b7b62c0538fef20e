"""Classification and regression metrics as Spark aggregations.

Ranking metrics start from score counts ``(score, pos, neg)`` (partial
aggregation, skew-proof) and use exact two-level prefix sums, so ROC-AUC
(ties count half), average precision (step sum, not the trapezoid), curve
points and the Youden point never need a single-task global sort.  The
threshold sweep buckets each score once against the thresholds i/100 and
sums suffixes over at most 82 buckets.  ``group_cols`` evaluates several
models in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipcast.functions.prefix import prefix_sums
from shipcast.functions.rounding import dround


def score_counts(df: DataFrame, score: str, label: str, group_cols: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("double")
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.lit(1.0).alias("one"))
    )


def roc_auc(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    ps = prefix_sums(counts, "score", ["neg"], group_cols)
    agg = ps.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)).alias("num"),
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    ) if group_cols else ps.agg(
        F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)).alias("num"),
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    )
    return agg.select(*group_cols, F.try_divide(F.col("num"), F.col("P") * F.col("N")).alias("roc_auc"))


def _desc(counts: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Cumulative counts at each threshold (score >= s), descending."""
    ps = prefix_sums(counts, "score", ["pos", "neg", "one"], group_cols, descending=True)
    return ps.select(
        *group_cols,
        "score",
        "pos",
        "neg",
        (F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("cum_neg") + F.col("neg")).alias("fp"),
        (F.col("cum_one") + 1).cast("bigint").alias("position"),  # 0 is the (0, 0) start
        F.col("tot_pos").alias("P"),
        F.col("tot_neg").alias("N"),
        F.col("tot_one").cast("bigint").alias("n_scores"),
    )


def average_precision(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    d = _desc(counts, group_cols)
    term = F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    if group_cols:
        return d.groupBy(*group_cols).agg(F.sum(term).alias("pr_auc"))
    return d.agg(F.sum(term).alias("pr_auc"))


def _kept(position: Column, n: Column, max_points: int | None) -> Column:
    """Every position, or with ``max_points``: position i survives thinning to ``max_points`` evenly spaced indices
    floor(k (n-1) / (max_points-1)), k = 0..max_points-1 (integer arithmetic)."""
    if max_points is None:
        return F.lit(True)
    m = max_points - 1
    k0 = F.floor((position * m + (n - 2)) / (n - 1))
    return (n <= max_points) | ((k0 <= m) & (k0 * (n - 1) < (position + 1) * m))


def roc_curve(counts: DataFrame, group_cols: Sequence[str] = (), max_points: int | None = None) -> DataFrame:
    d = _desc(counts, group_cols)
    pts = d.select(
        *group_cols, "position", F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"),
        (F.col("tp") / F.col("P")).alias("tpr"), (F.col("n_scores") + 1).alias("n_points"),
    )
    start = (
        d.groupBy(*group_cols).agg(F.max("n_scores").alias("n"))
        if group_cols
        else d.agg(F.max("n_scores").alias("n"))
    ).select(*group_cols, F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("double").alias("threshold"),
             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.col("n") + 1).alias("n_points"))
    allp = pts.unionByName(start)
    return allp.where(_kept(F.col("position"), F.col("n_points"), max_points)).select(
        *group_cols, "position", dround("threshold", 6).alias("threshold"), dround("fpr", 5).alias("fpr"), dround("tpr", 5).alias("tpr")
    )


def pr_curve(counts: DataFrame, group_cols: Sequence[str] = (), max_points: int | None = None) -> DataFrame:
    d = _desc(counts, group_cols)
    pts = d.select(
        *group_cols, "position", F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("P")).alias("recall"), (F.col("n_scores") + 1).alias("n_points"),
    )
    end = (
        d.groupBy(*group_cols).agg(F.max("n_scores").alias("n")) if group_cols else d.agg(F.max("n_scores").alias("n"))
    ).select(*group_cols, F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("double").alias("threshold"),
             F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), (F.col("n") + 1).alias("n_points"))
    allp = pts.unionByName(end)
    return allp.where(_kept(F.col("position"), F.col("n_points"), max_points)).select(
        *group_cols, "position", dround("threshold", 6).alias("threshold"), dround("precision", 5).alias("precision"),
        dround("recall", 5).alias("recall"),
    )


def youden_point(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    d = _desc(counts, group_cols).select(
        *group_cols, "position", "score", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr")
    ).withColumn("j", F.col("tpr") - F.col("fpr"))
    key = F.struct(F.col("j"), -F.col("position"))
    aggs = [
        F.max_by("score", key).alias("threshold"), F.max("j").alias("j"),
        F.max_by("tpr", key).alias("tpr"), F.max_by("fpr", key).alias("fpr"),
    ]
    best = d.groupBy(*group_cols).agg(*aggs) if group_cols else d.agg(*aggs)
    # the (0, 0) start point has j = 0 and wins only if nothing beats it
    return best.select(
        *group_cols,
        dround(F.when(F.col("j") > 0, F.col("threshold")), 4).alias("threshold"),
        dround(F.greatest(F.col("j"), F.lit(0.0)), 4).alias("j"),
        dround(F.when(F.col("j") > 0, F.col("tpr")).otherwise(0.0), 4).alias("tpr"),
        dround(F.when(F.col("j") > 0, F.col("fpr")).otherwise(0.0), 4).alias("fpr"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_columns(tp, fp, tn, fn) -> list[Column]:
    sens = _ratio(tp, tp + fn)
    spec = _ratio(tn, tn + fp)
    return [
        dround(_ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        dround(_ratio(tp, tp + fp), 4).alias("precision"),
        dround(sens, 4).alias("recall"),
        dround(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        dround(spec, 4).alias("specificity"),
        dround(sens, 4).alias("sensitivity"),
        dround(sens + spec - 1, 4).alias("youden_j"),
    ]


def eval_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    y = F.col(label).cast("double")
    p = F.col(score)
    flag = p >= threshold
    base = df.where(p.isNotNull()).agg(
        F.sum(F.when(flag & (y == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(flag & (y == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~flag & (y == 0), 1).otherwise(0)).alias("tn"),
        F.sum(F.when(~flag & (y == 1), 1).otherwise(0)).alias("fn"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    counts = score_counts(df, score, label)
    auc = roc_auc(counts).select("roc_auc").scalar()
    ap = average_precision(counts).select("pr_auc").scalar()
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return base.select(
        *confusion_columns(tp, fp, tn, fn),
        dround(auc, 4).alias("roc_auc"),
        dround(ap, 4).alias("pr_auc"),
        dround("brier", 4).alias("brier"),
        F.lit(threshold).alias("threshold"),
        *[F.col(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")],
    )


def threshold_bucket(p: Column, lo: int = 10, hi: int = 90) -> Column:
    """Highest i in [lo, hi] with i/100 <= p (lo - 1 when none), exact against
    the double thresholds i/100.0."""
    b = F.floor(p * 100).cast("int")
    b = F.when((b + 1) / 100.0 <= p, b + 1).when(b / 100.0 > p, b - 1).otherwise(b)
    return F.least(F.greatest(b, F.lit(lo - 1)), F.lit(hi))


def threshold_sweep(df: DataFrame, score: str, label: str, lo: int = 10, hi: int = 90) -> DataFrame:
    y = F.col(label).cast("double")
    scored = df.where(F.col(score).isNotNull())
    buckets = scored.groupBy(threshold_bucket(F.col(score), lo, hi).alias("b")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    totals = buckets.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = totals.select("P").scalar(), totals.select("N").scalar()
    passed = (
        buckets.select(F.explode(F.sequence(F.lit(lo), F.col("b"))).alias("i"), "pos", "neg")
        .where(F.col("i") >= lo)
        .groupBy("i")
        .agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    )
    grid = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("i"))
    j = grid.join(passed, "i", "left").select(
        "i", F.coalesce("tp", F.lit(0.0)).alias("tp"), F.coalesce("fp", F.lit(0.0)).alias("fp")
    ).withColumns({"P": P, "N": N})
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return j.select(
        dround(F.col("i") / 100.0, 2).alias("threshold"),
        *confusion_columns(tp, fp, tn, fn)[1:],
        (tp + fp).cast("bigint").alias("n_flagged"),
        dround(100 * (tp + fp) / (F.col("P") + F.col("N")), 2).alias("flagged_pct"),
        tn.cast("bigint").alias("tn"),
        fp.cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"),
        tp.cast("bigint").alias("tp"),
    )


def threshold_lookup(sweep: DataFrame, requests: DataFrame, lo: int = 10, hi: int = 90) -> DataFrame:
    """Nearest sweep row to each requested threshold (the lower one on ties).

    Sweep thresholds are i/100, so the nearest index is computed per request
    (floor or ceiling of 100 t, clipped) and equi-joined: no pairwise join."""
    t = F.col("requested")
    a = F.least(F.greatest(F.floor(t * 100), F.lit(lo)), F.lit(hi))
    b = F.least(F.greatest(F.ceil(t * 100), F.lit(lo)), F.lit(hi))
    near = F.when(F.abs(b / 100.0 - t) < F.abs(a / 100.0 - t), b).otherwise(a)
    keyed = requests.select("requested", dround(near / 100.0, 2).alias("threshold"))
    return keyed.join(sweep, "threshold", "left")


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    p = F.col(score)
    b = F.floor(p * bins).cast("int")
    b = F.when((b + 1) / float(bins) <= p, b + 1).when(b / float(bins) > p, b - 1).otherwise(b)
    b = F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1))
    return (
        df.where(p.isNotNull())
        .groupBy(b.alias("bin"))
        .agg(
            dround(F.avg(p), 4).alias("predicted"),
            dround(F.avg(F.col(label).cast("double")), 4).alias("observed"),
            F.count(F.lit(1)).alias("count"),
        )
        .select(
            F.col("bin").cast("bigint").alias("bin"),
            F.format_string("%.1f-%.1f", F.col("bin") / float(bins), (F.col("bin") + 1) / float(bins)).alias("label"),
            "predicted",
            "observed",
            "count",
        )
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    y, f = F.col(actual), F.col(predicted)
    df = df.withColumn("__mean_y", df.agg(F.avg(actual).alias("m")).select("m").scalar())
    mean_y = F.col("__mean_y")
    agg = df.agg(
        F.sum((y - f) * (y - f)).alias("ss_res"),
        F.sum((y - mean_y) * (y - mean_y)).alias("ss_tot"),
        F.avg(F.abs(y - f)).alias("mae"),
        F.avg((y - f) * (y - f)).alias("mse"),
        F.avg(y).alias("mean_actual"),
        F.stddev_pop(y).alias("std_actual"),
        F.count(F.lit(1)).alias("n_test"),
    )
    return agg.select(
        dround(F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0), 4).alias("r2"),
        dround("mae", 3).alias("mae"),
        dround(F.sqrt("mse"), 3).alias("rmse"),
        dround("mean_actual", 3).alias("mean_actual"),
        dround("std_actual", 3).alias("std_actual"),
        "n_test",
    )


def model_select(aucs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best ROC-AUC; ties go to the earlier (simpler) model in ``order``."""
    rank = F.lit(len(order))
    for i, m in enumerate(order):
        rank = F.when(F.col("model") == m, F.lit(i)).otherwise(rank)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("roc_auc"), rank)
    return aucs.withColumn("selected", F.row_number().over(w) == 1)
