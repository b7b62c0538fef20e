"""Modelling on Spark ML: group-safe split, preprocessing, four classifiers,
grouped cross-validation, ablation, profit regressor, logistic inference,
VIF, and three importance views.

Scoring reuses ``shipcast.operators.metrics`` (exact AUC / AP from score
counts).  Model parity with other learners is not the goal; the pipeline,
split, screen and evaluation semantics are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipcast.functions.prefix import column_quantiles, prefix_sums
from shipcast.functions.rounding import dround
from shipcast.operators import metrics as M
from shipcast.operators.boosting import LOGISTIC, SQUARED, Loss, fit_boosted, kept_rounds  # noqa: F401
from shipcast.operators.cleaning import bucket_apply, bucket_fit, filter_cancelled
from shipcast.operators.decision import split_flag
from shipcast.operators.leakage import assert_no_leakage, select_features

TARGET = "late_delivery_risk"
SEED = 42
RARE_MIN = 20
CV_FOLDS = 4
FOLD_HASHES = 10_007
RARE = "__rare__"
#: Rows of a fit that one task holds, while there are no more tasks than cores, and
#: rows up to which they are dealt to such tasks and kept there.
ROWS_A_TASK, DEALT_ROWS = 5_000, 1_000_000
#: Boosting, fixed values: rounds, shrinkage, depth and least rows of a leaf.
BOOSTING = {"step": 0.1, "depth": 5, "least": 40}
CLASSIFIER_ROUNDS, REGRESSOR_ROUNDS = 250, 200


@dataclass(frozen=True)
class Fills:
    """What stands in for a null: per numeric column its median, per
    categorical column its most frequent level."""

    medians: dict[str, float]
    modes: dict[str, str]


@dataclass
class Prepared:
    data: DataFrame          # bucketed population with ``is_test`` and ``fold``
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    pooled: bool = False     # rare levels already pooled on the training rows
    fills: Fills | None = None  # of the training rows
    lines: DataFrame | None = None  # the population without the join that adds ``fold``

    def __post_init__(self) -> None:
        if self.lines is None:
            self.lines = self.data


def model_population(line_features: DataFrame) -> Prepared:
    """Non-cancelled lines, high-cardinality columns bucketed on train rows,
    group split by order and stratified CV folds of whole training orders."""
    pop = filter_cancelled(line_features).withColumn("is_test", split_flag(F.col("order_id")))
    fitted = bucket_fit(pop.where(~F.col("is_test")))
    # at most N levels a column: counted once, not in every pass over the population
    pop = bucket_apply(pop, pop.sparkSession.createDataFrame(fitted.collect(), fitted.schema))
    feats = select_features(pop.drop("is_test"))
    assert_no_leakage(feats)
    types = {f.name: f.dataType for f in pop.schema.fields}
    numeric = [c for c in feats if isinstance(types[c], T.NumericType)]
    categorical = [c for c in feats if c not in numeric]
    return Prepared(with_folds(pop), feats, numeric, categorical, lines=pop)


def with_folds(pop: DataFrame) -> DataFrame:
    """The population with ``fold``: every line is shuffled by its order, which
    only cross-validation needs."""
    return pop.join(order_folds(pop.where(~F.col("is_test"))).select("order_id", "fold"), "order_id", "left")


def order_folds(train: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Stratified grouped folds: ``order_id, n_lines, n_late, fold``.

    Orders with equal counts of lines and late lines form a stratum, whose
    orders are dealt in turn to the folds, so every fold gets as many of a
    stratum as any other, up to one.  The turn is the place in a hashed order:
    counted per (stratum, hash) and summed to offsets, so that a window only
    ever holds the orders of one hash value and a stratum of a third of all
    orders is spread over ``FOLD_HASHES`` of them."""
    stratum = ["n_lines", "n_late"]
    orders = train.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col(TARGET).cast("long")).alias("n_late"))
    orders = orders.withColumn("h", (F.col("order_id") * 7919 + 42) % FOLD_HASHES)
    before = Window.partitionBy(*stratum).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    offsets = orders.groupBy(*stratum, "h").agg(F.count(F.lit(1)).alias("n")).select(
        *stratum, "h", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy(*stratum, "h").orderBy("order_id")) - 1
    return orders.withColumn("place", place).join(offsets, [*stratum, "h"]).select(
        "order_id", *stratum, ((F.col("before") + F.col("place")) % folds).cast("int").alias("fold")
    )


def pooled_population(prep: Prepared, materialize=None) -> Prepared:
    """Pool rare levels once (counts from the training rows) and optionally
    materialise the model table, so every fit scans it instead of replaying
    the feature, bucketing and pooling lineage on each pass."""
    train = prep.lines.where(~F.col("is_test"))
    data = pool_rare(prep.lines, train, prep.categorical).select(
        "order_id", "product_id", "supplier_id", "line_number", "sales", "quantity", "discount_rate", "profit",
        TARGET, "is_test", *[c for c in prep.features if c not in ("sales", "quantity", "discount_rate")],
    )
    if materialize is not None:
        data = materialize(data)
    fills = fit_fills(data.where(~F.col("is_test")), prep.numeric, prep.categorical)
    return Prepared(with_folds(data), prep.features, prep.numeric, prep.categorical, pooled=True, fills=fills, lines=data)


def _pool(prep: Prepared, df: DataFrame, train: DataFrame, cat) -> DataFrame:
    return df if prep.pooled else pool_rare(df, train, cat)


def pool_rare(df: DataFrame, train: DataFrame, categorical: Sequence[str], min_count: int = RARE_MIN) -> DataFrame:
    """Levels with fewer than ``min_count`` training rows share one level.

    One counting pass over all columns; the frequent levels come in as one
    small map per column, so no row is shuffled by a level."""
    cats = list(categorical)
    if not cats:
        return df
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cats]).unpivot([], cats, "column", "level")
    rows = long.where(F.col("level").isNotNull()).groupBy("column", "level").count().where(F.col("count") >= min_count)
    frequent: dict[str, list[str]] = {}
    for r in rows.select("column", "level").collect():  # at most (columns x bucketed levels): bucketing bounds them
        frequent.setdefault(r["column"], []).append(r["level"])
    return df.withColumns(
        {c: F.when(F.col(c).isNull() | F.col(c).cast("string").isin(sorted(frequent.get(c, []))), F.col(c)).otherwise(F.lit(RARE)) for c in cats}
    )


def train_medians(train: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact median of each numeric column: the columns are bracketed side by
    side, and one row per column reaches the driver."""
    rows = column_quantiles(train, list(numeric), [0.5], ["median"], "feature").collect()
    return {r["feature"]: float(r["median"]) for r in rows if r["median"] is not None}


def fit_fills(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Fills:
    """Medians and most frequent levels (ties to the smallest) of the training rows."""
    modes = {r["column"]: r["reference"] for r in modal_levels(train, categorical).collect()} if categorical else {}
    return Fills(train_medians(train, numeric), modes)


def model_metadata(data: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``feature, kind, level, n_rows, rank, median`` in long form.

    A level's rank is the number of levels that are more frequent (counted per
    frequency, summed over the frequencies) plus its place among those of
    its own, so no window and no cell holds all levels of a feature."""
    long = data.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "feature", "level")
    levels = long.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n_rows"))
    above = prefix_sums(
        levels.groupBy("feature", "n_rows").agg(F.count(F.lit(1)).alias("levels")), "n_rows", ["levels"], ["feature"], descending=True
    ).select("feature", "n_rows", "cum_levels")
    place = F.row_number().over(Window.partitionBy("feature", "n_rows").orderBy("level"))
    ranked = levels.withColumn("place", place).join(above, ["feature", "n_rows"]).select(
        "feature", F.lit("categorical").alias("kind"), "level", "n_rows",
        (F.col("cum_levels") + F.col("place")).cast("long").alias("rank"), F.lit(None).cast("double").alias("median"),
    )
    medians = column_quantiles(data, list(numeric), [0.5], ["median"], "feature").select(
        "feature", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("level"), F.col("n").alias("n_rows"),
        F.lit(None).cast("long").alias("rank"), "median",
    )
    return ranked.unionByName(medians)


def _sql_text(level: str) -> str:
    return "'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preprocess_stages(numeric: Sequence[str], categorical: Sequence[str], scale: bool, fills: Fills) -> list:
    """Nulls take the median or the most frequent level (held by a persisted
    SQL stage), levels become one slot each, numbers are scaled if asked.  A
    level that the training rows lack leaves all slots of its column zero."""
    stages: list = []
    num_out = [f"__num_{c}" for c in numeric]
    cat_out = [f"__cat_{c}" for c in categorical]
    filled = [f"coalesce(cast(`{c}` AS double), {fills.medians.get(c, 0.0)!r}D) AS `{o}`" for c, o in zip(numeric, num_out)]
    filled += [f"coalesce(cast(`{c}` AS string), {_sql_text(fills.modes.get(c, RARE))}) AS `{o}`" for c, o in zip(categorical, cat_out)]
    if filled:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
    idx = [f"__idx_{c}" for c in categorical]
    ohe = [f"__ohe_{c}" for c in categorical]
    if categorical:
        # unseen levels share the index after the last level, and that slot is dropped
        stages.append(StringIndexer(inputCols=cat_out, outputCols=idx, handleInvalid="keep", stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    if scale and numeric:
        stages.append(VectorAssembler(inputCols=num_out, outputCol="__num_vec", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num_vec", outputCol="__num_scaled", withMean=True, withStd=True))
        stages.append(VectorAssembler(inputCols=["__num_scaled", *ohe], outputCol="features", handleInvalid="keep"))
    else:
        stages.append(VectorAssembler(inputCols=[*num_out, *ohe], outputCol="features", handleInvalid="keep"))
    return stages


def feature_slots(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, str]]:
    """(slot name, source feature) in assembled order, from the fitted stages:
    the numeric columns as given, then each encoder's slots in level order."""
    slots = [(c, c) for c in numeric]
    if categorical:
        labels = next(st for st in model.stages if isinstance(st, StringIndexerModel)).labelsArray
        sizes = next(st for st in model.stages if isinstance(st, OneHotEncoderModel)).categorySizes
        for c, names, size in zip(categorical, labels, sizes):
            # the last index, of unseen levels, has no slot
            slots += [(f"{c}={name}", c) for name in names[: size - 1]]
    return slots


MODEL_ORDER = ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"]


def estimator(name: str, n_train: int):
    if name == "Logistic Regression":
        return LogisticRegression(labelCol=TARGET, featuresCol="features", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, maxIter=2000), True
    if name == "Decision Tree":
        return DecisionTreeClassifier(labelCol=TARGET, featuresCol="features", maxDepth=8, minInstancesPerNode=50, seed=SEED,
                                      maxMemoryInMB=1024, cacheNodeIds=True), False
    if name == "Random Forest":
        return RandomForestClassifier(labelCol=TARGET, featuresCol="features", numTrees=200, maxDepth=16, minInstancesPerNode=20,
                                      featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=1024, cacheNodeIds=True), False
    raise KeyError(name)


def held_for_validation() -> F.Column:
    """A tenth of the orders, by hash."""
    return (F.col("order_id") * 104729 + 7) % 1009 % 10 == 0


def boosted(before: PipelineModel, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, loss: Loss, rounds: int):
    """Boosting on the filled numbers and level indexes of ``before``, whose
    assembled slots the model scores."""
    slots = [source for _, source in feature_slots(before, numeric, categorical)]
    held = before.transform(rows).withColumn("__is_val", held_for_validation())
    return fit_boosted(
        held, [f"__num_{c}" for c in numeric], {f"__idx_{c}": slots.count(c) for c in categorical}, label, loss, rounds, **BOOSTING
    )


def fit(
    prep: Prepared, name: str, features: Sequence[str] | None = None, train: DataFrame | None = None, fills: Fills | None = None
) -> PipelineModel:
    """One of ``MODEL_ORDER`` fitted on all training rows (``train`` and its
    ``fills``, or those of ``prep``)."""
    feats = list(features or prep.features)
    assert_no_leakage(feats)
    num = [c for c in feats if c in prep.numeric]
    cat = [c for c in feats if c in prep.categorical]
    if train is None:
        train, fills = prep.lines.where(~F.col("is_test")), prep.fills
    pooled = _pool(prep, train, train, cat)
    fills = fills or fit_fills(pooled, num, cat)
    rows = pooled.select("order_id", F.col(TARGET).cast("double").alias(TARGET), *feats)
    n = rows.count()
    # the stages of a fit read their rows many times: up to DEALT_ROWS they are kept in few
    # tasks, so that rounds are short; more are read where the population is stored
    kept = n <= DEALT_ROWS or not prep.pooled
    if n <= DEALT_ROWS:
        rows = rows.repartition(max(1, min(-(-n // ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)), "order_id")
    if kept:
        rows = rows.persist()
    try:
        if name == "Gradient Boosting":
            before = Pipeline(stages=preprocess_stages(num, cat, False, fills)).fit(rows)
            return PipelineModel([*before.stages, boosted(before, rows, num, cat, TARGET, LOGISTIC, CLASSIFIER_ROUNDS)])
        est, scale = estimator(name, n)
        return Pipeline(stages=[*preprocess_stages(num, cat, scale, fills), est]).fit(rows)
    finally:
        if kept:
            rows.unpersist()


def n_trees(model) -> int | None:
    """Trees of an ensemble; the constant that boosting starts from is none."""
    if not hasattr(model, "getNumTrees"):
        return None
    return model.getNumTrees - isinstance(model, (GBTClassificationModel, GBTRegressionModel))


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, TARGET, vector_to_array("probability")[1].alias("p"))


def evaluate(prep: Prepared, model: PipelineModel, features: Sequence[str] | None = None, materialize=None) -> DataFrame:
    """Held-out metrics; ``materialize`` (optional) stores the scored rows once
    so the confusion pass, AUC and AP do not each re-run the model."""
    feats = list(features or prep.features)
    cat = [c for c in feats if c in prep.categorical]
    train = prep.lines.where(~F.col("is_test"))
    test = _pool(prep, prep.lines.where(F.col("is_test")), train, cat)
    scored = score(model, test)
    if materialize is not None:
        scored = materialize(scored)
    return M.eval_metrics(scored, "p", TARGET)


def fold_auc(prep: Prepared, name: str, k: int, features: Sequence[str] | None = None, fills: Fills | None = None) -> float:
    train_all = prep.data.where(~F.col("is_test"))
    feats = list(features or prep.features)
    cat = [c for c in feats if c in prep.categorical]
    tr = train_all.where(F.col("fold") != k)
    va = _pool(prep, train_all.where(F.col("fold") == k), tr, cat)
    m = fit(prep, name, feats, train=tr, fills=fills)
    return float(M.roc_auc(M.score_counts(score(m, va), "p", TARGET)).first()["roc_auc"])


def cross_validate(prep: Prepared, names: Sequence[str], features: Sequence[str] | None = None, threads: int = 4, materialize=None) -> DataFrame:
    """Grouped folds (order hash): AUC mean and population std over folds.
    ``materialize`` (optional) stores the training rows with their folds once.
    Fold fits are independent Spark jobs, submitted from a small thread pool
    so the cluster stays busy between the short jobs of each fit."""
    from concurrent.futures import ThreadPoolExecutor

    spark = prep.data.sparkSession
    tasks = [(n, k) for n in names for k in range(CV_FOLDS)]
    feats = list(features or prep.features)
    num, cat = ([c for c in feats if c in kind] for kind in (prep.numeric, prep.categorical))
    rows = prep.data.where(~F.col("is_test"))
    if materialize is not None:
        rows = materialize(rows)
        prep = replace(prep, data=rows, lines=rows)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        # those of a fold's training rows serve every model
        fills = list(pool.map(lambda k: fit_fills(rows.where(F.col("fold") != k), num, cat) if prep.pooled else None, range(CV_FOLDS)))
        aucs = list(pool.map(lambda t: fold_auc(prep, t[0], t[1], features, fills[t[1]]), tasks))
    rows = []
    for n in names:
        arr = np.array([a for (m, _), a in zip(tasks, aucs) if m == n])
        rows.append((n, round(float(arr.mean()), 4), round(float(arr.std()), 4), CV_FOLDS))
    return spark.createDataFrame(rows, "model string, cv_auc_mean double, cv_auc_std double, folds int")


def select_best(metrics: DataFrame) -> DataFrame:
    """Best ROC-AUC, ties to the simpler model (list order)."""
    return M.model_select(metrics, MODEL_ORDER)


# ---------------------------------------------------------------- importance
def _by_feature(prep: Prepared, model: PipelineModel, values: Sequence[float]) -> DataFrame:
    slots = feature_slots(model, prep.numeric, prep.categorical)
    if len(slots) != len(values):
        raise ValueError(f"{len(values)} slots in the model, {len(slots)} from its stages")
    df = prep.lines.sparkSession.createDataFrame([(f, float(x)) for (_, f), x in zip(slots, values)], "feature string, importance double")
    return df.groupBy("feature").agg(dround(F.sum("importance"), 6).alias("importance"))


def tree_importance(prep: Prepared, model: PipelineModel) -> DataFrame:
    est = model.stages[-1]
    if not hasattr(est, "featureImportances"):
        return prep.lines.sparkSession.createDataFrame([], "feature string, importance double")
    return _by_feature(prep, model, est.featureImportances.toArray().tolist())


def coef_importance(prep: Prepared, model: PipelineModel) -> DataFrame:
    return _by_feature(prep, model, [abs(x) for x in model.stages[-1].coefficients.toArray().tolist()])


def permutation_importance(
    prep: Prepared, model: PipelineModel, repeats: int = 3, group_rows: int = 20_000, materialize=None
) -> DataFrame:
    """AUC drop when one raw feature is permuted across held-out rows.

    A feature that no tree tests (or whose coefficients are all zero) cannot
    change a score: its drops are zero and nothing is scored.  Of the others,
    a row whose partner holds the same value keeps its score; only rows that
    really change are scored again, and a feature's AUC is counted over both.

    Per repeat, rows fall into hash groups of about ``group_rows`` and each takes
    the features of its successor in a hashed order (a window per group, no
    join).  The paired rows are stored once; a feature number is exploded onto
    them, the numbered feature is swapped by a CASE, and all variants go
    through one transform and one grouped AUC."""
    train = prep.lines.where(~F.col("is_test"))
    test = _pool(prep, prep.lines.where(F.col("is_test")), train, prep.categorical)
    rows = test.count()
    base_auc = M.roc_auc(M.score_counts(score(model, test), "p", TARGET)).first()["roc_auc"]
    key = ["order_id", "product_id", "supplier_id", "line_number", "sales", "quantity", "discount_rate"]
    feats = list(prep.features)
    tested = tested_features(prep, model)
    seeded = test.select(TARGET, *feats, *[F.col(c).alias(f"__k_{c}") for c in key]).withColumn(
        "repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)]))
    )
    keys = [F.col(f"__k_{c}") for c in key]
    group = F.pmod(F.xxhash64(F.lit(SEED), "repeat", *keys), F.lit(max(1, -(-rows // group_rows))))
    w = Window.partitionBy("repeat", "__g").orderBy(F.xxhash64(F.lit(SEED + 1), "repeat", *keys), *keys)
    me = F.struct(*feats)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = seeded.withColumn("__g", group).select(
        "repeat", TARGET, *feats, F.coalesce(F.lead(me).over(w), F.first(me).over(whole)).alias("__other")
    )
    paired = score(model, paired, keep=["repeat", *feats, "__other"]).withColumnRenamed("p", "__p")
    if materialize is not None:
        paired = materialize(paired)
    changed = [F.when(~F.col("__other")[f].eqNullSafe(F.col(f)), F.lit(i)) for i, f in enumerate(feats) if f in tested]
    variants = paired.withColumn("__f", F.explode(F.array_compact(F.array(*changed)))) if changed else paired.where("false").withColumn("__f", F.lit(0))
    name = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("__f") + 1).alias("feature")
    swapped = variants.select(
        name,
        "repeat",
        TARGET,
        "__p",
        *[F.when(F.col("__f") == i, F.col("__other")[f]).otherwise(F.col(f)).alias(f) for i, f in enumerate(feats)],
    )
    # a feature's scores are all scores, less those of the changed rows, plus their new ones
    by = ["feature", "repeat", "score"]
    scored = score(model, swapped, keep=["feature", "repeat", "__p"]).select(
        "feature", "repeat", F.inline(F.array(*[
            F.struct(p.alias("score"), F.lit(n).alias("rows"), (F.col(TARGET).cast("long") * n).alias("late")) for p, n in ((F.col("__p"), -1), (F.col("p"), 1))
        ]))
    )
    kept = paired.groupBy("repeat", F.col("__p").alias("score")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(TARGET).cast("long")).alias("late"))
    kept = kept.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feats])))
    counts = kept.select(*by, "rows", "late").unionByName(scored.select(*by, "rows", "late")).groupBy(*by).agg(
        F.sum("late").alias("pos"), (F.sum("rows") - F.sum("late")).alias("neg")
    ).where("pos + neg > 0")
    aucs = M.roc_auc(counts, ["feature", "repeat"])
    drops = aucs.withColumn("drop", F.lit(base_auc) - F.col("roc_auc"))
    return drops.groupBy("feature").agg(
        dround(F.avg("drop"), 6).alias("importance"), dround(F.stddev_pop("drop"), 6).alias("importance_std")
    )


def tested_features(prep: Prepared, model: PipelineModel) -> set[str]:
    """Features that can change a score of the model."""
    est = model.stages[-1]
    weights = est.featureImportances if hasattr(est, "featureImportances") else est.coefficients
    slots = feature_slots(model, prep.numeric, prep.categorical)
    return {f for (_, f), x in zip(slots, weights.toArray().tolist()) if x}


def driver_interpretation(perm: DataFrame, family: DataFrame, k: int | None = None) -> DataFrame:
    """All features ranked (one row each); ``k`` keeps the first."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    top = perm.withColumn("rank", F.row_number().over(w))
    top = top if k is None else top.where(F.col("rank") <= k)
    j = top.join(family.select(F.col("factor").alias("feature"), "effect_size", "effect_label"), "feature", "left")
    cls = F.when(F.col("importance") < 0.001, "no_detectable_effect").when(F.col("feature") == "shipping_mode", "decision_variable").otherwise(
        "secondary_driver"
    )
    return j.select("rank", "feature", "importance", "effect_size", "effect_label", cls.alias("driver_class"))


# ---------------------------------------------------------------- regression
def train_profit(prep: Prepared) -> DataFrame:
    """Profit by boosting on all training rows; held-out errors and ``n_trees``."""
    profit = F.coalesce("profit", F.lit(0.0))
    train, test = (prep.lines.where(side).withColumn("profit", profit) for side in (~F.col("is_test"), F.col("is_test")))
    cat = prep.categorical
    pooled = _pool(prep, train, train, cat)
    fills = prep.fills or fit_fills(pooled, prep.numeric, cat)
    before = Pipeline(stages=preprocess_stages(prep.numeric, cat, False, fills)).fit(pooled)
    model = boosted(before, pooled, prep.numeric, cat, "profit", SQUARED, REGRESSOR_ROUNDS)
    pred = model.transform(before.transform(_pool(prep, test, train, cat))).select("profit", F.col("prediction").alias("pred"))
    return M.regression_metrics(pred, "profit", "pred").withColumn("n_trees", F.lit(n_trees(model)))


# ---------------------------------------------------------------- inference
# The compact inference design (5 categorical + 7 numeric).
INFERENCE_CATEGORICAL = ["shipping_mode", "market", "customer_segment", "department_name", "payment_type"]
INFERENCE_NUMERIC = ["quantity", "product_price", "discount_rate", "distance_km", "daily_order_volume", "order_month", "order_dayofweek"]


def modal_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent level per column (ties to the smallest level), one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "level").where(
        F.col("level").isNotNull()
    )
    counts = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("reference"))


def design_matrix(orders: DataFrame, categorical=INFERENCE_CATEGORICAL, numeric=INFERENCE_NUMERIC) -> tuple[DataFrame, list[str], DataFrame]:
    """Dummies against the modal level + numerics; returns (frame, columns, references).

    The levels are collected (bounded by the distinct levels of five
    categorical columns) to name the dummy columns."""
    refs = modal_levels(orders, categorical)
    ref_map = {r["column"]: r["reference"] for r in refs.collect()}
    levels = (
        orders.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "column", "level")
        .where(F.col("level").isNotNull()).distinct().collect()
    )
    cols, exprs = [], []
    for r in sorted(levels, key=lambda x: (list(categorical).index(x["column"]), x["level"])):
        if r["level"] == ref_map[r["column"]]:
            continue
        name = f"{r['column']}={r['level']}"
        cols.append(name)
        exprs.append(F.when(F.col(r["column"]).cast("string") == r["level"], 1.0).otherwise(0.0).alias(name))
    frame = orders.select(TARGET, *exprs, *[F.col(c).cast("double").alias(c) for c in numeric])
    return frame, cols + list(numeric), refs


def logit_inference(orders: DataFrame) -> DataFrame:
    """Unpenalised binomial GLM; std errors and p-values when estimable."""
    frame, cols, _ = design_matrix(orders)
    data = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(frame)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=TARGET, featuresCol="features", regParam=0.0, maxIter=100)
    # every iteration reads all rows (up to a hundred times, if a level separates them): stored assembled
    labelled = data.select("features", F.col(TARGET).cast("double").alias(TARGET)).persist()
    try:
        return _logit_table(orders.sparkSession, glr, labelled, cols)
    finally:
        labelled.unpersist()


def _logit_table(spark: SparkSession, glr: GeneralizedLinearRegression, labelled: DataFrame, cols: Sequence[str]) -> DataFrame:
    none = [None] * (len(cols) + 1)
    try:
        m = glr.fit(labelled)
        se, pv = list(m.summary.coefficientStandardErrors), list(m.summary.pValues)
    except (Py4JJavaError, CapturedException):
        # a singular design has no inverse: a tiny penalty gives coefficients,
        # standard errors and p-values stay unknown
        m = glr.copy({glr.regParam: 1e-6}).fit(labelled)
        se, pv = none, none
    s = m.summary
    coefs = list(m.coefficients) + [m.intercept]
    names = [*cols, "(intercept)"]
    rows = []
    for i, n in enumerate(names):
        c = float(coefs[i])
        e = None if se[i] is None else float(se[i])
        p = None if pv[i] is None else float(pv[i])
        orr = float(np.exp(np.clip(c, -30, 30)))
        rows.append((n, round(c, 6), None if e is None else round(e, 6), None if p is None else round(p, 6), round(orr, 6),
                     None if e is None else round(float(np.exp(np.clip(c - 1.96 * e, -30, 30))), 6),
                     None if e is None else round(float(np.exp(np.clip(c + 1.96 * e, -30, 30))), 6)))
    n_obs = s.numInstances
    k = len(cols) + 1
    dev, null_dev = float(s.deviance), float(s.nullDeviance)
    fit_row = (round(float(s.aic), 3), round(dev + k * np.log(n_obs), 3), round(1 - dev / null_dev, 4) if null_dev else None, round(-dev / 2, 3), int(n_obs))
    coef_df = spark.createDataFrame(rows, "variable string, coef double, std_err double, p_value double, odds_ratio double, ci_low double, ci_high double")
    return coef_df.withColumns(
        {"aic": F.lit(fit_row[0]), "bic": F.lit(fit_row[1]), "pseudo_r2": F.lit(fit_row[2]), "log_likelihood": F.lit(fit_row[3]), "n_obs": F.lit(fit_row[4])}
    )


def odds_ratios(coefs: DataFrame) -> DataFrame:
    sig = F.col("p_value").isNotNull() & (F.col("p_value") < 0.05)
    reading = F.when(F.col("odds_ratio") > 1.05, "raises_late_odds").when(F.col("odds_ratio") < 0.95, "lowers_late_odds").otherwise("no_material_change")
    return coefs.where(F.col("variable") != "(intercept)").select(
        "variable", "odds_ratio", "ci_low", "ci_high", "p_value", sig.alias("significant"), reading.alias("reading"), F.abs("coef").alias("__abs")
    ).orderBy(F.desc("__abs")).drop("__abs")


# ---------------------------------------------------------------- VIF
VIF_NUMERIC = INFERENCE_NUMERIC


def vif_inputs(orders: DataFrame) -> tuple[DataFrame, list[str]]:
    ref = modal_levels(orders, ["shipping_mode"]).first()["reference"]
    modes = sorted(r[0] for r in orders.select("shipping_mode").distinct().collect())
    dummies = [F.when(F.col("shipping_mode") == m, 1.0).otherwise(0.0).alias(f"mode={m}") for m in modes if m != ref]
    cols = list(VIF_NUMERIC) + [f"mode={m}" for m in modes if m != ref] + ["scheduled_days"]
    frame = orders.select(*[F.col(c).cast("double").alias(c) for c in VIF_NUMERIC], *dummies, F.col("scheduled_days").cast("double"))
    return frame, cols


def covariance_table(frame: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All p(p+1)/2 sample covariances in one aggregation, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = frame.agg(*[F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (var_a, var_b, covariance)")


def vif(orders: DataFrame) -> DataFrame:
    """VIF from the covariance matrix: R^2 of each column on the others by least
    squares (pseudo-inverse; singular designs are expected).  The p x p matrix
    is the only thing that reaches the driver."""
    frame, cols = vif_inputs(orders)
    cov_rows = covariance_table(frame, cols).collect()
    idx = {c: i for i, c in enumerate(cols)}
    p = len(cols)
    C = np.zeros((p, p))
    for r in cov_rows:
        i, j = idx[r["var_a"]], idx[r["var_b"]]
        C[i, j] = C[j, i] = float(r["covariance"] or 0.0)
    keep = [i for i in range(p) if C[i, i] > 0]
    rows = []
    for i in keep:
        others = [j for j in keep if j != i]
        if not others:
            r2 = 0.0
        else:
            Coo = C[np.ix_(others, others)]
            Coi = C[others, i]
            beta = np.linalg.pinv(Coo) @ Coi
            r2 = float(Coi @ beta / C[i, i])
        v = float("inf") if r2 >= 1 - 1e-10 else 1.0 / (1.0 - r2)
        rows.append((cols[i], None if not np.isfinite(v) else round(v, 3), "Infinite" if not np.isfinite(v) else f"{v:.2f}",
                     (not np.isfinite(v)) or v > 10))
    spark = orders.sparkSession
    return spark.createDataFrame(rows, "variable string, vif double, vif_display string, problematic boolean")
