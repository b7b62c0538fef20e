"""Exact prefix sums and quantiles without a single-task global window.

A window ``ORDER BY v`` with no partition puts every row into one task.  Here
the rows are first collapsed to one row per distinct ordering value (partial
aggregation makes that skew-proof), then cut into coarse, monotone buckets whose
bounds come from ``approx_percentile`` over the distinct values, so buckets hold
about equally many rows.  Bucket totals (a few rows per group) give each bucket
its offset; a window partitioned by ``(group, bucket)`` adds the running sum
inside the bucket.  The result is exact; the approximation only balances work.

Single quantiles need less: approximate bounds around each, an exact count of
what lies between the brackets, and a sort of what lies inside them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BUCKETS = 64
#: relative rank error of the bounds around a quantile is one over this, so a
#: bracket holds about 4 / ACCURACY of the rows
ACCURACY = 10_000
#: groups up to which their brackets are sent to the rows
BRACKET_GROUPS = 10_000
#: the same of many columns at once: rougher bounds cost a fraction of the pass,
#: and what they leave inside the brackets is still few
COLUMN_ACCURACY = 1_000
_ONE_GROUP = "__grp"


def _groups(group_cols: Sequence[str]) -> list[str]:
    return list(group_cols) if group_cols else [_ONE_GROUP]


def prefix_sums(
    df: DataFrame,
    order_col: str,
    weight_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    buckets: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<w>`` (sum of ``w`` over rows strictly before this row in
    ``order_col`` order within the group) and ``tot_<w>`` (group total).

    ``df`` must hold at most one row per ``(group, order_col)`` value.
    """
    # as many buckets as the session spreads a shuffle over, so that the rows of
    # one sorted window stay in proportion to a shuffle partition
    buckets = buckets or max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gcols = _groups(group_cols)
    if not group_cols:
        df = df.withColumn(_ONE_GROUP, F.lit(0))
    key = F.col(order_col)
    if descending:
        df = df.withColumn("__key", -key)
    else:
        df = df.withColumn("__key", key)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*gcols).agg(
        F.approx_percentile("__key", F.array(*[F.lit(p) for p in probs]), max(1000, 10 * buckets)).alias("__bounds")
    )
    if group_cols:
        # one row per group: joining it back lets AQE pick a broadcast by size
        with_b = df.join(bounds, on=gcols, how="inner")
    else:
        # a single row: a scalar subquery column, not a join
        with_b = df.withColumn("__bounds", bounds.select("__bounds").scalar())
    with_b = with_b.withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b < F.col("__key")))).drop("__bounds")
    totals = with_b.groupBy(*gcols, "__bucket").agg(
        *[F.sum(w).alias(f"__bt_{w}") for w in weight_cols]
    )
    wb = Window.partitionBy(*gcols).orderBy("__bucket")
    wall = Window.partitionBy(*gcols)
    offsets = totals.select(
        *gcols,
        "__bucket",
        *[
            (F.sum(f"__bt_{w}").over(wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"__bt_{w}")).alias(
                f"__off_{w}"
            )
            for w in weight_cols
        ],
        *[F.sum(f"__bt_{w}").over(wall).alias(f"tot_{w}") for w in weight_cols],
    )
    inner = Window.partitionBy(*gcols, "__bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    out = with_b.join(offsets, on=[*gcols, "__bucket"], how="inner").select(
        *[c for c in with_b.columns if c not in ("__key", "__bucket")],
        *[
            (F.col(f"__off_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0))).alias(f"cum_{w}")
            for w in weight_cols
        ],
        *[F.col(f"tot_{w}") for w in weight_cols],
    )
    if not group_cols:
        out = out.drop(_ONE_GROUP)
    return out


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value with its count (map-side combined)."""
    return (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, value_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _edges(probs: Sequence[float], margin: float) -> list[float]:
    return sorted({min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)})


def _rough(value: Column, edges: Sequence[float], accuracy: int) -> list[Column]:
    return [F.approx_percentile(value, F.array(*[F.lit(e) for e in edges]), accuracy), F.min(value), F.max(value)]


def _ends(probs: Sequence[float], margin: float, edges: Sequence[float], bounds: Sequence[float], least: float, most: float) -> list[tuple[float, float]]:
    at = dict(zip(edges, bounds))
    return [(least if p <= margin else at[max(p - margin, 0.0)], most if p >= 1 - margin else at[min(p + margin, 1.0)]) for p in sorted(probs)]


def _found(cells: DataFrame, probs: Sequence[float], groups: Sequence[str]) -> list | None:
    """Per group the values around every rank, from its cells in order; None
    if a rank lies outside its bracket."""
    order = Window.partitionBy(*groups).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("cum_n", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn(
        "tot_n", F.sum("n").over(Window.partitionBy(*groups))
    )
    aggs = [F.max("tot_n").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("tot_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        for side, rank in (("lo", lo), ("hi", F.least(lo + 1, F.col("tot_n") - 1))):
            cell = F.max(F.when(F.col("cum_n") <= rank, F.struct("cum_n", "__in")))
            aggs.append(cell["__in"].alias(f"{side}{i}"))
        aggs.append(F.max(h - lo).alias(f"fr{i}"))
    found = ranked.groupBy(*groups).agg(*aggs).collect()
    known = all(r[f"{side}{i}"] is not None for r in found for i in range(len(probs)) for side in ("lo", "hi"))
    return found if known else None


def _between(r, n_probs: int) -> list[float]:
    return [r[f"lo{i}"] + r[f"fr{i}"] * (r[f"hi{i}"] - r[f"lo{i}"]) for i in range(n_probs)]


def _bracketed(df: DataFrame, value_col: str, probs: Sequence[float], groups: list[str], names: list[str]) -> DataFrame | None:
    """Exact selection by bracketing; None with too many groups.

    Bounds a little below and above every quantile come from one approximate
    pass.  A second pass counts rows into cells: a value inside a bracket is a
    cell of its own, all rows between two brackets share one.  The cells of a
    group, in order, give the exact ranks.  Should a rank lie outside its
    bracket, the brackets are widened and the rows counted again."""
    spark = df.sparkSession
    one = not groups
    rows = df.where(F.col(value_col).isNotNull()).select(*groups, F.col(value_col).cast("double").alias("__v"))
    if one:
        groups, rows = [_ONE_GROUP], rows.withColumn(_ONE_GROUP, F.lit(0))
    margin = 2.0 / ACCURACY
    while True:
        edges = _edges(probs, margin)
        bounds = rows.groupBy(*groups).agg(*[a.alias(n) for a, n in zip(_rough(F.col("__v"), edges, ACCURACY), ("__b", "__min", "__max"))])
        held = bounds.limit(BRACKET_GROUPS + 1).collect()
        if len(held) > BRACKET_GROUPS:
            return None
        table = []
        for r in held:
            ends = _ends(probs, margin, edges, r["__b"], r["__min"], r["__max"])
            table.append((*[r[g] for g in groups], [lo for lo, _ in ends], [hi for _, hi in ends]))
        types = {f.name: f.dataType for f in rows.schema}
        schema = T.StructType(
            [*[T.StructField(f"__g_{g}", types[g]) for g in groups], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__lo", "__hi")]]
        )
        brackets = F.broadcast(spark.createDataFrame(table, schema))
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups])
        v = F.col("__v")
        inside = F.exists(F.arrays_zip("__lo", "__hi"), lambda b: (b["__lo"] <= v) & (v <= b["__hi"]))
        cells = (
            rows.join(brackets, same)
            .select(*groups, "__v", F.when(inside, v).otherwise(F.lit(None)).alias("__in"), F.size(F.filter("__hi", lambda b: b < v)).alias("__gap"))
            .groupBy(*groups, "__gap", "__in")
            .agg(F.count(F.lit(1)).alias("n"), F.max("__v").alias("__at"))
        )
        found = _found(cells, probs, groups)
        if found is not None:
            break
        margin *= 8
    out = [(*([] if one else [r[g] for g in groups]), r["n"], *_between(r, len(probs))) for r in found]
    if one and not out:
        out.append((0, *[None] * len(probs)))
    kinds = [] if one else [T.StructField(g, types[g]) for g in groups]
    return spark.createDataFrame(out, T.StructType([*kinds, T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]]))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str], key: str = "column") -> DataFrame:
    """``exact_quantiles`` of many columns side by side: ``key`` (the column's
    name), ``n`` and one column per probability, a row per column that holds a
    value.

    The brackets of all columns are constants of one aggregate over the rows as
    they are, so a row is not turned into one per column; only values inside a
    bracket are, which are counted before the shuffle."""
    spark = df.sparkSession
    rows = df.select(*[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(cols)])
    names, found, margin = list(names), [], 2.0 / COLUMN_ACCURACY
    kind = T.StructType([T.StructField(key, T.StringType()), T.StructField("__in", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("__at", T.DoubleType())])
    while cols:
        edges = _edges(probs, margin)
        rough = rows.agg(*[a.alias(f"{n}{i}") for i in range(len(cols)) for a, n in zip(_rough(F.col(f"__c{i}"), edges, COLUMN_ACCURACY), ("b", "min", "max"))]).first()
        aggs, inside, places = [], [], []
        for i in [i for i in range(len(cols)) if rough[f"min{i}"] is not None]:
            v = F.col(f"__c{i}")
            ends = _ends(probs, margin, edges, rough[f"b{i}"], rough[f"min{i}"], rough[f"max{i}"])
            within = reduce(lambda a, b: a | b, [(F.lit(lo) <= v) & (v <= F.lit(hi)) for lo, hi in ends])
            gap = reduce(lambda a, b: a + b, [(v > F.lit(hi)).cast("int") for _, hi in ends])
            inside.append(F.when(within, F.struct(F.lit(cols[i]).alias(key), v.alias("__in"))))
            for g in range(len(ends) + 1):
                outside = ~within & (gap == g)
                aggs += [F.count_if(outside).alias(f"n{len(places)}"), F.max(F.when(outside, v)).alias(f"at{len(places)}")]
                places.append(cols[i])
        if not inside:
            break
        around = rows.agg(*aggs).first()
        gaps = [(c, None, around[f"n{k}"], around[f"at{k}"]) for k, c in enumerate(places) if around[f"n{k}"]]
        counted = rows.select(F.inline(F.array_compact(F.array(*inside)))).groupBy(key, "__in").agg(F.count(F.lit(1)).alias("n"))
        found = _found(counted.withColumn("__at", F.col("__in")).unionByName(spark.createDataFrame(gaps, kind)), probs, [key])
        if found is not None:
            break
        margin *= 8
    fields = [T.StructField(key, T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    return spark.createDataFrame([(r[key], r["n"], *_between(r, len(probs))) for r in found], T.StructType(fields))


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    names: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas ``quantile``, DuckDB
    ``quantile_cont``) per group.

    Returns one row per group with one column per probability (``names`` or
    ``q<idx>``) plus ``n`` (non-null count).  Rows are not shuffled: they are
    counted into the few cells of ``_bracketed`` before the shuffle.  More than
    ``BRACKET_GROUPS`` groups, or given ``counts`` (one row per group and
    value), go through prefix sums of the distinct values instead; there a
    task holds a bucket, not the values of a group.

    ``bounded=True`` is for columns whose distinct values are few by nature
    (day counts, flags, coordinates of a fixed set of places): Spark's exact
    ``percentile`` keeps one map entry per distinct value, so it is safe there
    and needs a single aggregation.
    """
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    if bounded:
        v = F.col(value_col).cast("double")
        aggs = [F.count(v).alias("n")] + [F.percentile(v, F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
        base = df.where(F.col(value_col).isNotNull())
        return base.groupBy(*group_cols).agg(*aggs) if group_cols else base.agg(*aggs)
    if counts is None:
        found = _bracketed(df, value_col, probs, list(group_cols), names)
        if found is not None:
            return found
    vc = counts if counts is not None else value_counts(df, value_col, group_cols)
    ps = prefix_sums(vc, value_col, ["n"], group_cols)
    aggs = [F.max("tot_n").alias("n")]
    for p, name in zip(probs, names):
        h = (F.col("tot_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("tot_n") - 1)
        aggs.append(F.max(F.when(F.col("cum_n") <= lo, F.col(value_col))).alias(f"__lo_{name}"))
        aggs.append(F.max(F.when(F.col("cum_n") <= hi, F.col(value_col))).alias(f"__hi_{name}"))
        aggs.append(F.max(h - lo).alias(f"__fr_{name}"))
    res = ps.groupBy(*group_cols).agg(*aggs) if group_cols else ps.agg(*aggs)
    return res.select(
        *group_cols,
        "n",
        *[
            (
                F.col(f"__lo_{name}").cast("double")
                + F.col(f"__fr_{name}") * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
            ).alias(name)
            for name in names
        ],
    )


def exact_median(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), name: str = "median", bounded: bool = False) -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], group_cols, names=[name], bounded=bounded)


def scalar_quantile(df: DataFrame, value_col: str, prob: float, bounded: bool = False) -> Column:
    """A lazily evaluated scalar-subquery column holding one exact quantile."""
    return exact_quantiles(df, value_col, [prob], names=["q"], bounded=bounded).select("q").scalar()
