"""Schema roles, column profiles, outliers, duplicates and dataset health.

Every statistic is one aggregation pass: "dead" (<= 1 distinct value) is
``min == max`` (no distinct expand), distinct counts come from one unpivot to
``(column, value)`` grouped once, outlier fences from exact quantiles over the
same unpivot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipcast.functions.prefix import exact_quantiles
from shipcast.functions.rounding import dround

# Column roles on the canonical line table.
TARGET = "late_delivery_risk"
DECISION = "shipping_mode"
LEAKAGE = ["late_delivery_risk", "delivery_status", "real_days", "shipping_date"]
PII = ["customer_email", "customer_password", "customer_fname", "customer_lname", "customer_street", "customer_zipcode"]
IDENTIFIERS = ["order_id", "line_number", "customer_id", "product_id", "supplier_id", "order_zipcode"]
ECONOMIC = ["profit", "profit_ratio", "sales", "order_item_total", "discount", "discount_rate"]
# Known duplicate pairs (kept, dropped).
DUPLICATE_PAIRS = [
    ("order_item_total", "sales_per_customer"),
    ("profit", "benefit_per_order"),
    ("customer_id", "order_customer_id"),
    ("product_price", "order_item_product_price"),
    ("customer_id", "order_zipcode"),
]
OUTLIER_SKIP = {"latitude", "longitude", "line_number", TARGET}


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def kind(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, T.NumericType):
        return "float"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "string"


def dead_flags(df: DataFrame) -> DataFrame:
    """One row: ``<col>`` true when the column holds at most one distinct value."""
    return df.agg(
        *[((F.count(c) == 0) | (F.min(c) == F.max(c))).alias(c) for c in df.columns]
    )


def column_roles(df: DataFrame) -> DataFrame:
    cols = df.columns
    flags = dead_flags(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    stacked = flags.selectExpr(
        f"stack({len(cols)}, " + ", ".join(f"'{c}', `{c}`" for c in cols) + ") AS (column, dead)"
    )
    excluded_static = set(LEAKAGE) | set(PII) | set(IDENTIFIERS) | {TARGET}
    numeric_cols = [c for c in cols if is_numeric(types[c])]
    c = F.col("column")
    predictor = ~c.isin(*excluded_static) & ~F.col("dead")
    roles = F.array_compact(
        F.array(
            F.when(c == TARGET, F.lit("target")),
            F.when(c == DECISION, F.lit("decision")),
            F.when(c.isin(*LEAKAGE), F.lit("leakage")),
            F.when(c.isin(*PII), F.lit("pii")),
            F.when(c.isin(*IDENTIFIERS), F.lit("identifier")),
            F.when(c.isin(*ECONOMIC), F.lit("economic")),
            F.when(F.col("dead"), F.lit("dead")),
            F.when(predictor & c.isin(*numeric_cols), F.lit("numeric")),
            F.when(predictor & ~c.isin(*numeric_cols), F.lit("categorical")),
        )
    )
    return stacked.select("column", F.explode(roles).alias("role"))


def profile_columns(df: DataFrame) -> DataFrame:
    """dtype kind, missing, missing % (2 dp), distinct non-null values, an
    example (smallest text, string columns) and the numeric min."""
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    base = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count(c).alias(f"nn_{c}") for c in cols],
        *[F.min(c).cast("double").alias(f"mn_{c}") for c in cols if is_numeric(types[c])],
    )
    # distinct counts: one grouping per family of columns; whole numbers stay
    # whole, since doubles merge those beyond 2^53
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    families: dict[str, list[str]] = {}
    for c in cols:
        family = "long" if isinstance(types[c], whole) else "double" if is_numeric(types[c]) else "string"
        families.setdefault(family, []).append(c)
    distinct = None
    for family, members in families.items():
        long = df.select(*[F.col(c).cast(family).alias(c) for c in members]).unpivot([], members, "column", "value")
        text = F.min("value") if family == "string" else F.lit(None).cast("string")
        found = (
            long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("unique"), text.alias("min_text"))
        )
        distinct = found if distinct is None else distinct.unionByName(found)
    kinds = {c: kind(types[c]) for c in cols}
    stack = base.selectExpr(
        "__n",
        f"stack({len(cols)}, "
        + ", ".join(
            f"'{c}', '{kinds[c]}', `nn_{c}`, " + (f"`mn_{c}`" if is_numeric(types[c]) else "CAST(NULL AS DOUBLE)")
            for c in cols
        )
        + ") AS (column, dtype, non_null, min_value)",
    )
    out = stack.join(distinct, "column", "left")
    missing = F.col("__n") - F.col("non_null")
    return out.select(
        "column",
        "dtype",
        missing.cast("bigint").alias("missing"),
        dround(100 * missing / F.col("__n"), 2).alias("missing_pct"),
        F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
        F.when(F.col("dtype") == "string", F.col("min_text")).alias("example"),
        "min_value",
    )


def outlier_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) and f.name not in OUTLIER_SKIP and not f.name.endswith("_id")
    ]


def profile_outliers(df: DataFrame, top: int | None = None) -> DataFrame:
    """All columns with values outside q1 - 1.5 IQR .. q3 + 1.5 IQR per measure column."""
    cols = outlier_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    qs = exact_quantiles(long, "value", [0.25, 0.75], ["column"], names=["q1", "q3"]).drop("n")
    n_rows = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    iqr = F.col("q3") - F.col("q1")
    out = (
        long.join(F.broadcast(qs.where(iqr > 0)), "column")  # one row per column
        .groupBy("column")
        .agg(F.count_if((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)).alias("count"))
        .where(F.col("count") > 0)
    )
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "column"))  # one row per column
    ranked = out.select(
        place.cast("bigint").alias("rank"), "column", F.col("count").cast("bigint").alias("count"),
        dround(100 * F.col("count") / n_rows, 2).alias("pct"),
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def with_duplicate_copies(df: DataFrame) -> DataFrame:
    """The line table plus exact copies of four columns (the reference's data
    carries such byte-identical pairs)."""
    return df.withColumns(
        {
            "sales_per_customer": F.col("order_item_total"),
            "benefit_per_order": F.col("profit"),
            "order_customer_id": F.col("customer_id"),
            "order_item_product_price": F.col("product_price"),
        }
    )


def duplicate_columns(df: DataFrame, pairs: Sequence[tuple[str, str]] = DUPLICATE_PAIRS) -> DataFrame:
    present = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    flags = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in present])
    return flags.selectExpr(
        f"stack({len(present)}, " + ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in present) + ") AS (kept, dropped, identical)"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical set."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    d = df.distinct().agg(F.count(F.lit(1)).alias("d"))
    dup = n.select("n", (F.col("n") - d.select("d").scalar()).alias("dup"))
    return dup.select(
        F.col("n").alias("n_rows"),
        F.col("dup").cast("bigint").alias("n_duplicate_rows"),
        F.when(F.col("n") > 0, dround(100 * F.col("dup") / F.col("n"), 3)).otherwise(0.0).alias("duplicate_pct"),
    )


def dataset_health(df: DataFrame) -> DataFrame:
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    n_num = sum(1 for c in cols if is_numeric(types[c]))
    missing = sum([F.count(F.lit(1)) - F.count(c) for c in cols[1:]], F.count(F.lit(1)) - F.count(cols[0]))
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing_cells"))
    dup = duplicate_rows(df)
    # one scalar struct, so that the distinct runs once
    agg = agg.withColumn("__dup", dup.select(F.struct("*").alias("s")).scalar())
    return agg.select(
        "n_rows",
        F.lit(len(cols)).cast("bigint").alias("n_columns"),
        F.lit(n_num).cast("bigint").alias("n_numeric"),
        F.lit(len(cols) - n_num).cast("bigint").alias("n_categorical"),
        F.col("n_missing_cells").cast("bigint").alias("n_missing_cells"),
        dround(100 * F.col("n_missing_cells") / (F.col("n_rows") * len(cols)), 3).alias("missing_pct"),
        F.col("__dup")["n_duplicate_rows"].alias("n_duplicate_rows"),
        F.col("__dup")["duplicate_pct"].alias("duplicate_pct"),
    )
