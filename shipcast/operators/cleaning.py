"""Cleaning: column drops, date parsing with whole-column fallback, median /
'Unknown' imputation, integer downcast plan, cancelled-shipment filter, and
high-cardinality bucketing (fit on training rows, applied everywhere)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipcast.functions.prefix import exact_quantiles
from shipcast.operators.quality import DUPLICATE_PAIRS, is_numeric
from shipcast.sources.adapter import CANCELLED_STATUS

# Columns always dropped (null, constant, personal or URL data).
DROP_ALWAYS = [
    "product_description", "customer_email", "customer_password", "product_status",
    "customer_fname", "customer_lname", "customer_street", "product_image", "order_zipcode",
]
DATE_FORMAT = "M/d/yyyy H:mm"
# Top-N levels kept per high-cardinality column.
HIGH_CARDINALITY_TOP_N = {"order_city": 30, "order_region": 25, "category_name": 25, "product_name": 25}
UNKNOWN = "Unknown"
OTHER = "Other"


def drop_plan(df: DataFrame) -> DataFrame:
    """(column, action, reason) for every column: drop-always, second of a
    duplicate pair, else kept.  Metadata only (no scan)."""
    spark = df.sparkSession
    rows = []
    dropped = {}
    for c in DROP_ALWAYS:
        if c in df.columns:
            dropped[c] = "drop_always"
    for keep, drop in DUPLICATE_PAIRS:
        if drop in df.columns and drop not in dropped and keep in df.columns and drop not in DROP_ALWAYS:
            dropped[drop] = f"duplicate_of:{keep}"
    for c in df.columns:
        rows.append((c, "drop" if c in dropped else "keep", dropped.get(c, "kept")))
    return spark.createDataFrame(rows, "column string, action string, reason string")


def clean_drop(df: DataFrame) -> DataFrame:
    plan = [r for r in drop_plan(df).collect() if r.action == "drop"]
    return df.drop(*[r.column for r in plan])


def parse_dates(df: DataFrame, col: str, fmt: str = DATE_FORMAT) -> DataFrame:
    """Parse text ``col`` with ``fmt``; unparsable -> null; if the whole
    column fails, retry with a generic cast."""
    parsed = F.try_to_timestamp(F.col(col), F.lit(fmt))
    n_ok = df.select(parsed.alias("p")).agg(F.count("p").alias("k")).select("k").scalar()
    generic = F.expr(f"try_cast(`{col}` AS TIMESTAMP)")
    return df.withColumn(col, F.when(n_ok == 0, generic).otherwise(parsed))


def impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls -> exact column median; string nulls -> 'Unknown';
    timestamps stay null."""
    cols = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric(types[c])]
    txt = [c for c in cols if isinstance(types[c], T.StringType)]
    out = df
    if num:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot([], num, "column", "value")
        med = exact_quantiles(long, "value", [0.5], ["column"], names=["m"])
        wide = med.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in num])
        meds = wide.select(F.struct(*num).alias("s")).scalar()
        out = out.withColumns(
            {c: F.when(F.col(c).isNull(), meds[c]).otherwise(F.col(c).cast("double")) for c in num}
        )
    if txt:
        out = out.fillna({c: UNKNOWN for c in txt})
    return out


def downcast_plan(df: DataFrame) -> DataFrame:
    """Smallest signed integer type holding each integer column's range."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    agg = df.agg(*[F.min(c).cast("bigint").alias(f"mn_{c}") for c in ints], *[F.max(c).cast("bigint").alias(f"mx_{c}") for c in ints])
    stacked = agg.selectExpr(
        f"stack({len(ints)}, " + ", ".join(f"'{c}', '{types[c]}', `mn_{c}`, `mx_{c}`" for c in ints) + ") AS (column, from_type, mn, mx)"
    )

    def fits(lo, hi):
        return (F.col("mn") >= lo) & (F.col("mx") <= hi)

    to = (
        F.when(fits(-128, 127), "tinyint")
        .when(fits(-32768, 32767), "smallint")
        .when(fits(-2147483648, 2147483647), "int")
        .otherwise("bigint")
    )
    return stacked.select("column", "from_type", to.alias("to_type"))


def downcast(df: DataFrame) -> DataFrame:
    """The rows with each integer column in the smallest type that holds its
    range, and doubles as floats; the ranges come from one aggregation."""
    to = {r["column"]: r["to_type"] for r in downcast_plan(df).collect()}  # one row per integer column
    to |= {f.name: "float" for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in df.columns])


def filter_cancelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("delivery_status") != CANCELLED_STATUS)


def bucket_fit(train: DataFrame, top_n: dict = HIGH_CARDINALITY_TOP_N) -> DataFrame:
    """Top-N levels by count per column, one pass over an unpivot; ties by level."""
    cols = [c for c in top_n if c in train.columns]
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "level")
    counts = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "level")
    limit = F.lit(None).cast("int")
    for c in cols:
        limit = F.when(F.col("column") == c, F.lit(top_n[c])).otherwise(limit)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "column", "level", "n", F.col("rank").cast("bigint").alias("rank")
    )


def bucket_apply(df: DataFrame, fitted: DataFrame, top_n: dict = HIGH_CARDINALITY_TOP_N) -> DataFrame:
    """Level if it was kept at fit time, else 'Other' (unseen levels included).
    The fitted table is at most sum(N) rows; AQE broadcasts it by size."""
    out = df
    for c in [c for c in top_n if c in df.columns]:
        kept = fitted.where(F.col("column") == c).select(F.col("level").alias(f"__k_{c}"))
        # bounded by N levels per column (a parameter), so broadcast is safe at any scale
        out = out.join(F.broadcast(kept), F.col(c).cast("string") == F.col(f"__k_{c}"), "left").withColumn(
            c, F.when(F.col(f"__k_{c}").isNotNull(), F.col(c).cast("string")).otherwise(F.lit(OTHER))
        ).drop(f"__k_{c}")
    return out
