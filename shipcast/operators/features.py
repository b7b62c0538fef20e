"""Decision-time features (calendar, cyclic, congestion, economics, distance).

Frame-level statistics (daily volume, median origin) are computed by Spark and
joined back: the day count is a partial aggregate joined on day (AQE picks
broadcast when the day table is small; a hot day is split by skew join), the
medians are exact scalar subqueries over distinct-value counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipcast.functions.lookup import lookup

from shipcast.functions.prefix import scalar_quantile

EARTH_RADIUS_KM = 6371.0


def calendar_columns(ts: Column) -> list[Column]:
    dow = F.weekday(ts)  # Monday = 0
    return [
        F.year(ts).alias("order_year"),
        F.month(ts).alias("order_month"),
        dow.alias("order_dayofweek"),
        F.hour(ts).alias("order_hour"),
        F.quarter(ts).alias("order_quarter"),
        F.when(dow >= 5, 1).otherwise(0).alias("order_is_weekend"),
    ]


def cyclic_columns(month: Column, dow: Column) -> list[Column]:
    two_pi = 2 * math.pi
    return [
        F.sin(F.lit(two_pi) * month / 12).alias("month_sin"),
        F.cos(F.lit(two_pi) * month / 12).alias("month_cos"),
        F.sin(F.lit(two_pi) * dow / 7).alias("dow_sin"),
        F.cos(F.lit(two_pi) * dow / 7).alias("dow_cos"),
    ]


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 or null (reference: replace(0, NaN) + fillna(0))."""
    return F.coalesce(F.try_divide(num, F.when(den != 0, den)), F.lit(0.0))


def log1p_clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def haversine_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    rl, rn, r0, n0 = F.radians(lat), F.radians(lon), F.radians(lat0), F.radians(lon0)
    a = F.pow(F.sin((rl - r0) / 2), 2) + F.cos(r0) * F.cos(rl) * F.pow(F.sin((rn - n0) / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def daily_volume(df: DataFrame, ts_col: str = "order_date") -> DataFrame:
    day = F.to_date(F.col(ts_col))
    counts = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).cast("double").alias("daily_order_volume"))
    return lookup(df.withColumn("__day", day), counts, ["__day"]).drop("__day")


def engineer_features(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    out = df
    if "order_date" in cols:
        out = out.select("*", *calendar_columns(F.col("order_date")))
        out = out.select("*", *cyclic_columns(F.col("order_month"), F.col("order_dayofweek")))
        out = daily_volume(out)
    extra = []
    if {"sales", "discount"} <= cols:
        extra.append(safe_ratio(F.col("discount"), F.col("sales")).alias("discount_depth"))
    if {"sales", "quantity"} <= cols:
        extra.append(safe_ratio(F.col("sales"), F.col("quantity")).alias("unit_value"))
    if "product_price" in cols:
        extra.append(log1p_clipped(F.col("product_price")).alias("log_product_price"))
    if "order_item_total" in cols:
        extra.append(log1p_clipped(F.col("order_item_total")).alias("log_order_value"))
    if {"latitude", "longitude"} <= cols:
        # geocodes of a fixed set of places: bounded distinct values
        out = out.withColumns(
            {
                "__lat0": scalar_quantile(df, "latitude", 0.5, bounded=True),
                "__lon0": scalar_quantile(df, "longitude", 0.5, bounded=True),
            }
        )
        extra.append(haversine_km(F.col("latitude"), F.col("longitude"), F.col("__lat0"), F.col("__lon0")).alias("distance_km"))
    return out.select("*", *extra).drop("__lat0", "__lon0")
