"""Positions of rows in a sorted group, whatever the size of the group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipcast.llm.common import staged

#: what identifies the part of a group that one range partition holds
PART = "part"


def ranked(spark: SparkSession, df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (from 1, nulls first in ``order``) and ``n``, the
    rows of the group, plus ``part``.

    Rows are range-partitioned by group and order, so a group of any size is
    spread over as many partitions as it fills; a window ranks each part and
    the counted rows of the parts before give its offset.  Rows equal in
    ``order`` stand in any order.  ``group`` must not be null.
    """
    asc = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = staged(spark, df.repartitionByRange(*asc).withColumn(PART, F.spark_partition_id()), name)
    whole = Window.partitionBy(group)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        dealt.groupBy(PART, group)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            PART, group, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")
        )
    )
    place = F.row_number().over(Window.partitionBy(PART, group).orderBy(*asc[1:]))
    return (
        dealt.withColumn("place", place)
        .join(parts, [PART, group])
        .select(*dealt.columns, (F.col("before") + F.col("place")).alias("pos"), "n")
    )


def running(df: DataFrame, group: str, totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """A ranked frame with, per entry ``name: (value, aggregate)``, the
    aggregate (``sum`` or ``bit_xor``) of the group's values up to each row.

    The same two levels as ``ranked``: per part a window, and what the parts
    before add up to.
    """
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    before = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(PART, group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    valued = df.select("*", *[value.alias(f"v_{name}") for name, (value, _) in totals.items()])
    parts = valued.groupBy(PART, group).agg(*[agg[kind](f"v_{name}").alias(f"s_{name}") for name, (_, kind) in totals.items()])
    parts = parts.select(
        PART, group, *[F.coalesce(agg[kind](f"s_{name}").over(before), F.lit(0)).alias(f"b_{name}") for name, (_, kind) in totals.items()]
    )
    rows = reduce(
        lambda d, item: d.withColumn(f"w_{item[0]}", agg[item[1][1]](f"v_{item[0]}").over(upto)), totals.items(), valued
    )
    return rows.join(parts, [PART, group]).select(
        *df.columns, *[join[kind](F.col(f"b_{name}"), F.col(f"w_{name}")).alias(name) for name, (_, kind) in totals.items()]
    )
