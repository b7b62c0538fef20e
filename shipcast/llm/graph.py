"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import join_counted, staged


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``a, b``; the root is the
    smallest node of its component.

    Each round is two aggregations (combined before the shuffle) and two
    joins, in which nodes of very many links are not shuffled; the number of
    rounds grows with the logarithm of the component size.  Every round is
    written to the shared checkpoint folder.
    """
    links = staged(
        spark,
        edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    n = links.count()
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        least = staged(spark, least, "least")
        large = join_counted(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(spark, large, "large-star")
        least = staged(spark, large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")
        small = join_counted(large, least, "hi", "n", n)
        links = staged(
            spark,
            small.select("hi", F.col("m").alias("lo"))
            .unionByName(small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct(),
            "small-star",
        )
        # done when every node points at one root and no root points on
        shape = links.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("nodes")).first()
        if shape.n == shape.nodes and links.join(links.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            break
        n = shape.n
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
