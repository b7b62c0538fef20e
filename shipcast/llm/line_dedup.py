"""Line dedup by distributed prefix doubling over line-ID sequences.

Suffixes of the documents' line sequences are ranked by doubling: ranks of
runs of 2**k lines give, in pairs, ranks of runs of 2**(k+1).  Ranks are order
preserving, so equal ranks are exactly the intervals of the suffix array whose
common prefix is at least that long; a position whose rank is alone has no
repeat and leaves.  A run of any length lies in one interval when the ranks of
its two (overlapping) power-of-two halves agree.  Each interval keeps its
first occurrence; lines of later occurrences are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shipcast.llm.common import giving_back, ship_package, staged, text_key

#: a repeated run is deleted if it has at least so many characters
MIN_CHARS = 20
KEY = ["doc_id", "text_key"]
#: an interval is hot above LEAST_HOT occurrences and a HOT_INTERVALS-th of all
LEAST_HOT, HOT_INTERVALS = 2_000, 100_000


def _ranked(spark: SparkSession, names: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Order-preserving rank of each row: a range sort, then ids that grow with
    the sorted position; written at once, so that they are fixed."""
    return staged(spark, names.orderBy(*cols).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Positions of lines that occur at least twice, with the line's rank."""
    # the hash of the text comes before the generator, else it is taken per line
    keyed = docs.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls")
    )
    lines = keyed.select(*KEY, F.posexplode("ls").alias("i", "line")).select(*KEY, "i", F.length("line").alias("chars"), F.xxhash64("line").alias("x"), F.hash("line").alias("y"))
    names = lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    names = _ranked(spark, names, ["x", "y"], "line-ranks")
    return staged(spark, lines.join(names, ["x", "y"]).select(*KEY, "i", "chars", "rank").distinct(), "repeated-lines")


def minimal_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """Least runs of adjacent repeated lines with ``min_chars`` characters, from
    each line forward and to each line backward.

    They depend on content alone, so equal text has equal runs, and every
    longer run is a union of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, key, places in zip(pdf["doc_id"], pdf["text_key"], pdf["places"]):
                at = np.array([p["i"] for p in places])
                total = np.concatenate([[0], np.cumsum([p["chars"] for p in places])])
                part = np.cumsum(np.diff(at, prepend=at[0]) != 1)  # stretches of adjacent lines
                n = np.arange(len(at))
                # forward: first end with enough characters; backward: last start
                end = np.searchsorted(total, total[:-1] + min_chars)
                start = np.searchsorted(total, total[1:] - min_chars, side="right") - 1
                end = np.maximum(end, n + 1)
                start = np.minimum(start, n)
                forward = end <= len(at)
                forward[forward] &= part[end[forward] - 1] == part[forward]
                backward = start >= 0
                backward[backward] &= part[start[backward]] == part[backward]
                runs = {(int(at[s]), int(e - s)) for s, e in zip(n[forward], end[forward])}
                runs |= {(int(at[s]), int(e + 1 - s)) for s, e in zip(start[backward], n[backward])}
                doc = None if pd.isna(doc) else int(doc)
                out += [(doc, int(key), s, size) for s, size in sorted(runs)]
            frame = pd.DataFrame(out, columns=["doc_id", "text_key", "start", "size"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return (
        lines.groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("i", "chars"))).alias("places"))
        .mapInPandas(giving_back(run), "doc_id long, text_key long, start int, size int")
    )


def later_copies(spark: SparkSession, docs: DataFrame, min_chars: int) -> DataFrame:
    """Runs ``doc_id, text_key, start, size`` that also occur earlier (smaller
    doc_id, then text key, then place)."""
    ship_package(spark)
    level = repeated_lines(spark, docs)
    runs = staged(spark, minimal_runs(level, min_chars), "runs")
    longest = runs.agg(F.max("size")).first()[0] or 0
    level = level.select(*KEY, "i", "rank")
    k, found = 0, []
    while 2**k <= longest:
        # runs of 2**k up to 2**(k+1) - 1 lines are named by two ranks of this level
        here = runs.where(F.col("size").between(2**k, 2 ** (k + 1) - 1)).alias("r")
        head, tail = level.alias("h"), level.alias("t")
        r, h, t = (lambda c, p=p: F.col(f"{p}.{c}") for p in "rht")
        on = lambda p, place: (
            r("doc_id").eqNullSafe(p("doc_id")) & (r("text_key") == p("text_key")) & (place == p("i"))
        )
        named = here.join(head, on(h, r("start")))
        named = named.join(tail, on(t, r("start") + r("size") - 2**k)) if k else named
        found.append(
            named.select(
                *[r(c).alias(c) for c in (*KEY, "start", "size")],
                h("rank").alias("first"),
                (t if k else h)("rank").alias("last"),
            )
        )
        if 2 ** (k + 1) > longest:
            break
        a, b = level.alias("a"), level.alias("b")
        pairs = a.join(
            b,
            F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
            & (F.col("a.text_key") == F.col("b.text_key"))
            & (F.col("a.i") + 2**k == F.col("b.i")),
        ).select(
            F.col("a.doc_id").alias("doc_id"),
            F.col("a.text_key").alias("text_key"),
            F.col("a.i").alias("i"),
            F.col("a.rank").alias("first"),
            F.col("b.rank").alias("last"),
        )
        pairs = staged(spark, pairs, "doubled")
        names = pairs.groupBy("first", "last").agg(F.count("*").alias("n")).where("n > 1").select("first", "last")
        names = _ranked(spark, names, ["first", "last"], "run-ranks")
        level = staged(spark, pairs.join(names, ["first", "last"]).select(*KEY, "i", "rank"), "level")
        k += 1
    if not found:
        return runs
    named = found[0]
    for more in found[1:]:
        named = named.unionByName(more)
    named = staged(spark, named, "named-runs")
    place = F.struct("doc_id", "text_key", "start")
    # (size, first, last) is one interval of the suffix array
    keys = ["size", "first", "last"]
    first = named.groupBy(*keys).agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    first = staged(spark, first, "intervals")
    # intervals with many occurrences, at most HOT_INTERVALS of them, are looked
    # up where the occurrences lie; only the others are shuffled by interval
    many = max(LEAST_HOT, named.count() // HOT_INTERVALS)
    hot, cold = (first.where(c).select(*keys, "origin") for c in (F.col("n") > many, F.col("n") <= many))
    found = named.join(F.broadcast(hot), keys).unionByName(
        named.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )
    return found.where(place > F.col("origin")).select(*KEY, "start", "size")


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with ``kept_text, n_lines, n_removed`` added (replaced if there).

    Lines end at ``\\n``.  A line is deleted if it lies in a run of lines of at
    least ``min_chars`` characters in total that also occurs earlier: in a
    document of smaller doc_id (null is smallest), or before it in the same
    document; both may overlap.  Runs never cross documents.  Documents of
    equal doc_id are ordered by a hash of their text; of rows that agree in both, one
    keeps its lines.  Null text is one empty line; an empty table gives no rows.
    """
    late = later_copies(spark, docs.select("doc_id", "text"), min_chars)
    gone = (
        late.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("i"))
        .distinct()
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("i")).alias("gone"))
        .select(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key"), "gone")
    )
    # the row travels as one struct, so that no column name of it can clash
    keyed = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    copy = F.row_number().over(W.partitionBy("row.doc_id", "key").orderBy("key"))
    joined = keyed.withColumn("copy", copy).join(
        gone, F.col("row.doc_id").eqNullSafe(F.col("g_doc")) & (F.col("key") == F.col("g_key")), "left"
    )
    text = F.coalesce("row.text", F.lit(""))
    lines = F.split(text, "\n", -1)
    whole = (F.col("copy") > 1) & (F.length(F.regexp_replace(text, "\n", "")) >= min_chars)
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = (
        F.when(whole, F.array().cast("array<string>"))
        .when(F.col("gone").isNull(), F.col("lines"))
        .otherwise(F.transform(numbers, lambda i: F.get(F.col("lines"), i)))
    )
    added = ("kept_text", "n_lines", "n_removed")
    return (
        joined.select("row", "copy", "gone", lines.alias("lines"))
        .select("row", "lines", kept.alias("kept"))
        .select(
            *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added],
            F.array_join("kept", "\n").alias("kept_text"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        )
    )
