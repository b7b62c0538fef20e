"""N-gram Jaccard join by MinHash banding.

1. Texts of equal word sequence are one class ("node"); each gets a MinHash
   signature.  Rows per band and bands follow from threshold and recall.
2. A shuffle on band hashes links each node to the smallest node of its
   bucket; components of those links hold every candidate pair.
3. Within a component the full shingle sets are compared exactly, in pairs of
   chunks of bounded size: tasks return link counts and a spanning forest,
   never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shipcast.llm import hashing
from shipcast.llm.common import giving_back, join_counted, ship_package, staged, text_key
from shipcast.llm.decontaminate import GAP, small_side
from shipcast.llm.graph import components

#: nodes in one chunk of a large component
CHUNK = 384
#: candidate nodes up to which their keys are broadcast to the text scan
BROADCAST_NODES = 1_000_000


def band_shape(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): enough bands that a pair at the threshold meets in one
    with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 2**63, n, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, node, n, bands``: a hash of the text, key of the word
    sequence, shingles with repeats, band hashes (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _seeds(bands * rows)
        odd = np.uint64(2) * np.arange(1, rows + 1, dtype=np.uint64) + np.uint64(1)
        for batch in batches:
            for at, raw in hashing.batches_of(batch.column(2).to_pylist()):
                words, stops = hashing.word_hashes(raw)
                grams, ends = hashing.shingles(words, stops, size)
                begins = np.concatenate([[0], ends[:-1]])
                live = np.flatnonzero(ends > begins)
                keys = np.zeros((len(raw), bands), np.uint64)
                if len(live):
                    buffer = np.empty_like(grams)
                    for band in range(bands):
                        key = np.full(len(live), band + 1, np.uint64)
                        for row in range(rows):
                            k = band * rows + row
                            np.multiply(grams, a[k], out=buffer)
                            buffer += b[k]
                            key = hashing.mix(key + np.minimum.reduceat(buffer, begins[live]) * odd[row])
                        keys[live, band] = key
                first = np.concatenate([[0], stops[:-1]])
                nodes = [hashing.sequence_key(words[x:y]) for x, y in zip(first, stops)]
                n = (ends - begins).astype(np.int32)
                lists = [k.view(np.int64) if m else [] for k, m in zip(keys, n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(raw)),
                        batch.column(1).slice(at, len(raw)),
                        pa.array(nodes, pa.binary()),
                        pa.array(n, pa.int32()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "node", "n", "bands"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return keyed.mapInArrow(giving_back(run), "doc_id long, text_key long, node binary, n int, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows of candidate nodes with their sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = lambda name: batch.column(names.index(name))
            wanted = column("node").to_pylist()
            for at, raw in hashing.batches_of(column("text").to_pylist()):
                words, stops = hashing.word_hashes(raw)
                grams, ends = hashing.shingles(words, stops, size)
                first, begins = np.concatenate([[0], stops[:-1]]), np.concatenate([[0], ends[:-1]])
                # a repeated doc_id may carry another text than the node's
                right = [
                    k for k in range(len(raw)) if hashing.sequence_key(words[first[k] : stops[k]]) == wanted[at + k]
                ]
                take = pa.array([at + k for k in right], pa.int64())
                sets = [np.unique(grams[begins[k] : ends[k]]).tobytes() for k in right]
                yield pa.RecordBatch.from_arrays(
                    [*(column(c).take(take) for c in ("comp", "node", "copies", "chunks")), pa.array(sets, pa.binary())],
                    ["comp", "node", "copies", "chunks", "grams"],
                )

    return docs.mapInArrow(giving_back(run), "comp binary, node binary, copies long, chunks int, grams binary").dropDuplicates(["node"])


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard at or above the threshold.

    ``right`` None: all pairs within ``left``.  Only shingles that at least
    two sets hold are looked at, a bounded number of columns at a time.
    """
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    renumber = np.cumsum(count > 1) - 1
    column = renumber[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, split = len(left), len(left) if right is not None else 0
    common = np.zeros((n, len(sets) - split))
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part[:n] @ part[split:].T
    union = sizes[:n, None] + sizes[None, split:] - common
    linked = common >= threshold * union - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray, left: list[bytes], right: list[bytes] | None) -> list[tuple[bytes, bytes]]:
    """A spanning forest of a block's links, by breadth-first search."""
    names = left if right is None else left + right
    shift = 0 if right is None else len(left)
    if right is None:
        near = [np.flatnonzero(row) for row in linked]
    else:
        near = [np.flatnonzero(row) + shift for row in linked] + [np.flatnonzero(col) for col in linked.T]
    seen, out = np.zeros(len(names), bool), []
    for start in range(len(names)):
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            x = queue.pop()
            fresh = near[x][~seen[near[x]]]
            seen[fresh] = True
            out += [(names[x], names[y]) for y in fresh]
            queue += fresh.tolist()
    return out


def _verify(threshold: float):
    """Streams rows sorted by (comp, i, j) and compares each block."""

    def block(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][1], rows[0][2]
        sides = [[r for r in rows if r[3] == i], [r for r in rows if r[3] == j] if i != j else None]
        grams = [None if s is None else [np.frombuffer(r[6], np.uint64) for r in s] for s in sides]
        if not sides[0] or (sides[1] is not None and not sides[1]):
            return []
        linked = block_links(grams[0], grams[1], threshold)
        out = []
        names = [None if s is None else [r[4] for r in s] for s in sides]
        copies = [None if s is None else np.array([r[5] for r in s]) for s in sides]
        if sides[1] is None:
            out += zip(names[0], (linked * copies[0][None, :]).sum(1).tolist(), [None] * len(names[0]))
        else:
            out += zip(names[0], (linked * copies[1][None, :]).sum(1).tolist(), [None] * len(names[0]))
            out += zip(names[1], (linked * copies[0][:, None]).sum(0).tolist(), [None] * len(names[1]))
        out = [r for r in out if r[1]]
        return out + [(a, 0, b) for a, b in _forest(linked, names[0], names[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        done: list[tuple] = []
        for pdf in batches:
            for row in pdf[["comp", "i", "j", "chunk", "node", "copies", "grams"]].itertuples(index=False, name=None):
                if held and held[0][:3] != row[:3]:
                    done += block(held)
                    held = []
                held.append(row)
            if done:
                yield pd.DataFrame(done, columns=["node", "links", "other"])
                done = []
        if held:
            done = block(held)
            if done:
                yield pd.DataFrame(done, columns=["node", "links", "other"])

    return run


def near_duplicates(
    spark: SparkSession, docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.99999
) -> DataFrame:
    """``doc_id, text_key, class_id, n_links, class_key`` for every row of ``doc_id, text``.

    Documents link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``threshold``; n_links counts a document's linked
    other documents (rows), copies included.  A class is a connected component of links; its id is its
    smallest doc_id; ``class_key`` names it uniquely (null without words).  Texts without words (null, empty) link to nothing and
    are classes by themselves, named by their doc_id.  Other columns are
    ignored; an empty table gives no rows.
    """
    ship_package(spark)
    bands, rows = band_shape(threshold, recall)
    docs = docs.select("doc_id", "text")
    signed = staged(spark, signatures(docs, size, bands, rows), "signatures")
    with_words = signed.where("n > 0")
    nodes = staged(
        spark,
        with_words.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")
        ),
        "nodes",
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1")
    buckets = staged(spark, buckets, "buckets")
    pairs = join_counted(keyed, buckets, "key", "m", nodes.count() * bands).where("node != first")
    edges = pairs.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    candidate = staged(spark, components(spark, edges), "candidates")
    sizes = candidate.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = staged(
        spark,
        candidate.join(sizes, "root")
        .join(nodes.select("node", "rep", "copies"), "node")
        .select("rep", F.col("root").alias("comp"), "node", "copies", "chunks"),
        "members",
    )
    found = docs.join(small_side(members, BROADCAST_NODES), F.col("doc_id").eqNullSafe(F.col("rep")))
    grams = staged(spark, _sets(found.select("text", "comp", "node", "copies", "chunks"), size), "shingle-sets")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = (
        grams.withColumn("chunk", chunk)
        .withColumn("other", other)
        .select("comp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "copies", "grams")
    )
    verified = staged(
        spark,
        dealt.repartition("comp", "i", "j")
        .sortWithinPartitions("comp", "i", "j", "node")
        .mapInPandas(giving_back(_verify(threshold)), "node binary, links long, other binary"),
        "links",
    )
    classes = components(spark, verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = verified.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "rep", "copies").join(classes, "node", "left").join(counts, "node", "left")
    known = staged(spark, known.withColumn("root", F.coalesce("root", "node")), "known")
    names = known.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("m"))
    results = join_counted(known, staged(spark, names, "classes"), "root", "m", known.count()).select(
        "node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("class_key"), "copies"
    )
    return (
        join_counted(with_words.select("doc_id", "text_key", "node"), staged(spark, results, "results"), "node", "copies", with_words.count())
        .select("doc_id", "text_key", "class_id", "n_links", "class_key")
        .unionByName(
            signed.where("n = 0").select(
                "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                F.lit(None).cast("binary").alias("class_key"),
            )
        )
    )


def one_of_each(spark: SparkSession, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: its smallest (doc_id,
    text hash); of rows that agree in both one stays.  Texts without words all
    stay.  ``classes`` is the stored result of :func:`near_duplicates`."""
    place = F.struct("doc_id", "text_key")
    first = classes.where("class_key is not null").groupBy("class_key").agg(F.min(place).alias("p")).select("p.*")
    gone = staged(
        spark,
        classes.where("class_key is not null").select("doc_id", "text_key").distinct().exceptAll(first),
        "copies",
    )
    kept = without(docs, gone)
    again = classes.where("class_key is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    if again.isEmpty():
        return kept
    # rows repeated as a whole
    base = kept.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    number = F.row_number().over(W.partitionBy("row.doc_id", "key").orderBy("key"))
    worded = F.length(F.regexp_replace(F.coalesce("row.text", F.lit("")), GAP, "")) > 0
    return base.withColumn("n", number).where((F.col("n") == 1) | ~worded).select("row.*")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of text) is not in ``gone``."""
    keys = small_side(gone.select(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key")), BROADCAST_NODES)
    rows = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
    match = (F.col("key") == F.col("g_key")) & F.col("row.doc_id").eqNullSafe(F.col("g_doc"))
    return rows.join(keys, match, "left_anti").select("row.*")
