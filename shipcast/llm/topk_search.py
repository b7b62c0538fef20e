"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: ``entries`` of (term, integer weight).  The queries are taken
in blocks of a bounded number of entries, sent to every task.  A task turns
the rows it reads, block by block, into posting lists; every term of a query
scatters its weighted postings into the query's dense array of scores, one
place per row.  A partition selection keeps the best k of the array, the task
merges them over its blocks, and a window merges the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipcast.llm.common import ship_package, staged

#: entries of the queries that are sent out at once
QUERY_ENTRIES = 1 << 20
#: rows that become posting lists together
ROW_BLOCK = 1 << 14
#: scores held at once
SCORES = 1 << 21
FOUND = "q long, query_id long, vec_id long, rid long, score long"
LONG = np.iinfo(np.int64)


def int_entries(vector: Column, scale: float) -> Column:
    """Dense vector -> entries (position, floor(scale * x)) without zeros; null
    where the vector is null or holds a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform(vector, lambda x, i: F.struct(i.cast("long").alias("term"), F.floor(x.cast("double") * scale).alias("weight")))
    return F.when(F.coalesce(ok, F.lit(False)), F.filter(weights, lambda e: e["weight"] != 0))


class Rows:
    """Sparse rows as arrays; ids sort with nulls last."""

    def __init__(self, batch: pa.Table) -> None:
        self.rid = batch.column("rid").to_numpy()
        ids = batch.column("id").combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        entries = batch.column("entries").combine_chunks()
        self.sizes = np.asarray(entries.value_lengths(), np.int64)
        flat = entries.flatten()
        self.term = flat.field("term").to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = flat.field("weight").to_numpy(zero_copy_only=False).astype(np.int64)

    def reach(self) -> float:
        """No sum of products with another row goes beyond the product of this
        and the other's largest weight."""
        if not len(self.weight):
            return 0.0
        return float(np.abs(self.weight.astype(np.float64)).max()) * float(self.sizes.max())


class Postings:
    """Posting lists of a block of rows, which are put in order of id."""

    def __init__(self, rows: Rows) -> None:
        order = np.lexsort((rows.rid, rows.id, rows.null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.n = len(order)
        self.rid, self.id, self.null = rows.rid[order], rows.id[order], rows.null[order]
        row = np.repeat(place, rows.sizes)
        by = np.lexsort((row, rows.term))
        term, row, weight = rows.term[by], row[by], rows.weight[by]
        new = np.ones(len(by), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        if not new.all():  # a term that a row holds twice counts with the sum of its weights
            weight = np.add.reduceat(weight, np.flatnonzero(new))
            term, row = term[new], row[new]
        self.row, self.weight = row, weight
        terms, starts = np.unique(term, return_index=True)
        stops = np.append(starts[1:], len(term))
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(terms, starts, stops)}

    def scores(self, terms: list[np.ndarray], weights: list[np.ndarray], exact: bool) -> np.ndarray:
        """Dense scores of a few queries; Python integers where ``exact``."""
        kind = object if exact else np.int64
        out = np.zeros((len(terms), self.n), kind)
        held = self.weight.astype(kind)
        for line, ts, ws in zip(out, terms, weights):
            for t, w in zip(ts.tolist(), ws.tolist()):
                span = self.lists.get(t)
                if span is None:
                    continue
                a, b = span
                if b - a == self.n:  # every row has the term
                    line += held[a:b] * w
                else:
                    line[self.row[a:b]] += held[a:b] * w
        return out


def _best(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k best of every query: high scores first, then small ids, nulls last."""
    score = found["score"]
    down = -score if score.dtype != object else np.array([-x for x in score], object)
    order = np.lexsort((found["rid"], found["id"], found["null"], down, found["q"]))
    q = found["q"][order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return {c: v[order[rank < k]] for c, v in found.items()}


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of every score that is among the k best or ties with the last."""
    n = scores.shape[1]
    if n <= k:
        return np.divmod(np.arange(scores.size), n)
    last = (np.sort(scores, 1) if scores.dtype == object else np.partition(scores, n - k, 1))[:, n - k]
    return np.nonzero(scores >= last[:, None])


def _search(queries: Rows, k: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    stops = np.cumsum(queries.sizes)
    terms = np.split(queries.term, stops[:-1])
    weights = np.split(queries.weight, stops[:-1])
    best: dict[str, np.ndarray] | None = None

    def take(table: pa.Table) -> None:
        nonlocal best
        rows = Rows(table)
        exact = rows.reach() * queries.reach() >= 2.0**62
        post = Postings(rows)
        step = max(1, SCORES // post.n)
        for at in range(0, len(terms), step):
            scores = post.scores(terms[at : at + step], weights[at : at + step], exact)
            q, place = _select(scores, k + 1)  # one more, since a query may meet itself
            value = scores[q, place]
            if exact:  # results are longs
                value = np.array([min(max(int(v), LONG.min), LONG.max) for v in value], object)
            found = {"q": q + at, "score": value, "id": post.id[place], "null": post.null[place], "rid": post.rid[place]}
            other = found["rid"] != queries.rid[found["q"]]
            found = {c: v[other] for c, v in found.items()}
            if best is not None:
                found = {c: np.concatenate([best[c], v]) for c, v in found.items()}
            best = found
        best = _best(best, k)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROW_BLOCK:
            table = pa.Table.from_batches(held)
            for a in range(0, size - ROW_BLOCK + 1, ROW_BLOCK):
                take(table.slice(a, ROW_BLOCK))
            held, size = table.slice(size - size % ROW_BLOCK).to_batches(), size % ROW_BLOCK
    if size:
        take(pa.Table.from_batches(held))
    if best is not None:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(queries.rid[best["q"]]),
                pa.array(queries.id[best["q"]], mask=queries.null[best["q"]]),
                pa.array(best["id"], mask=best["null"]),
                pa.array(best["rid"]),
                pa.array(best["score"].astype(np.int64)),
            ],
            schema=schema,
        )


def top_k(spark: SparkSession, rows: DataFrame, k: int, is_query: Column) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query row (``is_query``) its k
    best other rows by the sum of products of the weights of shared terms.

    ``rows`` has ``id`` (long) and ``entries`` (array of struct ``term long,
    weight long``).  Rows of null entries take no part; a null term or weight
    is no entry; empty entries score 0.  Ties go to the smaller id, nulls last;
    a repeated row is another row, so a copy of a query is its candidate.
    Fewer candidates than k give fewer rows; an empty table gives none.
    Scores beyond 64 bits are counted exactly and returned as the nearest long.
    Other columns are ignored.
    """
    ship_package(spark)
    usable = F.filter("entries", lambda e: e["term"].isNotNull() & e["weight"].isNotNull())
    kept = rows.where(F.col("entries").isNotNull()).select(
        F.monotonically_increasing_id().alias("rid"), "id", usable.alias("entries"), F.coalesce(is_query, F.lit(False)).alias("query")
    )
    kept = staged(spark, kept, "sparse-rows")
    asked = kept.where("query")
    total = asked.agg(F.sum(F.size("entries") + 1)).first()[0] or 0
    blocks = -(-total // QUERY_ENTRIES)
    schema = pa.schema([(c, pa.int64()) for c in ("q", "query_id", "vec_id", "rid", "score")])
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "id", "entries")
        sent = spark.sparkContext.broadcast(Rows(block.toArrow()))

        def search(batches, sent=sent):
            return _search(sent.value, k, batches, schema)

        part = kept.select("rid", "id", "entries").mapInArrow(search, FOUND)
        if blocks > 1:
            part = staged(spark, part, f"found-{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame(pd.DataFrame({c: pd.Series(dtype="int64") for c in schema.names}), FOUND)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
