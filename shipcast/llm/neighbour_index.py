"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a neighbour graph, a balanced partitioning of it, and a
small network that learns in which partitions a vector's neighbours lie.  The
network places every vector in one partition and sends a query to its most
probable ones, as many as reach the wanted recall on the sample; there all
candidates are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shipcast.llm.common import bounded_sample, ship_package, staged

#: rows of one partition, and queries, that one task compares
BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Router:
    """One hidden layer, then a softmax over partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k rows of largest inner product, blockwise."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        part = x[at : at + 512] @ x.T
        part[np.arange(len(part)), at + np.arange(len(part))] = -np.inf
        out[at : at + 512] = np.argpartition(-part, k - 1, axis=1)[:, :k]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1) -> np.ndarray:
    """Partition of the graph's nodes, no part above ``slack`` times the mean.

    Starts from halving along principal directions, then moves nodes to the
    part that holds most of their neighbours while it has room.
    """
    label, order = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while order:
        rows, first, count = order.pop()
        if count == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        along = np.argsort(centred @ vectors[:, -1], kind="stable")
        half = count // 2
        cut = len(rows) * half // count
        order += [(rows[along[:cut]], first, half), (rows[along[cut:]], first + half, count - half)]
    most = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    both = [[] for _ in range(len(x))]
    for a, row in enumerate(graph.tolist()):
        both[a] += row
        for b in row:
            both[b].append(a)
    rng = np.random.default_rng(3)
    for _ in range(12):
        moved = 0
        for a in rng.permutation(len(x)):
            near = np.bincount(label[both[a]], minlength=parts).astype(float)
            near[(size >= most) & (np.arange(parts) != label[a])] = -1
            best = int(near.argmax())
            if near[best] > near[label[a]]:
                size[label[a]] -= 1
                size[best] += 1
                label[a] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def train_router(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 128, epochs: int = 60) -> Router:
    """Soft targets: the share of a node's neighbours (and itself) in each part."""
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], label[graph]), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1] / 2
    target /= target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(9)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            b = order[at : at + 128]
            pre = x[b] @ p[0] + p[1]
            h = np.maximum(pre, 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[b]) / len(b)
            back = (d @ p[2].T) * (pre > 0)
            step += 1
            for i, g in enumerate((x[b].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, probes=parts, recall=1.0)


def fit_router(x: np.ndarray, parts: int, k: int, recall: float) -> Router:
    """Train on most of the sample; on the rest choose the fewest probes whose
    partitions hold ``recall`` of the true neighbours."""
    parts = max(1, min(parts, len(x) // 32))
    scaled = unit(x)
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    held = np.arange(len(x)) % 5 == 0
    graph = neighbour_graph(scaled[~held], min(12, int((~held).sum()) - 1))
    router = train_router(scaled[~held], balanced_partitions(scaled[~held], graph, parts), graph, parts)
    logits = router.logits(scaled)
    home = logits.argmax(axis=1)
    scores = x[held] @ x.T
    scores[np.arange(len(scores)), np.flatnonzero(held)] = -np.inf
    # of a sample, fewer neighbours stand for the k of the whole table
    true = np.argsort(-scores, axis=1)[:, : max(3, k // 4)]
    rank = np.argsort(np.argsort(-logits[held], axis=1), axis=1)
    need = np.take_along_axis(rank, home[true], axis=1)
    for probes in range(1, parts + 1):
        router.probes, router.recall = probes, float((need < probes).mean())
        if router.recall >= recall:
            break
    return router


def _as_matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)


def _best(q_id: np.ndarray, q: np.ndarray, asked: np.ndarray, c_id: np.ndarray, c: np.ndarray, part: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of every query among the block's candidates that lie in a
    partition it asks; ``asked`` is boolean (query, partition)."""
    # equal vectors of a partition: the k + 1 smallest ids are all that can be wanted
    order = np.lexsort((c_id, *c.T, part))
    c_id, c, part = c_id[order], c[order], part[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]).any(axis=1) | (part[1:] != part[:-1])])
    place = np.arange(len(c)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    c_id, c, part = c_id[place <= k], c[place <= k], part[place <= k]
    out = []
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        scores = some @ c.T
        scores[(q_id[at : at + 256, None] == c_id[None, :]) | ~asked[at : at + 256][:, part]] = -np.inf
        take = min(k, scores.shape[1])
        least = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero((scores >= least[:, None] - 1e-9 * np.maximum(1, np.abs(least[:, None]))) & (scores > -np.inf))
        exact = np.einsum("ij,ij->i", some[row], c[col])  # one order of summation for every pair
        order = np.lexsort((c_id[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        start = np.searchsorted(row, row)
        keep = np.arange(len(row)) - start < k
        out.append(pd.DataFrame({"query_id": q_id[at + row[keep]], "vec_id": c_id[col[keep]], "score": exact[keep]}))
    return pd.concat(out)


def _bundles(count: dict[int, int]) -> dict[int, int]:
    """Partition -> bundle: neighbours in number share a bundle while their rows
    fit one block, so that a query's lists are merged there."""
    out, bundle, rows = {}, 0, 0
    for part, n in sorted(count.items()):
        if rows and rows + n > BLOCK:
            bundle, rows = bundle + 1, 0
        out[part], rows = bundle, rows + n
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v``: rows that take part, one per vec_id (of several vectors
    the smallest), with finite components that are not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(finite & F.exists("v", lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def nearest(
    spark: SparkSession,
    embeddings: DataFrame,
    k: int = 20,
    every: int = 20,
    max_sample: int = 8192,
    rows_per_part: int = 1000,
    max_parts: int = 256,
    recall: float = 0.95,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries with vec_id divisible by
    ``every``, against all other rows; nearness is the inner product.

    The index is fitted on at most ``max_sample`` vectors and holds every
    usable row; a query whose partitions hold too few rows asks further ones.  Vectors whose length is not the most frequent one take no
    part.  Ties go to the smaller vec_id.  With fewer than k other rows all
    are returned; an empty table gives no rows.
    """
    ship_package(spark)
    shape = "query_id long, vec_id long, score double"
    table = staged(spark, usable(embeddings), "vectors")
    sizes = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["d"], sizes[0]["count"]
    table = table.where(F.size("v") == dim)
    parts = int(min(max_parts, max(1, n // rows_per_part)))
    ids = bounded_sample(table, "vec_id", min(max_sample, max(1024, 64 * parts)))
    rows = table.join(F.broadcast(ids), "vec_id", "left_semi").orderBy("vec_id").collect()  # at most max_sample
    router = fit_router(np.array([r.v for r in rows], np.float64), parts, k, recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            home = router.logits(unit(x)).argmax(axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [r.tobytes() for r in x], "part": home.astype(np.int32)})

    held = staged(spark, table.mapInPandas(place, "vec_id long, v binary, part int"), "placed")
    count = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}  # at most max_parts rows
    bundle_of = _bundles(count)
    sizes: dict[int, int] = {}
    for p, c in count.items():
        sizes[bundle_of[p]] = sizes.get(bundle_of[p], 0) + c
    of = F.create_map(*[F.lit(x) for pair in sorted(bundle_of.items()) for x in pair])
    # a bundle above one block (a hot partition) is split by id
    blocks = F.create_map(*[F.lit(x) for p, c in sorted(sizes.items()) for x in (p, -(-c // BLOCK))])
    rows_of = np.zeros(max(1, len(router.b2)), np.int64)
    for p, c in count.items():
        rows_of[p] = c

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The most probable partitions, and more until they hold k + 1 rows."""
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-router.logits(unit(_as_matrix(pdf["v"], dim))), axis=1, kind="stable")
            enough = 1 + (np.cumsum(rows_of[order], axis=1) <= k).sum(axis=1)
            parts = [row[: max(router.probes, n)].tolist() for row, n in zip(order.astype(np.int32), enough)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "parts": parts})

    asked = held.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInPandas(ask, "vec_id long, v binary, parts array<int>")
    reached = F.array_distinct(F.filter(F.transform("parts", lambda p: F.element_at(of, p)), lambda x: x.isNotNull()))
    queries = staged(spark, asked.withColumn("bundle", F.explode(reached)), "asked")
    # a bundle's rows meet the queries that reach it, QUERY_BLOCK at a time: their copies follow those queries alone
    asking = {r["bundle"]: -(-r["count"] // QUERY_BLOCK) for r in queries.groupBy("bundle").count().collect()}  # at most max_parts rows
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups = F.create_map(*[F.lit(x) for pair in sorted(asking.items()) for x in pair])
    left = (
        held.withColumn("bundle", F.element_at(of, F.col("part")))
        .where(F.col("bundle").isin(sorted(asking)))
        .withColumn("b", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("bundle"))).cast("int"))
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.element_at(groups, F.col("bundle")) - 1)))
    )
    right = (
        queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.element_at(groups, F.col("bundle"))).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("bundle")) - 1)))
    )
    width = max(count) + 1

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        asked = np.zeros((len(q), max(width, router.probes, int(max(map(max, q["parts"]))) + 1)), bool)
        for i, parts in enumerate(q["parts"]):
            asked[i, list(parts)] = True
        return _best(
            q["vec_id"].to_numpy(), _as_matrix(q["v"], dim), asked, c["vec_id"].to_numpy(), _as_matrix(c["v"], dim), c["part"].to_numpy(), k
        )

    key = ("bundle", "b", "g")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, shape)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
