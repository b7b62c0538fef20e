"""Co-moments of all pairs of columns in one pass.

Every task centres its rows and adds up, per pair, the rows where both are
known, their means and their sums of squares and products around those means.
Such partial results merge exactly: sums around the common mean are the sums
around the own mean plus what the means differ.  Nothing is ever a difference
of two large sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTIAL = "a int, b int, n long, mean_a double, mean_b double, ss_a double, ss_b double, sp double"


class CoMoments:
    """Entry (a, b): rows with both, mean of a over them, sums around the means."""

    def __init__(self, p: int) -> None:
        self.n, self.mean, self.ss, self.sp = (np.zeros((p, p)) for _ in range(4))

    def add(self, x: np.ndarray, known: np.ndarray) -> None:
        """Rows of values, those not ``known`` being ignored."""
        v = known.astype(float)
        first = np.where(known.any(0), np.take_along_axis(x, known.argmax(0)[None], 0)[0], 0.0)
        first = np.where(np.isfinite(first), first, 0.0)
        d = np.where(known, x - first, 0.0)  # a constant column is exactly zero
        with np.errstate(invalid="ignore", divide="ignore"):
            shift = d.sum(0) / np.maximum(v.sum(0), 1)
            shift = np.where(np.isfinite(shift), shift, 0.0)
            d = np.where(known, d - shift, 0.0)
            n = v.T @ v
            s = d.T @ v
            m = np.where(n > 0, s / n, 0.0)
            self.merge(n, m + (first + shift)[:, None] * (n > 0), (d * d).T @ v - s * m, d.T @ d - s * m.T)

    def merge(self, n: np.ndarray, mean: np.ndarray, ss: np.ndarray, sp: np.ndarray) -> None:
        total = self.n + n
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(total > 0, self.n * n / total, 0.0)
            apart = np.where((self.n > 0) & (n > 0), mean - self.mean, 0.0)
            self.ss += ss + apart * apart * share
            self.sp += sp + apart * apart.T * share
            self.mean = np.where(total > 0, (self.n * self.mean + n * mean) / np.maximum(total, 1), 0.0)
        self.n = total


def partial_co_moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """At most one row per task and pair of ``columns`` (a <= b)."""
    p = len(columns)
    up, over = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = CoMoments(p)
        for batch in batches:
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            if len(x):
                held.add(x, known)
        some = held.n[up, over] > 0
        a, b = up[some], over[some]
        values = [held.n[a, b].astype(np.int64), held.mean[a, b], held.mean[b, a], held.ss[a, b], held.ss[b, a], held.sp[a, b]]
        names = ("a", "b", "n", "mean_a", "mean_b", "ss_a", "ss_b", "sp")
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, values)], names)

    return rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, PARTIAL)


def co_moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``var_a, var_b, n, ss_a, ss_b, sp`` per pair with rows in common; nulls
    are left out pair by pair."""
    parts = partial_co_moments(rows, columns)
    pair = Window.partitionBy("a", "b")
    mean = {c: F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair) for c in ("mean_a", "mean_b")}
    off = parts.select("*", *[(F.col(c) - m).alias(f"off_{c[-1]}") for c, m in mean.items()])
    names = F.array(*[F.lit(c) for c in columns])
    merged = off.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("ss_a") + F.col("n") * F.col("off_a") * F.col("off_a")).alias("ss_a"),
        F.sum(F.col("ss_b") + F.col("n") * F.col("off_b") * F.col("off_b")).alias("ss_b"),
        F.sum(F.col("sp") + F.col("n") * F.col("off_a") * F.col("off_b")).alias("sp"),
    )
    return merged.select(
        F.element_at(names, F.col("a") + 1).alias("var_a"), F.element_at(names, F.col("b") + 1).alias("var_b"), "n", "ss_a", "ss_b", "sp"
    )
