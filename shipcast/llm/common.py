"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.session import checkpoint_dir, ship_code


#: bytes up to which rows go to a Python worker at once (a longer row goes alone)
BATCH_BYTES = 4 << 20
#: a key is hot above LEAST_HOT rows and a HOT_KEYS-th of all
LEAST_HOT, HOT_KEYS = 2_000, 100_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    executors need no installation of it, and bound what goes to a worker at
    once by bytes, unless the session has set its own bound."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))
    ship_code(spark)


def give_back() -> None:
    """Return what a task has freed to the system: idle workers stay alive, and
    both Arrow and the C library keep freed memory for themselves."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(run: Callable) -> Callable:
    """A function of batches that gives memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage durably: a lost executor re-reads files and replays nothing.
    """
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which holds each non-null ``key`` once
    and in ``count`` its rows among the ``total`` of ``rows``.

    Hot keys, at most HOT_KEYS of them, are looked up where their rows lie;
    only the others are shuffled.  Both frames are read twice: store them.
    """
    many = max(LEAST_HOT, total // HOT_KEYS)
    hot, cold = table.where(F.col(count) > many), table.where(F.col(count) <= many)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, id_col: str, limit: int, seed: int = 7) -> DataFrame:
    """At most ``limit`` ids, those with the smallest seeded hash: deterministic,
    and only ids (never texts) pass the top-k."""
    return (
        df.select(id_col)
        .where(F.col(id_col).isNotNull())
        .orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col))
        .limit(limit)
    )


def text_key(text: Column) -> Column:
    """Hash of a whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
