"""Materialise a shared intermediate once per session.

The canonical line table and the order frame feed almost every query.  They are
written once as Parquet into the cluster's shared checkpoint folder (read from
the session; see ``shipcast.session``) and re-read by later queries, which cuts
lineage so a lost executor never replays the five-way join, and keeps
downstream scans columnar with pruning and pushdown.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession

from shipcast.session import checkpoint_dir

_LOCK = threading.Lock()
_LOCKS: dict[str, threading.RLock] = {}
_WRITTEN: dict[tuple[str, str], str] = {}


def _key(spark: SparkSession, name: str, source: str) -> str:
    app = spark.sparkContext.applicationId
    digest = hashlib.sha1(f"{app}|{source}|{name}".encode()).hexdigest()[:16]
    return f"shipcast-{name}-{digest}"


def materialized(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """Return ``build()`` written once to the shared folder and read back.

    Each table has a lock of its own: a build may need other tables, also from
    threads that it starts."""
    base = checkpoint_dir(spark)
    path = os.path.join(base, _key(spark, name, source))
    with _LOCK:
        own = _LOCKS.setdefault(path, threading.RLock())
    with own:
        if (name, source) not in _WRITTEN or _WRITTEN[(name, source)] != path:
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            _WRITTEN[(name, source)] = path
    return spark.read.parquet(path)
