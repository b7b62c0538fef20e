"""Rounding that is identical across engines.

``F.round`` rounds HALF_UP on the decimal text of a double; SQL engines such
as DuckDB round half away from zero on the binary value ``x * 10^d``.  The
same double then rounds differently at exact decimal ties.  ``dround`` takes
the binary route, so equal inputs give equal outputs in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dround(c, d: int = 0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    p = float(10**d)
    return (F.signum(c) * F.floor(F.abs(c) * p + 0.5) / p).cast("double")
