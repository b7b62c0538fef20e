"""Values of a small keyed table, without shuffling rows by a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows up to which a lookup table is broadcast
LOOKUP_ROWS = 20_000
#: parts into which each key is split beyond that
SALT = 32


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], bound: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` left-joined with ``table`` (one row per key).

    The table is evaluated once, up to ``bound`` + 1 rows.  Within the bound
    it is broadcast; beyond, both sides are salted, so that a key holding a
    third of all rows is spread over ``SALT`` partitions.
    """
    rows = table.limit(bound + 1).collect()
    if len(rows) <= bound:
        small = df.sparkSession.createDataFrame(rows, table.schema)
        return df.join(F.broadcast(small), list(keys), "left")
    # by content: a task that is run again must deal its rows as before
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies, [*keys, "__salt"], "left").drop("__salt")
