"""Reference-format inputs: the ISO-8859-1 order-line CSV and the data
dictionary, read with explicit schemas (never inferred at scale)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shipcast.functions.columns import column_key

ENCODING = "ISO-8859-1"
# First bytes of a Git LFS pointer file.
LFS_POINTER_PREFIX = "version https://git-lfs.github.com/spec/v1"


class DatasetError(RuntimeError):
    """The dataset cannot be loaded; the message says why."""


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(1).collect()
        return True
    except AnalysisException:
        return False


def find_file(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """First existing path in search order (uploads, data, root)."""
    for p in candidates:
        if _exists(spark, p):
            return p
    return None


def check_not_lfs_pointer(spark: SparkSession, path: str) -> None:
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].startswith(LFS_POINTER_PREFIX):
        raise DatasetError(f"'{path}' is a Git LFS pointer file, not the data; fetch it with git lfs pull.")


def load_raw_dataset(spark: SparkSession, path: str | Sequence[str], schema) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    found = find_file(spark, paths)
    if found is None:
        raise DatasetError("Dataset not found in: " + ", ".join(paths))
    check_not_lfs_pointer(spark, found)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("mode", "PERMISSIVE")
        .csv(found)
    )


def load_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """``field, description``: headers upper-cased, text trimmed, leading
    colons stripped; None when the file is missing or unusable."""
    if not _exists(spark, path):
        return None
    try:
        check_not_lfs_pointer(spark, path)
        raw = spark.read.option("header", True).option("encoding", ENCODING).csv(path)
    except (AnalysisException, DatasetError):
        return None
    cols = {c.strip().upper(): c for c in raw.columns}
    if "FIELDS" not in cols:
        return None
    desc = F.col(f"`{cols['DESCRIPTION']}`") if "DESCRIPTION" in cols else F.lit("")
    return raw.select(
        F.trim(F.col(f"`{cols['FIELDS']}`")).alias("field"),
        F.trim(F.regexp_replace(F.trim(desc), r"^:+", "")).alias("description"),
    )


def _norm_col(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def reconcile_dictionary(spark: SparkSession, columns: Sequence[str], dictionary: DataFrame | None) -> DataFrame:
    """(kind, csv_name, dictionary_name): undocumented, missing_from_csv and
    spelling_mismatch rows, by a full outer join on the normalised name."""
    schema = "kind string, csv_name string, dictionary_name string"
    if dictionary is None:
        return spark.createDataFrame([], schema)
    csv = spark.createDataFrame([(c, column_key(c)) for c in columns], "csv_name string, key string")
    d = dictionary.select(F.col("field").alias("dictionary_name"), _norm_col(F.col("field")).alias("key")).dropDuplicates(["key"])
    j = csv.join(d, "key", "full_outer")
    kind = (
        F.when(F.col("dictionary_name").isNull(), "undocumented")
        .when(F.col("csv_name").isNull(), "missing_from_csv")
        .when(F.col("csv_name") != F.col("dictionary_name"), "spelling_mismatch")
    )
    return j.select(kind.alias("kind"), "csv_name", "dictionary_name").where(F.col("kind").isNotNull())
