"""Result and model sinks: one Parquet (or JSON) dataset per result table,
non-finite doubles written as null; Spark ML pipelines saved natively."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def finite_column(c: Column, kind: T.DataType) -> Column:
    """``c`` with NaN and infinities as null, however deep they lie in arrays,
    map values and structs.  Map keys stay, a null container stays null."""
    if not _holds_floats(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_column(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite_column(x, kind.valueType))
    if isinstance(kind, T.StructType):
        whole = F.struct(*[finite_column(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), whole)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null, nested ones too (JSON has no other way)."""
    return df.select(*[finite_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def sink_results(results: dict[str, DataFrame], base_path: str, fmt: str = "parquet") -> dict[str, str]:
    """Writes every result as ``fmt`` (``parquet`` or ``json``); its paths."""
    out = {}
    for name, df in results.items():
        path = f"{base_path.rstrip('/')}/{name}"
        finite(df).write.mode("overwrite").format(fmt).save(path)
        out[name] = path
    return out


def sink_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path
