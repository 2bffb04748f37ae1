"""Column kinds, dtype names and NaN handling (schema walks, no jobs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(dt: T.DataType) -> bool:
    """pandas' ``select_dtypes(include=np.number)``: booleans excluded."""
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric (text, booleans, timestamps, nested)."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def pandas_dtype_name(dt: T.DataType) -> str:
    """Name the dtype pandas would show after ``convert_dtypes``."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, _INTEGRAL):
        return "Int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float64"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def q(name: str) -> Column:
    """Column by exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric column as double with NaN turned into null."""
    c = q(name)
    if isinstance(dt, _FLOATS):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c).cast("double")
    return c.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is *missing* in the reference; Spark treats it as a value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _FLOATS):
            cols.append(F.when(F.isnan(q(f.name)), F.lit(None).cast(f.dataType))
                        .otherwise(q(f.name)).alias(f.name))
        else:
            cols.append(q(f.name))
    return df.select(*cols)
