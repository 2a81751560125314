"""Column lookup that survives dots, pipes, blanks and back-ticks in names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    return F.col(quoted(name))


def all_of(conditions: Iterable[Column]) -> Column:
    """AND of the conditions; true when there are none."""
    result = None
    for condition in conditions:
        result = condition if result is None else result & condition
    return F.lit(True) if result is None else result


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false when there are none."""
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def missing(col: Column, dtype: T.DataType) -> Column:
    """Whether a value is missing: null, or not a number."""
    return col.isNull() | F.isnan(col) if is_float(dtype) else col.isNull()


def present(col: Column, dtype: T.DataType) -> Column:
    """The value, null where it is missing."""
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def catalog_type(dtype: T.DataType) -> str:
    """The catalog's word for a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if is_numeric(dtype):
        return "float"
    if is_date(dtype):
        return "datetime"
    return "string"
