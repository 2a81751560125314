"""A stable content key per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pivotlake.functions.names import is_date, q

ROW_KEY, ROW_HASH = "source_key", "row_hash"


def canonical(col: Column, dtype: T.DataType) -> Column:
    """Null, NaN and empty text become null; dates become ISO text."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(dtype, T.StringType):
        return F.nullif(col, F.lit(""))
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if is_date(dtype):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return col


def content(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON with sorted column names."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    fields = [canonical(q(c), types[c]).alias(c) for c in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row's content; identical copies share it."""
    return F.sha2(content(df, columns), 256)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A cheap 64-bit hash of the same content. Rows with equal keys have equal
    hashes, whatever the width of their number columns; equal hashes prove nothing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in sorted(columns or df.columns):
        col = canonical(q(c), types[c])
        if isinstance(types[c], T.IntegralType):
            col = col.cast("bigint")
        elif not isinstance(types[c], (T.StringType, T.BooleanType)) and not is_date(types[c]):
            col = F.to_json(F.struct(col.alias("v")))
        parts.append(col)
    return F.xxhash64(*parts)
