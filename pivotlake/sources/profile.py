"""Column profiles and sheet metadata, each from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pivotlake.functions.dates import parse_timestamp
from pivotlake.functions.formats import NUMBER
from pivotlake.functions.names import catalog_type, is_text, quoted

# The words of a text column that is really boolean.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")


# Bits of what a text cell is not.
_NOT_DATE, _NOT_BOOLEAN, _NOT_INTEGER, _NOT_NUMBER = 1, 2, 4, 8
_ALL = _NOT_DATE | _NOT_BOOLEAN | _NOT_INTEGER | _NOT_NUMBER

# The kinds a text cell ``v`` does not fit, as bits; ``is_date`` tells whether it reads as
# a date. The first character settles most cells before any pattern is tried. It is SQL
# text because building the tree call by call takes longer than running it.
_TEXT_MISSES = f"""
CASE WHEN v IS NULL THEN NULL
     WHEN trim(v) IN ('0', '1') THEN {_NOT_DATE}
     WHEN substring(trim(v), 1, 1) BETWEEN '+' AND '9' THEN
       CASE WHEN trim(v) RLIKE r'^[+-]?\\d+$' AND try_cast(trim(v) AS BIGINT) IS NOT NULL
              THEN CASE WHEN is_date THEN {_NOT_BOOLEAN} ELSE {_NOT_DATE | _NOT_BOOLEAN} END
            WHEN trim(v) RLIKE r'{NUMBER}' THEN {_NOT_DATE | _NOT_BOOLEAN | _NOT_INTEGER}
            WHEN is_date THEN {_NOT_BOOLEAN | _NOT_INTEGER | _NOT_NUMBER}
            ELSE {_ALL} END
     WHEN lower(trim(v)) IN ({", ".join(f"'{w}'" for w in BOOLEAN_WORDS)})
       THEN {_NOT_DATE | _NOT_INTEGER | _NOT_NUMBER}
     WHEN is_date THEN {_NOT_BOOLEAN | _NOT_INTEGER | _NOT_NUMBER}
     ELSE {_ALL} END
"""
# What a text has to look like to be tried as a date at all.
_DATE_SHAPE = r"^\s*(\d{4}[-/.]\d{1,2}([-/.]\d|\s*$)|\d{1,2}([-/.])\d{1,2}\3\d|\d{8}\s*$|\d{1,2}[- ][A-Za-z]{3}|[A-Za-z]{3,9}\.?,?[- ]+(\d|[A-Za-z]{3}))"


def _cell(i: int, name: str, dtype: T.DataType) -> str:
    """(column number, text value, is null, bits already known) of one cell."""
    c = quoted(name)
    text, null, bits = "string(NULL)", f"{c} IS NULL", "int(NULL)"
    if is_text(dtype):
        text = c
    elif isinstance(dtype, T.FractionalType):
        if not isinstance(dtype, T.DecimalType):
            null = f"({c} IS NULL OR isnan({c}))"
        bits = f"CASE WHEN NOT {null} AND {c} NOT IN (0, 1) THEN {_NOT_BOOLEAN} WHEN NOT {null} THEN 0 END"
    return f"{i}, {text}, {null}, {bits}"


def profile_with_rows(df: DataFrame) -> DataFrame:
    """The column profile with the row count of the sheet next to every column.

    The cells of a row are stacked, judged by one expression and folded per column
    number before the exchange, so a sheet of any size is one scan and each task
    sends one row per column. One small expression for all columns also stays within
    what the JVM compiles, where one expression per column would not.

    Text is tried as date, boolean, integer and float in that order; a float column
    of zeros and ones only is boolean; a column without values is text.
    """
    fields = [(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    cells = ", ".join(_cell(*f) for f in fields)
    evidence = (
        df.selectExpr(f"stack({len(fields)}, {cells}) AS (position, v, is_null, bits)")
        .withColumn("is_date", F.when(F.col("v").rlike(_DATE_SHAPE), parse_timestamp(F.col("v")).isNotNull()).otherwise(False))
        # Judged in a projection: inside the aggregate the tree is generated three times.
        .selectExpr("position", "is_null", f"coalesce(bits, {_TEXT_MISSES}) AS misses")
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.bool_or("is_null").alias("nulls"),
            F.bool_or(~F.col("is_null")).alias("some"),
            F.bit_or("misses").alias("misses"),
        )
    )
    known = [
        (i, name, "text" if is_text(t) else "float" if isinstance(t, T.FractionalType) else catalog_type(t))
        for i, name, t in fields
    ]
    names = df.sparkSession.createDataFrame(known, "position int, column_name string, declared string")
    data_type = f"""
        CASE WHEN NOT coalesce(some, false) THEN 'string'
             WHEN declared = 'float' THEN if(misses & {_NOT_BOOLEAN} = 0, 'boolean', 'float')
             WHEN declared <> 'text' THEN declared
             WHEN misses & {_NOT_DATE} = 0 THEN 'datetime'
             WHEN misses & {_NOT_BOOLEAN} = 0 THEN 'boolean'
             WHEN misses & {_NOT_INTEGER} = 0 THEN 'integer'
             WHEN misses & {_NOT_NUMBER} = 0 THEN 'float'
             ELSE 'string' END"""
    return names.join(evidence, "position", "left").selectExpr(
        "position",
        "column_name",
        f"{data_type} AS data_type",
        "coalesce(nulls, false) AS is_nullable",
        "coalesce(row_count, 0L) AS row_count",
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, inferred type, and whether nulls occur."""
    return profile_with_rows(df).drop("row_count")


def sheet_metadata(df: DataFrame) -> DataFrame:
    """One row: row count, column count, column names."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
    )
