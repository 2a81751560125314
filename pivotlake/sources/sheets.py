"""Reading sheets: CSV with typed or inferred columns, Parquet, and the preview."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pivotlake.errors import PivotError
from pivotlake.functions.dates import day_first_columns, parse_timestamp
from pivotlake.functions.formats import as_number
from pivotlake.functions.names import is_date, q
from pivotlake.operators.ordering import sort_key
from pivotlake.operators.tombstones import exclude_deleted
from pivotlake.sources.profile import profile

# Cell texts that stand for a missing value in CSV files.
NULL_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Rows of a preview, and the name of the only sheet of a CSV file.
PREVIEW_ROWS = 20
CSV_SHEET = "Sheet1"

FILE_ORDER = "__file_order"
_TRUE, _FALSE = ("true", "yes", "1"), ("false", "no", "0")


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("mode", "PERMISSIVE")
    )


def files_spanning_lines(spark: SparkSession, path: str) -> list[str]:
    """The files in which some quoted cell holds a line break: a line has an open quote.

    One scan of the lines; a file is decided on its own. The names of these files come to
    the driver, which lists all files of a scan anyway.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (quotes % 2 == 1).alias("open"))
    return sorted(r["file"] for r in lines.groupBy("file").agg(F.bool_or("open").alias("open")).where("open").collect())


def read_csv_text(
    spark: SparkSession,
    path: str,
    *,
    keep_order: bool = False,
    null_words: Sequence[str] = NULL_WORDS,
    multi_line: bool | None = None,
    file_column: str | None = None,
) -> DataFrame:
    """Every column as text, missing-value words as null.

    Files are split over tasks, except those in which cells hold line breaks: these are
    found by a scan of the lines and read one by one, the others still split.
    ``multi_line`` says so for all files beforehand.

    With ``keep_order`` the column ``__file_order`` sorts rows as they stand in the
    files: by file, by block, by place in the block. ``file_column`` names the file.
    """
    broken = files_spanning_lines(spark, path) if multi_line is None else None

    def cells(raw: DataFrame) -> DataFrame:
        shown = [F.when(~q(c).isin(*null_words), q(c)).alias(c) if null_words else q(c) for c in raw.columns]
        if keep_order:
            at = F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            )
            shown.append(at.alias(FILE_ORDER))
        if file_column:
            shown.append(F.col("_metadata.file_path").alias(file_column))
        return raw.select(*shown)

    if not broken:
        return cells(_reader(spark, bool(multi_line)).csv(path))
    # Columns are those of the folder for both; the condition on the file prunes the listing.
    whole, split = _reader(spark, True).csv(path), _reader(spark, False).csv(path)
    among = F.col("_metadata.file_path").isin(*broken)
    return cells(split.where(~among)).unionByName(cells(whole.where(among)))


def cast_text(col: Column, dtype: T.DataType, day_first: bool = False) -> Column:
    """A text cell as a value of the type; null where it is not one."""
    if isinstance(dtype, T.BooleanType):
        word = F.lower(F.trim(col))
        return F.when(word.isin(*_TRUE), F.lit(True)).when(word.isin(*_FALSE), F.lit(False))
    if is_date(dtype):
        return parse_timestamp(col, day_first).cast(dtype)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        # Casting text that is no number is slow; the pattern keeps it out.
        text = F.trim(col)
        return F.when(text.rlike(r"^[+-]?\d*\.?\d+$"), text.try_cast(dtype))
    if isinstance(dtype, T.NumericType):
        return as_number(col, T.StringType()).cast(dtype)
    return col


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV sheet with typed columns: those of ``schema``, or inferred by one scan.

    A sheet without data rows is an error.
    """
    text = read_csv_text(spark, path)
    if schema is None:
        types = inferred_types(text)
    else:
        types = declared_types(spark, schema, text.columns)
    if text.isEmpty():
        raise PivotError(f"no data rows in {path}")
    first = day_first_columns(text, [c for c, t in types.items() if is_date(t)])
    return text.select(*[cast_text(q(c), types[c], first.get(c, False)).alias(c) for c in text.columns if c in types])


@dataclass
class Landed:
    """A CSV sheet converted once: typed rows, and the cells that fit no declared type."""

    rows: DataFrame
    rejects: DataFrame


_REJECTED, _FILE = "__rejected", "__file"


def land_csv(spark: SparkSession, path: str, target: str, schema: T.StructType | str | None = None) -> Landed:
    """Convert a CSV sheet to Parquet below ``target`` and report the cells left out.

    A cell that is no value of its column's type becomes null, as in :func:`read_csv`, but
    its text is kept beside the row. ``rejects`` has one row per file and column: file,
    column, count and an example, the first of the texts in order. Columns of dates are
    read once before, for the order of day and month; rejects are counted from the written table, of which only that column is read.
    """
    text = read_csv_text(spark, path, file_column=_FILE)
    sheet = text.drop(_FILE)
    if schema is None:
        types = inferred_types(sheet)
    else:
        types = declared_types(spark, schema, sheet.columns)
    kept = [c for c in sheet.columns if c in types]
    first = day_first_columns(text, [c for c in kept if is_date(types[c])])
    casts = {c: cast_text(q(c), types[c], first.get(c, False)) for c in kept}
    typed = text.select(*[casts[c].alias(c) for c in kept], *[q(c).alias(f"__text{i}") for i, c in enumerate(kept)], _FILE)
    unfit = [
        F.when(F.col(f"__text{i}").isNotNull() & q(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"__text{i}").alias("cell")))
        for i, c in enumerate(kept)
        if not isinstance(types[c], T.StringType)
    ]
    rejected = F.array_compact(F.array(*unfit)) if unfit else F.lit(None).cast("array<struct<column:string,cell:string>>")
    out = typed.select(*[q(c) for c in kept], F.when(F.size(rejected) > 0, rejected).alias(_REJECTED), _FILE)
    out.write.parquet(f"{target}/rows")
    stored = spark.read.schema(out.schema).parquet(f"{target}/rows")
    if stored.isEmpty():
        raise PivotError(f"no data rows in {path}")
    cells = stored.where(F.col(_REJECTED).isNotNull()).select(F.col(_FILE).alias("file"), F.inline(_REJECTED))
    counted = cells.groupBy("file", "column").agg(F.count(F.lit(1)).alias("count"), F.min("cell").alias("example"))
    counted.write.parquet(f"{target}/rejects")
    return Landed(stored.select(*[q(c) for c in kept]), spark.read.schema(counted.schema).parquet(f"{target}/rejects"))


def declared_types(spark: SparkSession, schema: T.StructType | str, columns: Sequence[str]) -> dict[str, T.DataType]:
    """The declared type of each column; all declared columns must be there."""
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    missing = [c for c in types if c not in columns]
    if missing:
        raise PivotError(f"columns not in the file: {missing}")
    return types


def inferred_types(text: DataFrame) -> dict[str, T.DataType]:
    """Spark types by the column profile of a text frame: one row per column."""
    spark_types = {
        "boolean": T.BooleanType(),
        "integer": T.LongType(),
        "float": T.DoubleType(),
        "datetime": T.TimestampNTZType(),
        "string": T.StringType(),
    }
    return {r["column_name"]: spark_types[r["data_type"]] for r in profile(text).collect()}


def read_sheet(
    spark: SparkSession,
    path: str,
    *,
    dataset_id: int | None = None,
    sheet_name: str = CSV_SHEET,
    tombstones: DataFrame | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A stored sheet without its deleted rows; CSV by suffix, else Parquet."""
    df = read_csv(spark, path, schema) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
    if tombstones is None or dataset_id is None:
        return df
    return exclude_deleted(df, tombstones, dataset_id, sheet_name)


def open_sheet(
    spark: SparkSession,
    datasets: DataFrame,
    sheets: DataFrame,
    dataset_id: int,
    folder: str,
    *,
    sheet_name: str | None = None,
    tombstones: DataFrame | None = None,
) -> DataFrame:
    """A sheet by its catalog entry: the file that the dataset names below ``folder``,
    without its deleted rows. Without ``sheet_name`` the dataset's first sheet is opened."""
    entry = datasets.where(F.col("id") == dataset_id).select("stored_filename").first()
    if entry is None or not entry.stored_filename:
        raise PivotError(f"no stored file for dataset {dataset_id}")
    known = sheets.where(F.col("dataset_id") == dataset_id)
    if sheet_name is not None:
        known = known.where(F.col("sheet_name") == sheet_name)
    sheet = known.orderBy("id").select("sheet_name").first()
    if sheet is None:
        raise PivotError(f"no such sheet in dataset {dataset_id}: {sheet_name}")
    path = f"{folder.rstrip('/')}/{entry.stored_filename}"
    return read_sheet(spark, path, dataset_id=dataset_id, sheet_name=sheet.sheet_name, tombstones=tombstones)


def preview(df: DataFrame, order_by: Sequence[str] = (), rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows along ``order_by``, dates as text, non-finite numbers as null.

    Without an order the first rows of the first part are taken, and no more of the
    table is read than they need.
    """
    out = []
    for f in df.schema.fields:
        col = q(f.name)
        if is_date(f.dataType):
            col = F.date_format(col, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            col = as_number(col, f.dataType)
        out.append(col.alias(f.name))
    first = df.orderBy(*[sort_key(q(c)) for c in order_by]) if order_by else df
    return first.limit(rows).select(*out)
