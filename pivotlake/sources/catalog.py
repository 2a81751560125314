"""The catalog of datasets, sheets and columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from pivotlake.plans.checks import DATE_WORDS, NUMERIC_WORDS
from pivotlake.session import can_materialise, materialise
from pivotlake.sources.profile import profile_with_rows
from pivotlake.sources.sheets import CSV_SHEET

# The catalog's words for text.
TEXT_WORDS = ("string", "text")


def register(
    sheets: Mapping[str, Mapping[str, DataFrame]], first_id: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(datasets, sheets, columns) for ``{filename: {sheet name: frame}}``.

    Every frame is scanned once; the facts, one row per column, are kept and the
    three tables are read off them. The first sheet's counts stand for the dataset.
    """
    facts = None
    sheet_id = 0
    for dataset_id, (filename, parts) in enumerate(sheets.items(), first_id):
        for n, (name, df) in enumerate(parts.items()):
            sheet_id += 1
            one = profile_with_rows(df).select(
                F.lit(sheet_id).cast("bigint").alias("sheet_id"),
                F.lit(dataset_id).cast("bigint").alias("dataset_id"),
                F.lit(filename).alias("filename"),
                F.lit(name).alias("sheet_name"),
                F.lit(n == 0).alias("first_sheet"),
                F.lit(len(df.columns)).alias("total_columns"),
                "*",
            )
            facts = one if facts is None else facts.unionByName(one)
    if can_materialise(facts.sparkSession):
        facts = materialise(facts)
    once = facts.where(F.col("position") == 0)
    datasets = once.where("first_sheet").select(
        F.col("dataset_id").alias("id"),
        "filename",
        F.col("filename").alias("stored_filename"),
        F.col("row_count").alias("total_rows"),
        "total_columns",
    )
    sheet_rows = once.select(F.col("sheet_id").alias("id"), "dataset_id", "sheet_name", "row_count")
    columns = facts.select(
        "sheet_id", "dataset_id", "sheet_name", "position", "column_name", "data_type", "is_nullable"
    )
    return datasets, sheet_rows, columns


def register_tables(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog of single-sheet datasets."""
    return register({name: {CSV_SHEET: df} for name, df in tables.items()})


def catalog_nested(datasets: DataFrame, sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per dataset with its sheets and their columns nested, ordered by id.

    The nested lists grow with the number of columns of a sheet, never with its rows.
    """
    by_sheet = columns.groupBy("dataset_id", "sheet_name").agg(
        F.sort_array(F.collect_list(F.struct("position", "column_name", "data_type", "is_nullable"))).alias("columns")
    )
    with_columns = sheets.join(by_sheet, ["dataset_id", "sheet_name"], "left")
    by_dataset = with_columns.groupBy("dataset_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "sheet_name", "row_count", "columns"))).alias("sheets")
    )
    return datasets.join(by_dataset, datasets["id"] == by_dataset["dataset_id"], "left").drop("dataset_id")


def newest_first(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("upload_time"), F.desc("id"))


def column_kind_counts(columns: DataFrame) -> DataFrame:
    """Date, numeric and text columns per dataset; boolean ones are counted nowhere."""
    kind = F.col("data_type")
    return columns.groupBy("dataset_id").agg(
        F.count_if(kind.isin(*DATE_WORDS)).alias("date_columns"),
        F.count_if(kind.isin(*NUMERIC_WORDS)).alias("numeric_columns"),
        F.count_if(kind.isin(*TEXT_WORDS)).alias("text_columns"),
    )
