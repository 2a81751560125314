"""Directory exports: CSV files of users and of distribution lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.functions.text import strip
from pivotlake.operators.directory import LIST, USER
from pivotlake.sources.sheets import FILE_ORDER, read_csv_text

# The columns of a directory export.
NAME, ADDRESS, ALIAS = "DisplayName", "PrimarySmtpAddress", "Alias"


def normalised(raw: DataFrame, kind: str, order: Column) -> DataFrame:
    """Entries of one export: trimmed, address and alias in lower case, the address
    as the name where there is none, rows without an address dropped, and of equal
    addresses the first along ``order`` kept.

    First-wins is a minimum per address, which is combined before the shuffle; a
    hot address is no hot task.
    """
    email = F.lower(strip(F.col(ADDRESS)))
    name = F.nullif(F.coalesce(strip(F.col(NAME)), F.lit("")), F.lit(""))
    entries = raw.select(
        email.alias("email"),
        F.coalesce(name, email).alias("name"),
        F.lower(F.coalesce(strip(F.col(ALIAS)), F.lit(""))).alias("alias"),
        order.alias("at"),
    ).where(F.instr("email", "@") > 0)
    first = entries.groupBy("email").agg(F.min(F.struct("at", "name", "alias")).alias("first"))
    return first.select("email", "first.name", "first.alias", F.lit(kind).alias("kind"))


def load_directory(spark: SparkSession, users_path: str | None, lists_path: str | None) -> DataFrame:
    """Users and lists in one table; the same address may be both."""
    schema = "email string, name string, alias string, kind string"
    out = spark.createDataFrame([], schema)
    for path, kind in ((users_path, USER), (lists_path, LIST)):
        if path:
            raw = read_csv_text(spark, path, keep_order=True, null_words=())
            out = out.unionByName(normalised(raw, kind, F.col(FILE_ORDER)))
    return out
