"""Listings of stored files: audit of landed files, inventory, orphans."""

from __future__ import annotations

import fnmatch
import os
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.session import new_folder

# Accepted suffixes, accepted declared content types, the size limit,
# the first bytes of a workbook, and the part names a workbook must contain.
SUFFIXES = (".xlsx", ".csv")
CONTENT_TYPES = (
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/octet-stream",
    "application/zip",
    "text/csv",
    "text/plain",
    "application/csv",
    "",
)
MAX_BYTES = 50 * 1024 * 1024
ZIP_SIGNATURE = "504B0304"
WORKBOOK_PARTS = ("[Content_Types].xml", "xl/workbook.xml")
HEAD_BYTES = 8
CSV_HEAD_BYTES = 4096
PRINTABLE_SHARE = 0.85


_FOUND = "path string, folder boolean, millis bigint, length bigint"


def listing(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Files below ``path`` without their contents: path, modificationTime, length.

    Hidden files are left out; ``suffix`` is a pattern of names, such as ``*.csv``.

    Folders that every task can reach by their path are walked inside tasks, a level at a
    time: the folders of a level are dealt over tasks, which list them and give files and
    the folders of the next level, until a level has none. No name or status comes to the
    driver. In other stores Spark's own file scan lists, in tasks too, but its driver holds
    the result.
    """
    if re.match(r"(file:)?/", path):
        return _walked(spark, path, suffix)
    files = _binary_files(spark, path, suffix)
    return files.select("path", "modificationTime", "length").unionByName(_empty_files(spark, files))


def _walked(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    root = re.sub("^file:/+", "/", path)
    level = spark.createDataFrame([(root,)], "path string")
    found = []
    while True:
        # Each level is written, so that a lost executor costs one level at most.
        place = new_folder(spark, "listing")
        level.repartition("path").mapInArrow(_list_folders, _FOUND).write.parquet(place)
        found.append(place)
        level = spark.read.schema(_FOUND).parquet(place).where("folder").select("path")
        if level.isEmpty():
            break
    files = spark.read.schema(_FOUND).parquet(*found).where("NOT folder")
    if suffix != "*":
        files = files.where(file_name(F.col("path")).rlike(fnmatch.translate(suffix)))
    return files.select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_millis("millis").alias("modificationTime"), "length")


def _list_folders(batches):
    """The entries of the folders in ``batches``; one that is gone meanwhile has none."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            rows = []
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if entry.name.startswith((".", "_")):
                            continue
                        status = entry.stat()
                        rows.append((entry.path, entry.is_dir(), status.st_mtime_ns // 1_000_000, status.st_size))
            except FileNotFoundError:
                pass
            except NotADirectoryError:
                status = os.stat(folder)
                rows.append((folder, False, status.st_mtime_ns // 1_000_000, status.st_size))
            for first in range(0, len(rows), 10_000):
                paths, folders, millis, lengths = zip(*rows[first : first + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(millis, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["path", "folder", "millis", "length"],
                )


def _binary_files(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The files of zero bytes, for which Spark's scan makes no row, in a store that only
    Spark reaches: they are the scan's files that gave no row. Each is asked for its time."""
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "uri string")
    listed = listed.select("uri", F.try_url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))).alias("path"))
    rows = []
    for r in listed.join(files.select("path"), "path", "left_anti").collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r.uri))
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        rows.append((r.path, status.getModificationTime(), 0))
    made = spark.createDataFrame(rows, "path string, millis bigint, length bigint")
    return made.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _share_printable(head: Column) -> Column:
    """The share of bytes that text may have: line controls, printable ASCII, and
    everything above ASCII."""
    pairs = F.filter(F.split(F.hex(head), "(?<=\\G..)"), lambda p: p != "")
    codes = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))
    good = F.filter(codes, lambda b: b.between(9, 13) | b.between(32, 126) | (b >= 128))
    return F.size(good) / F.greatest(F.size(codes), F.lit(1))


def _has_nul(head: Column) -> Column:
    return F.hex(head).rlike("^(..)*?00")


def _verdict(content: Column, suffix: Column) -> Column:
    """The first failed check of a file's bytes, or ok."""
    head = F.substring(content, 1, HEAD_BYTES)
    csv_head = F.substring(content, 1, CSV_HEAD_BYTES)
    latin = F.decode(content, "ISO-8859-1")
    workbook = F.lit(True)
    for part in WORKBOOK_PARTS:
        workbook = workbook & (F.instr(latin, part) > 0)
    is_csv, is_xlsx = suffix == ".csv", suffix == ".xlsx"
    return (
        F.when(is_xlsx & (F.hex(F.substring(content, 1, 4)) != ZIP_SIGNATURE), "not_a_workbook")
        .when(is_csv & ((F.length(content) == 0) | _has_nul(head) | (_share_printable(head) <= PRINTABLE_SHARE)), "not_text")
        .when(is_xlsx & ~workbook, "workbook_parts_missing")
        .when(is_csv & _has_nul(csv_head), "null_bytes")
        .when(is_csv & F.hex(csv_head).rlike("^(09|0A|0B|0C|0D|20)*$"), "empty")
        .otherwise("ok")
    )


def audit_files(
    spark: SparkSession,
    path: str,
    declared: DataFrame | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per file with the first check it fails: suffix, size, declared content
    type, signature, contents.

    ``declared`` (path, content_type) may name the type given by the sender. The
    length filter reaches the source, so the bytes of refused files are never read.
    """
    empty = listing(spark, path).where("length = 0").withColumn("content", F.lit("").cast("binary"))
    files = _binary_files(spark, path).where("length > 0").unionByName(empty).withColumn("suffix", suffix_of(F.col("path")))
    accepted = F.col("suffix").isin(*SUFFIXES)
    readable = files.where((F.col("length") <= max_bytes) & accepted).select(
        "path", "length", "suffix", _verdict(F.col("content"), F.col("suffix")).alias("found")
    )
    refused = files.where(~((F.col("length") <= max_bytes) & accepted)).select(
        "path", "length", "suffix", F.when(~accepted, "suffix").otherwise("too_large").alias("found")
    )
    audited = readable.unionByName(refused)
    if declared is None:
        return audited.withColumnRenamed("found", "verdict")
    base = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    bad_type = ~base.isin(*CONTENT_TYPES) & ~F.col("found").isin("suffix", "too_large")
    return audited.join(declared, "path", "left").select(
        "path", "length", "suffix", F.when(bad_type, "content_type").otherwise(F.col("found")).alias("verdict")
    )


def stale(files: DataFrame, now: datetime | str, days: int) -> DataFrame:
    """Files not modified after ``days`` before ``now``."""
    moment = now.isoformat(" ") if isinstance(now, datetime) else now
    cutoff = F.timestamp_add("DAY", F.lit(-days), F.lit(moment).cast("timestamp"))
    return files.where(F.col("modificationTime") <= cutoff)


def inventory(files: DataFrame, category: Column) -> DataFrame:
    """File count, bytes and megabytes per category."""
    return (
        files.groupBy(category.alias("category"))
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes"))
        .withColumn("total_mb", F.round(F.col("total_bytes") / (1024 * 1024), 2))
    )


def orphans(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files that no dataset row names."""
    named = datasets.select(F.col("stored_filename").alias("name")).where(F.col("name") != "").distinct()
    return files.withColumn("name", file_name(F.col("path"))).join(named, "name", "left_anti")
