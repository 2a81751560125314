"""Reading the given tables, and tables in the shared folder."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pivotlake.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored_by_few(df: DataFrame, name: str, rows: int = 500) -> DataFrame:
    """:func:`stored`, with at most ``rows`` rows in a batch between the JVM and Python: rows
    that hold whole texts make batches of the default size large on both sides."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        return stored(df, name)
    finally:
        conf.set(BATCH_CONF, before)


def utf8(text: str = "text"):
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def remainder(doc_id: str, by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def rows_of(batch, step: int = 256):
    """The rows of an Arrow batch as tuples, a few at a time: texts are long, batches are not."""
    for first in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(first, step).columns), strict=True)


def give_back() -> None:
    """Hand memory that Arrow keeps for later back to the system: workers outlive a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
