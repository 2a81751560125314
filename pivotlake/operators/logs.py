"""Search and retention over the application log.

A stored log has one folder per day. Expiry removes whole days and rewrites at most the
one day in which the limit lies; no other day is read.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.operators.tombstones import has_text
from pivotlake.sources.stores import exists, folders, move, remove

# Rows of one search, and rows the log keeps.
SEARCH_ROWS = 500
KEPT_ROWS = 5000


def search_logs(
    logs: DataFrame,
    query: str | None = None,
    level: str | None = None,
    category: str | None = None,
    date_from: str | datetime | None = None,
    date_to: str | datetime | None = None,
    limit: int = SEARCH_ROWS,
) -> DataFrame:
    """Log rows newest first; both dates are inclusive, unreadable dates are ignored."""
    found = logs
    if query:
        found = found.where(has_text("message", query) | has_text("details", query))
    if level:
        found = found.where(F.col("level") == level.lower())
    if category:
        found = found.where(F.col("category") == category)
    low, high = _moment(date_from), _moment(date_to)
    if low is not None:
        found = found.where(F.col("timestamp") >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        found = found.where(F.col("timestamp") <= F.lit(high).cast("timestamp_ntz"))
    return found.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def _moment(value: str | datetime | None) -> str | None:
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value.isoformat(" ")
    try:
        return datetime.fromisoformat(value.replace("Z", "")).isoformat(" ")
    except ValueError:
        return None


def keep_latest(logs: DataFrame, limit: int = KEPT_ROWS) -> DataFrame:
    """The newest ``limit`` rows by time, then id."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def retained(df: DataFrame, column: str, now: datetime | str, days: int) -> DataFrame:
    """Rows strictly newer than ``days`` before ``now``."""
    moment = now.isoformat(" ") if isinstance(now, datetime) else now
    cutoff = F.timestamp_add("DAY", F.lit(-days), F.lit(moment).cast("timestamp_ntz"))
    return df.where(F.col(column) > cutoff)


# Stored logs ---------------------------------------------------------------------------------

_DAY, _UNDATED = "day", "__HIVE_DEFAULT_PARTITION__"
# Out of sight of a reader of the table.
_STAGE = "_purge"


def write_logs(logs: DataFrame, path: str, column: str = "timestamp") -> None:
    """Append to a stored log, one folder per day of ``column``; rows without a time lie in
    a folder of their own."""
    logs.withColumn(_DAY, F.col(column).cast("date")).write.mode("append").partitionBy(_DAY).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A stored log; a purge that was broken off is brought to its end first."""
    _recover(spark, path)
    return spark.read.parquet(path).drop(_DAY)


def purge_logs(spark: SparkSession, path: str, now: datetime | str, days: int, column: str = "timestamp") -> dict[str, int]:
    """Remove what is not strictly newer than ``days`` before ``now``: the rows that
    :func:`retained` leaves stay. Gives the number of folders removed and rewritten."""
    moment = now if isinstance(now, datetime) else datetime.fromisoformat(now)
    cutoff = moment - timedelta(days=days)
    return _expire(spark, path, cutoff.date().isoformat(), F.col(column) > F.lit(cutoff.isoformat(" ")).cast("timestamp_ntz"))


def trim_logs(spark: SparkSession, path: str, limit: int = KEPT_ROWS, column: str = "timestamp") -> dict[str, int]:
    """Remove all but the newest ``limit`` rows by time, then id: those of :func:`keep_latest`.

    Days are counted, which reads no column. Of the day in which the limit lies the last
    row to keep is looked up; rows equal to it in time and id stay as well.
    """
    _recover(spark, path)
    if not exists(spark, path):
        return {"removed": 0, "rewritten": 0}
    stored = spark.read.parquet(path)
    # One row per day.
    counted = sorted(((r[_DAY], r["count"]) for r in stored.groupBy(_DAY).count().collect()), key=lambda r: (r[0] is not None, r[0]), reverse=True)
    left = limit
    for day, n in counted:
        if n > left:
            break
        left -= n
    else:
        return {"removed": 0, "rewritten": 0}
    inside = stored.where(F.col(_DAY).eqNullSafe(F.lit(day)))
    last = inside.orderBy(F.desc(column), F.desc("id")).limit(left).agg(F.min(F.struct(column, "id")).alias("at")).first()["at"] if left else None
    kept = F.lit(False)
    if last is not None:
        same_or_later = F.coalesce(F.col("id") >= F.lit(last["id"]), F.lit(last["id"] is None))
        if last[column] is not None:
            moment = F.lit(last[column].isoformat(" ")).cast(stored.schema[column].dataType)
            kept = (F.col(column) > moment) | ((F.col(column) == moment) & same_or_later)
        else:
            kept = same_or_later
    return _expire(spark, path, day.isoformat() if day else None, kept)


def _expire(spark: SparkSession, path: str, boundary: str | None, kept: Column) -> dict[str, int]:
    """Remove the days before ``boundary`` and rewrite that day with its ``kept`` rows."""
    _recover(spark, path)
    removed = rewritten = 0
    for name in folders(spark, path):
        if not name.startswith(f"{_DAY}="):
            continue
        day = None if name.endswith(_UNDATED) else name.split("=", 1)[1]
        if day == boundary:
            rewritten += _rewrite(spark, path, name, kept)
        elif boundary is not None and (day is None or day < boundary):
            remove(spark, f"{path}/{name}")
            removed += 1
    return {"removed": removed, "rewritten": rewritten}


def boundary_day(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one day of a stored log: the only folder that is listed and read."""
    return spark.read.option("basePath", path).parquet(f"{path}/{name}").drop(_DAY)


def _rewrite(spark: SparkSession, path: str, name: str, kept: Column) -> int:
    """Replace a day by its kept rows: written beside the table, then put in its place."""
    stage = f"{path}/{_STAGE}/{name}"
    boundary_day(spark, path, name).where(kept).write.mode("overwrite").parquet(stage)
    remove(spark, f"{path}/{name}")
    move(spark, stage, f"{path}/{name}")
    return 1


def _recover(spark: SparkSession, path: str) -> None:
    """A staged day whose folder is gone takes its place; one that was not finished goes."""
    for name in folders(spark, f"{path}/{_STAGE}"):
        stage = f"{path}/{_STAGE}/{name}"
        if exists(spark, f"{stage}/_SUCCESS") and not exists(spark, f"{path}/{name}"):
            move(spark, stage, f"{path}/{name}")
        else:
            remove(spark, stage)
