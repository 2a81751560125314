"""Mail history and recent recipients."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.functions.text import distinct_ignoring_case, invalid_addresses, json_list, split_addresses
from pivotlake.functions.zones import iso_text
from pivotlake.operators.tombstones import read_or_empty
from pivotlake.session import materialise
from pivotlake.sources.stores import folders, remove

# Rows of the history list and of the recipient list.
HISTORY_ROWS = 100
RECIPIENT_ROWS = 50


def mail_history(
    history: DataFrame, files: DataFrame | None = None, limit: int = HISTORY_ROWS, zone: str | None = None
) -> DataFrame:
    """The newest mails with their addresses as arrays and whether the attachment
    still exists in the listing ``files`` (column ``path``)."""
    return _listed(history.orderBy(F.desc("sent_at"), F.desc("id")).limit(limit), files, zone)


def _listed(mails: DataFrame, files: DataFrame | None = None, zone: str | None = None) -> DataFrame:
    if files is None:
        mails = mails.withColumn("has_attachment", F.lit(False))
    else:
        present = files.select(F.col("path").alias("attachment_path"), F.lit(True).alias("present")).distinct()
        mails = mails.join(present, "attachment_path", "left").withColumn(
            "has_attachment", F.col("present").isNotNull() & (F.col("attachment_path") != "")
        )
    return mails.select(
        "id",
        "sent_at",
        iso_text(F.col("sent_at"), zone).alias("sent_at_local"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        json_list(F.col("to_addresses_json")).alias("to_addresses"),
        json_list(F.col("cc_addresses_json")).alias("cc_addresses"),
        json_list(F.col("bcc_addresses_json")).alias("bcc_addresses"),
        "dataset_id",
        "dataset_name",
        "sheet_name",
        F.coalesce("pivot_rows_count", F.lit(0)).alias("pivot_rows_count"),
        F.coalesce("attached_records_count", F.lit(0)).alias("attached_records_count"),
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("failed")).alias("status"),
        "error_message",
        "attachment_filename",
        "has_attachment",
    )


def search_mail(history: DataFrame, text: str = "", status: str = "", limit: int | None = None) -> DataFrame:
    """The mails of a status whose subject, recipients, dataset or sheet contain the
    text, newest first; ``limit`` of them if given."""
    rows = _listed(history)
    if status:
        rows = rows.where(F.col("status") == status)
    if text:
        hay = F.lower(
            F.concat_ws(
                " ",
                "subject",
                F.array_join("to_addresses", " "),
                F.array_join("cc_addresses", " "),
                F.array_join("bcc_addresses", " "),
                F.coalesce("dataset_name", F.lit("")),
                F.coalesce("sheet_name", F.lit("")),
            )
        )
        rows = rows.where(F.instr(hay, text.lower()) > 0)
    rows = rows.orderBy(F.desc("sent_at"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def recipient_usage(history: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(address, type) with the number of uses and the latest one.

    ``old`` is an earlier result; its state is merged, so only new mails are read.
    """
    kinds = ("to", "cc", "bcc")
    uses = history.select(
        "sent_at",
        F.explode(
            F.concat(
                *[
                    F.transform(
                        json_list(F.col(f"{k}_addresses_json")),
                        _typed_address(k),
                    )
                    for k in kinds
                ]
            )
        ).alias("r"),
    )
    new = (
        uses.select(F.lower(F.trim("r.address")).alias("address"), "r.recipient_type", "sent_at")
        .where(F.col("address") != "")
        .groupBy("address", "recipient_type")
        .agg(F.max("sent_at").alias("last_used_at"), F.count(F.lit(1)).alias("use_count"))
    )
    if old is None:
        return new
    return (
        new.unionByName(old.select(new.columns))
        .groupBy("address", "recipient_type")
        .agg(F.max("last_used_at").alias("last_used_at"), F.sum("use_count").alias("use_count"))
    )


# Buckets of a stored usage table. A merge rewrites the buckets its addresses fall into.
USAGE_BUCKETS = 64
_USAGE = "address string, recipient_type string, last_used_at timestamp_ntz, use_count bigint, version bigint, bucket int"
_LEDGER = "batch_id string, version bigint, bucket int"


class UsageStore:
    """Recipient usage on disk, to which batches of mails are merged once each.

    State lies in buckets by a hash of the address. A merge writes a new version of the
    buckets its addresses fall into, and then one row per bucket to the ledger, in one
    file. The ledger is what counts: a version without a ledger row does not exist, so a
    merge that was broken off leaves nothing behind, and a batch in the ledger is not merged
    again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = USAGE_BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _ledger(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/ledger", _LEDGER)

    def versions(self) -> dict[int, int]:
        """The version in force of each bucket that was ever written."""
        newest = self._ledger().where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("version").alias("version"))
        return {r["bucket"]: r["version"] for r in newest.collect()}

    def _read(self, places: Mapping[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], _USAGE)
        # At most one path a bucket; no other folder is listed.
        paths = [f"{self.path}/state/version={version}/bucket={bucket}" for bucket, version in sorted(places.items())]
        return self.spark.read.schema(_USAGE).option("basePath", f"{self.path}/state").parquet(*paths)

    def usage(self) -> DataFrame:
        """(address, recipient_type, last_used_at, use_count) over all merged batches."""
        return self._read(self.versions()).drop("version", "bucket")

    def merge(self, batch_id: str, history: DataFrame) -> bool:
        """Add the mails of a batch; False if the batch was merged before."""
        if not self._ledger().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        bucket = F.pmod(F.xxhash64("address"), F.lit(self.buckets)).cast("int")
        new = materialise(recipient_usage(history).withColumn("bucket", bucket))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        places = self.versions()
        version = 1 + max((r["version"] for r in self._ledger().agg(F.max("version").alias("version")).collect() if r["version"] is not None), default=0)
        if touched:
            old = self._read({b: v for b, v in places.items() if b in touched})
            both = new.unionByName(old.drop("version"))
            merged = both.groupBy("address", "recipient_type", "bucket").agg(F.max("last_used_at").alias("last_used_at"), F.sum("use_count").alias("use_count"))
            # A folder of this version can only be left over from a merge that was broken off.
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/version={version}")
        entries = [(batch_id, version, b) for b in touched] or [(batch_id, version, None)]
        self.spark.createDataFrame(entries, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True

    def vacuum(self) -> int:
        """Remove the folders that are not in force any more; gives their number."""
        places, gone = self.versions(), 0
        for version in folders(self.spark, f"{self.path}/state"):
            for bucket in folders(self.spark, f"{self.path}/state/{version}"):
                number = lambda name: int(name.split("=")[1])
                if places.get(number(bucket)) != number(version):
                    remove(self.spark, f"{self.path}/state/{version}/{bucket}")
                    gone += 1
        return gone


def _typed_address(kind: str):
    return lambda a: F.struct(a.alias("address"), F.lit(kind).alias("recipient_type"))


def recent_recipients(usage: DataFrame, recipient_type: str | None = None, limit: int = RECIPIENT_ROWS) -> DataFrame:
    """The most recently used recipients."""
    kept = usage if recipient_type is None else usage.where(F.col("recipient_type") == recipient_type)
    return kept.orderBy(F.desc("last_used_at"), "address", "recipient_type").limit(limit)


def clean_addresses(raw: Column, more: Column | None = None) -> tuple[Column, Column]:
    """(addresses, invalid) of one or two address texts: split, trimmed, each kept
    once ignoring case, first spelling first."""
    parts = split_addresses(raw)
    if more is not None:
        parts = F.concat(parts, split_addresses(more))
    return distinct_ignoring_case(parts), invalid_addresses(parts)
