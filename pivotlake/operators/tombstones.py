"""Soft deletion by row content: tombstones, their exclusion, and the audit trail."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.errors import PivotError
from pivotlake.functions.names import q
from pivotlake.functions.rowkeys import ROW_HASH, ROW_KEY, content, row_hash, row_key
from pivotlake.operators.drill import matched_hits
from pivotlake.plans.checks import to_json
from pivotlake.session import materialise
from pivotlake.sources.stores import exists
from pivotlake.spec import PivotSpec

TOMBSTONE_SCHEMA = (
    "dataset_id bigint, sheet_name string, source_key string, row_hash bigint, row_payload string, "
    "pivot_request string, deleted_at timestamp_ntz, deleted_by string, delete_audit_id string"
)
AUDIT_SCHEMA = (
    "id string, timestamp timestamp_ntz, dataset_id bigint, dataset_name string, sheet_name string, "
    "pivot_rows_count bigint, source_records_found bigint, source_records_deleted bigint, "
    "selection_criteria string, status string, error_message string, actor string, pivot_payload_json string"
)

# Keys up to this count are broadcast: 64 characters each, about 100 MB on an executor.
BROADCAST_KEYS = 500_000
# Hashes up to this count are broadcast: 8 bytes each, about 200 MB on an executor.
BROADCAST_HASHES = 8_000_000

# Above these counts a delete is tagged.
LARGE, HUGE = 500, 2000


def key_columns_of(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """The two columns by which a tombstone finds its rows."""
    return [row_key(df, columns).alias(ROW_KEY), row_hash(df, columns).alias(ROW_HASH)]


def exclude_deleted(
    df: DataFrame,
    tombstones: DataFrame,
    dataset_id: int,
    sheet_name: str,
    key_columns: Sequence[str] | None = None,
    broadcast_keys: int | None = None,
    broadcast_hashes: int | None = None,
) -> DataFrame:
    """The rows of a sheet without its deleted ones; all identical copies go together.

    A row is deleted if a tombstone has its key, and its hash too where the tombstone
    has one; that is the same test for any number of tombstones.

    Every read of a sheet passes here, so the table should not be shuffled. Few
    tombstones are broadcast whole; their cheap hash is the join key and the SHA-256
    key is only computed for rows whose hash is among them. Of more tombstones only
    the hashes are broadcast: they split off the suspect rows, about as many as were
    deleted, and only those are joined by key. Beyond that everything is joined by key;
    the keys are distinct, so that a key with very many rows can be split. Tombstones
    without a hash are joined by key in any case.
    """
    keys = (
        tombstones.where((F.col("dataset_id") == dataset_id) & (F.col("sheet_name") == sheet_name))
        .select(F.col(ROW_KEY).alias("__dead_key"), F.col(ROW_HASH).alias("__dead_hash"))
        .distinct()
    )
    broadcast_keys = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    broadcast_hashes = BROADCAST_HASHES if broadcast_hashes is None else broadcast_hashes
    keys = materialise(keys)
    hashed, bare = keys.where("__dead_hash IS NOT NULL"), keys.where("__dead_hash IS NULL").select("__dead_key")
    n, n_bare = keys.agg(F.count("__dead_hash"), F.count_if(F.col("__dead_hash").isNull())).first()
    own_key, own_hash = row_key(df, key_columns), row_hash(df, key_columns)
    if n_bare:
        dead = F.broadcast(bare) if n_bare <= broadcast_keys else bare
        df = df.join(dead, own_key == F.col("__dead_key"), "left_anti")
    if not n:
        return df
    if n <= broadcast_keys:
        # Both keys have 64 characters, so containing means equal; unlike an equality
        # it stays a condition behind the hash look-up.
        same = (own_hash == F.col("__dead_hash")) & F.col("__dead_key").contains(own_key)
        return df.join(F.broadcast(hashed), same, "left_anti")
    both = (own_key == F.col("__dead_key")) & (own_hash == F.col("__dead_hash"))
    if n > broadcast_hashes:
        return df.join(hashed, both, "left_anti")
    hashes = F.broadcast(hashed.select(F.col("__dead_hash").alias("__hash")).distinct())
    suspects = df.join(hashes, own_hash == F.col("__hash"), "left_semi").join(hashed, both, "left_anti")
    return df.join(hashes, own_hash == F.col("__hash"), "left_anti").unionByName(suspects)


def anti_join_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``keys`` (distinct).

    Few keys are broadcast. Many are joined by a shuffle, in which the rows of a key
    that has very many can be split, because the other side has one.
    """
    keys = materialise(keys)
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_anti")


@dataclass
class DeletePlan:
    """New tombstones, and the number of matches over all selections."""

    rows: DataFrame
    matched: DataFrame


def plan_delete(
    df: DataFrame,
    spec: PivotSpec,
    selections: DataFrame | Sequence[Mapping[str, Any]],
    tombstones: DataFrame,
    dataset_id: int,
    sheet_name: str,
    key_columns: Sequence[str] | None = None,
) -> DeletePlan:
    """What a delete would add: each new key once, keys deleted before left out.

    There is no row cap. Selections that name no known field match nothing; a
    delete without selections, or with an empty one, is refused.
    """
    if not isinstance(selections, DataFrame) and not selections:
        raise PivotError("no pivot rows selected for deletion")
    hit = matched_hits(df, spec, selections)
    known = (
        tombstones.where((F.col("dataset_id") == dataset_id) & (F.col("sheet_name") == sheet_name))
        .select(F.col("source_key").alias(ROW_KEY))
        .distinct()
    )
    new = (
        hit.select(*key_columns_of(df, key_columns), content(df).alias("row_payload"))
        .groupBy(ROW_KEY, ROW_HASH)
        .agg(F.min("row_payload").alias("row_payload"))
    )
    return DeletePlan(
        anti_join_keys(new, known, ROW_KEY),
        hit.agg(F.coalesce(F.sum("__hits"), F.lit(0)).alias("matched_rows")),
    )


def delete_preview(df: DataFrame, spec: PivotSpec, selections: Sequence[Mapping[str, Any]] | DataFrame) -> DataFrame:
    """One row: matches over all selections, overlaps counted again, and a size tag."""
    hit = matched_hits(df, spec, selections)
    return hit.agg(F.coalesce(F.sum("__hits"), F.lit(0)).alias("matched")).withColumn("tag", size_tag(F.col("matched")))


def size_tag(count: Column) -> Column:
    return F.when(count > HUGE, "HUGE").when(count > LARGE, "LARGE").otherwise("")


# Deletes on disk -----------------------------------------------------------------------------
#
# A delete first records its intent, then writes its tombstones, then records how it ended.
# Tombstones lie by dataset, sheet and delete, and are in force only once their delete has
# ended well. A delete that was broken off has changed nothing that a reader sees; the same
# request finds it, writes its tombstones over what may be there, and ends it.

PENDING, SUCCESS, FAILED = "pending", "success", "failed"
_PLACES = ("dataset_id", "sheet_name", "delete_audit_id")


@dataclass(frozen=True)
class DeleteRequest:
    """What is to be deleted, and where it is recorded."""

    dataset_id: int
    dataset_name: str
    sheet_name: str
    tombstone_path: str
    audit_path: str
    actor: str
    criteria: str
    payload: str
    n_selections: int
    audit_id: str
    resumed: bool


def read_audits(spark: SparkSession, audit_path: str) -> DataFrame:
    """One row per delete: how it ended, or its intent as long as it has not."""
    written = read_or_empty(spark, audit_path, AUDIT_SCHEMA)
    latest = F.max_by(F.struct(*written.columns), F.struct(F.col("status") != PENDING, "timestamp")).alias("last")
    return written.groupBy(F.col("id").alias("of")).agg(latest).select("last.*")


def read_tombstones(spark: SparkSession, tombstone_path: str, audit_path: str, dataset_id: int | None = None, sheet_name: str | None = None) -> DataFrame:
    """The tombstones in force; of one dataset and sheet only their folders are read."""
    written = read_or_empty(spark, tombstone_path, TOMBSTONE_SCHEMA)
    if dataset_id is not None:
        written = written.where(F.col("dataset_id") == dataset_id)
    if sheet_name is not None:
        written = written.where(F.col("sheet_name") == sheet_name)
    ended = read_or_empty(spark, audit_path, AUDIT_SCHEMA).where(F.col("status") == SUCCESS)
    return written.join(ended.select(F.col("id").alias("delete_audit_id")).distinct(), "delete_audit_id", "left_semi").select(*written.columns)


def _criteria(selections: DataFrame | Sequence[Mapping[str, Any]]) -> tuple[str, int]:
    """The text by which a request is known again, and the number of selections. A frame is
    known by its columns, its count and a hash of its rows in any order."""
    if not isinstance(selections, DataFrame):
        return json.dumps(list(selections), default=str), len(selections)
    columns = [q(c) for c in selections.columns]
    n, code = selections.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*columns))).first()
    return json.dumps({"fields": selections.columns, "rows": n, "hash": code}), n


def _record(spark: SparkSession, request: DeleteRequest, status: str, found: int = 0, deleted: int = 0, message: str | None = None) -> None:
    values = (
        request.audit_id, request.dataset_id, request.dataset_name, request.sheet_name, request.n_selections, found, deleted,
        request.criteria, status, message, request.actor, request.payload,
    )
    audit = spark.createDataFrame(
        [values],
        "id string, dataset_id bigint, dataset_name string, sheet_name string, pivot_rows_count bigint, "
        "source_records_found bigint, source_records_deleted bigint, selection_criteria string, "
        "status string, error_message string, actor string, pivot_payload_json string",
    ).withColumn("timestamp", utc_now())
    _as_schema(spark, audit, AUDIT_SCHEMA).coalesce(1).write.mode("append").parquet(request.audit_path)


def begin_delete(
    spark: SparkSession,
    spec: PivotSpec,
    selections: DataFrame | Sequence[Mapping[str, Any]],
    *,
    dataset_id: int,
    dataset_name: str,
    sheet_name: str,
    tombstone_path: str,
    audit_path: str,
    actor: str = "ui",
) -> DeleteRequest:
    """Record the intent of a delete, or find the same one that has not ended."""
    criteria, n = _criteria(selections)
    payload = to_json(spec)
    same = (
        (F.col("status") == PENDING)
        & (F.col("dataset_id") == dataset_id)
        & (F.col("sheet_name") == sheet_name)
        & (F.col("selection_criteria") == criteria)
        & (F.col("pivot_payload_json") == payload)
    )
    unfinished = read_audits(spark, audit_path).where(same).orderBy("timestamp", "id").select("id").first()
    audit_id = unfinished.id if unfinished else spark.range(1).select(F.uuid()).first()[0]
    request = DeleteRequest(
        dataset_id, dataset_name, sheet_name, tombstone_path, audit_path, actor, criteria, payload, n, audit_id, unfinished is not None
    )
    if not unfinished:
        _record(spark, request, PENDING)
    return request


def write_tombstones(
    df: DataFrame,
    spec: PivotSpec,
    selections: DataFrame | Sequence[Mapping[str, Any]],
    request: DeleteRequest,
    key_columns: Sequence[str] | None = None,
) -> tuple[int, int]:
    """Write the tombstones of a delete to its own folder; what a run that was broken off
    left there is overwritten. Gives the matches and the keys deleted.

    The plan is checkpointed before it is written, so the counts and the rows agree.
    """
    spark = df.sparkSession
    known = read_tombstones(spark, request.tombstone_path, request.audit_path, request.dataset_id, request.sheet_name)
    plan = plan_delete(df, spec, selections, known, request.dataset_id, request.sheet_name, key_columns)
    new = materialise(plan.rows)
    matched = plan.matched.first()[0]
    deleted = new.count()
    rows = new.withColumns(
        {
            "dataset_id": F.lit(request.dataset_id).cast("bigint"),
            "sheet_name": F.lit(request.sheet_name),
            "pivot_request": F.lit(request.payload),
            "deleted_at": utc_now(),
            "deleted_by": F.lit(request.actor),
            "delete_audit_id": F.lit(request.audit_id),
        }
    )
    out = _as_schema(spark, rows, TOMBSTONE_SCHEMA)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACES).parquet(request.tombstone_path)
    return matched, deleted


def soft_delete(
    df: DataFrame,
    spec: PivotSpec,
    selections: DataFrame | Sequence[Mapping[str, Any]],
    *,
    key_columns: Sequence[str] | None = None,
    **where: Any,
) -> dict[str, Any]:
    """Delete the raw rows behind pivot rows and record the operation.

    ``where`` are the names and paths of :func:`begin_delete`. A failure is recorded and
    raised again. Running it a second time adds nothing, because keys already there are left
    out; a run that was broken off is completed under its first record.
    """
    if not isinstance(selections, DataFrame) and not selections:
        raise PivotError("no pivot rows selected for deletion")
    spark = df.sparkSession
    request = begin_delete(spark, spec, selections, **where)
    try:
        matched, deleted = write_tombstones(df, spec, selections, request, key_columns)
    except Exception as exc:
        _record(spark, request, FAILED, message=str(exc))
        raise
    _record(spark, request, SUCCESS, matched, deleted)
    return {"audit_id": request.audit_id, "matched": matched, "deleted": deleted, "selections": request.n_selections, "resumed": request.resumed}


def utc_now() -> Column:
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, or no rows where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _as_schema(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
    wanted = spark.createDataFrame([], schema).schema
    return df.select(*[q(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def purge_dataset(tables: Mapping[str, DataFrame], dataset_id: int, actor: str = "ui") -> dict[str, DataFrame]:
    """The tables left after removing a dataset, with its snapshot appended.

    ``tables`` holds datasets, sheets, columns, tombstones, audits and
    deleted_datasets; mail history is not touched by a purge.
    """
    snapshot = tables["datasets"].where(F.col("id") == dataset_id).select(
        F.col("id").alias("original_id"),
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("stored_filename", F.lit("")).alias("stored_filename"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("total_columns", F.lit(0)).alias("total_columns"),
        "upload_time",
        utc_now().alias("deleted_at"),
        F.lit(actor).alias("deleted_by"),
    )
    left = {"datasets": tables["datasets"].where(~F.col("id").eqNullSafe(dataset_id))}
    for name in ("sheets", "columns", "tombstones", "audits"):
        left[name] = tables[name].where(~F.col("dataset_id").eqNullSafe(dataset_id))
    left["deleted_datasets"] = tables["deleted_datasets"].unionByName(snapshot, allowMissingColumns=True)
    return left


def audit_search(
    audits: DataFrame,
    query: str | None = None,
    status: str | None = None,
    dataset_id: int | None = None,
    limit: int = 100,
) -> DataFrame:
    """Audits newest first; ``query`` is looked up in dataset name and criteria."""
    found = audits
    if query:
        found = found.where(has_text("dataset_name", query) | has_text("selection_criteria", query))
    if status:
        found = found.where(F.col("status") == status)
    if dataset_id is not None:
        found = found.where(F.col("dataset_id") == dataset_id)
    return found.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def has_text(column: str, text: str) -> Column:
    """Case-insensitive substring test; false for nulls."""
    return F.coalesce(F.instr(F.lower(column), text.lower()) > 0, F.lit(False))
