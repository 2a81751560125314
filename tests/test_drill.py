import pytest
from pyspark.sql import functions as F

import pivotlake.operators.drill as drill_module
import pivotlake.operators.tombstones as tombstone_module
from pivotlake import PivotError, PivotSpec, pivot
from pivotlake.functions.rowkeys import row_hash, row_key
from pivotlake.operators.drill import drilldown, drilldown_many, selections_of
from pivotlake.operators.filters import selection_condition, typed_key
from pivotlake.operators.tombstones import (
    TOMBSTONE_SCHEMA,
    begin_delete,
    delete_preview,
    exclude_deleted,
    plan_delete,
    purge_dataset,
    read_audits,
    read_tombstones,
    soft_delete,
    write_tombstones,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(
        [
            (1, "a", "x", "2024-01-05"),
            (2, "a", "y", "2024-02-05"),
            (3, None, "x", "2024-01-09"),
            (4, "b", "x", None),
            (4, "b", "x", None),
        ],
        "k int, g string, h string, d string",
    )


SPEC = PivotSpec(rows=["g", "d"], values=["k"], date_grouping={"d": "month"})


def ids(df):
    return sorted(r[0] for r in rows(df.select("k")))


def test_drilldown_counts_before_the_cap(sheet):
    found = drilldown(sheet, PivotSpec(filters={"h": "x"}), {"g": "b"}, order_by=["k"], limit=1)
    assert ids(found.rows) == [4] and rows(found.matched) == [(2,)]
    assert rows(found.truncated) == [(True,)]
    found = drilldown(sheet, PivotSpec(), {}, order_by=["k"], limit=0, ceiling=None)
    assert found.limit == 1 and found.rows.count() == 1
    assert drilldown(sheet, PivotSpec(), {}, order_by=["k"], limit=9999).limit == drill_module.MOST_ROWS


@pytest.fixture(params=["broadcast", "hashes", "shuffle"])
def either_join(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(drill_module, "BROADCAST_SELECTIONS", 0)
        monkeypatch.setattr(drill_module, "PUSHED_SELECTIONS", 0)
        monkeypatch.setattr(tombstone_module, "BROADCAST_KEYS", 0)
    if request.param == "shuffle":
        monkeypatch.setattr(tombstone_module, "BROADCAST_HASHES", 0)
    return request.param


def test_many_selections_in_one_scan(sheet, either_join):
    selections = [{"g": "a"}, {"g": "a", "d_month": "2024-02"}, {"g": "(blank)"}, {"g": "b"}, {"g": "b"}, {"no": 1}]
    found = drilldown_many(sheet, SPEC, selections)
    # 2 + 1 + 1 + 2 + 2 matches; copies come back once
    assert rows(found.matched) == [(8,)]
    assert ids(found.rows) == [1, 2, 3, 4]
    assert found.rows.columns == sheet.columns


def test_selections_that_fit_no_type_match_nothing(sheet):
    assert rows(drilldown_many(sheet, PivotSpec(rows=["k"]), [{"k": "x"}]).matched) == [(0,)]
    assert ids(drilldown_many(sheet, PivotSpec(rows=["k"]), [{"k": 3.0}]).rows) == [3]
    assert rows(drilldown_many(sheet, SPEC, [{"no": 1}]).rows) == []


def test_pivot_rows_as_selections(sheet, either_join):
    result = pivot(sheet, SPEC)
    chosen = result.rows.where("g <> 'a'")
    selections = selections_of(chosen, SPEC)
    assert selections.columns == ["g", "d_month"]
    assert ids(drilldown_many(sheet, SPEC, selections).rows) == [3, 4]


def test_row_key_treats_null_and_empty_alike(spark):
    df = spark.createDataFrame([(1, "", float("nan")), (1, None, None)], "a int, b string, c double")
    assert len(set(rows(df.select(row_key(df))))) == 1
    swapped = df.select("c", "b", "a")
    assert rows(swapped.select(row_key(swapped))) == rows(df.select(row_key(df)))


def test_row_hash_follows_the_key(spark):
    narrow = spark.createDataFrame([(1, "", 1.5), (2, "x", None)], "a int, b string, c double")
    wide = narrow.selectExpr("CAST(a AS BIGINT) AS a", "nullif(b, '') AS b", "c")
    for fn in (row_key, row_hash):
        assert rows(narrow.select(fn(narrow))) == rows(wide.select(fn(wide)))


def test_delete_removes_all_copies_and_is_repeatable(spark, sheet, tmp_path, either_join):
    where = {
        "dataset_id": 7,
        "dataset_name": "sheet",
        "sheet_name": "s",
        "tombstone_path": str(tmp_path / "tombs"),
        "audit_path": str(tmp_path / "audits"),
    }
    first = soft_delete(sheet, SPEC, [{"g": "b"}, {"g": "b"}], **where)
    assert (first["matched"], first["deleted"]) == (4, 1)
    again = soft_delete(sheet, SPEC, [{"g": "b"}], **where)
    assert (again["matched"], again["deleted"]) == (2, 0)
    tombs = spark.read.parquet(where["tombstone_path"])
    assert ids(exclude_deleted(sheet, tombs, 7, "s")) == [1, 2, 3]
    assert ids(exclude_deleted(sheet, tombs, 8, "s")) == [1, 2, 3, 4, 4]
    audits = read_audits(spark, where["audit_path"]).orderBy("timestamp").select("status", "source_records_deleted")
    assert rows(audits) == [("success", 1), ("success", 0)]
    after = exclude_deleted(sheet, tombs, 7, "s")
    assert pivot(after, SPEC).rows.count() == pivot(sheet, SPEC).rows.count() - 1


def test_failed_delete_is_recorded(spark, sheet, tmp_path):
    where = {"tombstone_path": str(tmp_path / "t"), "audit_path": str(tmp_path / "a")}
    with pytest.raises(PivotError):
        soft_delete(sheet, SPEC, [{}], dataset_id=1, dataset_name="x", sheet_name="s", **where)
    assert rows(read_audits(spark, where["audit_path"]).select("status")) == [("failed",)]


def test_deletes_need_a_selection(spark, sheet):
    none = spark.createDataFrame([], TOMBSTONE_SCHEMA)
    with pytest.raises(PivotError):
        plan_delete(sheet, SPEC, [], none, 1, "s")
    with pytest.raises(PivotError):
        plan_delete(sheet, SPEC, [{}], none, 1, "s")


def test_preview_tags(spark):
    df = spark.range(2001).selectExpr("id AS k", "if(id < 600, 'mid', 'rest') AS g")
    spec = PivotSpec(rows=["g"])
    assert rows(delete_preview(df, spec, [{"g": "mid"}])) == [(600, "LARGE")]
    assert rows(delete_preview(df, spec, [{"g": "mid"}, {"g": "rest"}])) == [(2001, "HUGE")]
    assert rows(delete_preview(df, spec, [{"k": 1}])) == [(1, "")]


def test_purge_keeps_other_datasets(spark):
    datasets = spark.sql("SELECT id, 'f' AS filename, 'g' AS stored_filename, 1L AS total_rows, 2 AS total_columns, "
                         "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS upload_time FROM VALUES (1L), (2L) t(id)")
    owned = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') t(dataset_id, x)")
    left = purge_dataset(
        {
            "datasets": datasets,
            "sheets": owned,
            "columns": owned,
            "tombstones": owned,
            "audits": owned,
            "deleted_datasets": spark.createDataFrame([], "original_id bigint"),
        },
        1,
    )
    assert rows(left["datasets"].select("id")) == [(2,)]
    assert all(rows(left[t].select("x")) == [("b",)] for t in ("sheets", "columns", "tombstones", "audits"))
    assert rows(left["deleted_datasets"].select("original_id", "deleted_by")) == [(1, "ui")]


# Selected values of every kind, as text and typed; each is asked of every column.
GIVEN = {
    "string": ["5", "5.5", " 5 ", "5.0", "0.5e1", "50E-1", "55e-1", "abc", "", "(blank)", None, "1e400", "0", "-0", "true", "yes", "2024-01-05", "2024-01-05T00:00:00", "nonsense", ".5", "5.", "1_0", "0.00000000001", "99999999999999999999"],
    "double": [5.0, 5.5, 0.5, -0.0, float("nan"), None, 1e30, float("inf"), 1e10],
    "bigint": [5, 0, 1, None, 10],
    "boolean": [True, False, None],
    "decimal(30,12)": ["5.000000000000", "5.500000000000", "0.000000000010", None],
    "date": ["2024-01-05", None],
    "timestamp_ntz": ["2024-01-05 00:00:00", "2024-01-05 10:00:00.5", None],
}


@pytest.fixture(scope="module")
def kinds(spark):
    """Five rows of every type of column, one of them missing in all."""
    made = spark.createDataFrame(
        [(1, "5", 5, 5.0, True, "2024-01-05", "5"), (2, "5.5", 1, 5.5, False, "2024-01-06", "5.5"), (3, "true", 0, 0.5, True, "2024-01-05", "0.00000000001"), (4, "2024-01-05T00:00:00", 10, 1e10, None, "2024-01-07", "0"), (5, None, None, None, None, None, None)],
        "id int, s string, l bigint, x double, b boolean, dt string, dd string",
    )
    return made.selectExpr("id", "s", "l", "x", "b", "CAST(dt AS DATE) AS d", "CAST(dt AS TIMESTAMP_NTZ) AS t", "CAST(dd AS DECIMAL(30,15)) AS c")


@pytest.mark.parametrize("column", ["s", "l", "x", "b", "d", "t", "c"])
def test_frame_selects_what_the_list_selects(spark, kinds, column):
    """Each given value as a list of one against the frame of all, told apart by its number."""
    dtype = kinds.schema[column].dataType
    for given, values in GIVEN.items():
        texts = [(i, None if v is None else str(v)) for i, v in enumerate(values)]
        frame = spark.createDataFrame(texts, "i int, v string").selectExpr("i", f"try_cast(v AS {given}) AS v")
        key = typed_key(F.col("v"), frame.schema["v"].dataType, dtype)
        state = {r.i: r for r in frame.select("i", "v", key.value.alias("value"), key.wants_missing.alias("missing"), key.misfit.alias("misfit")).collect()}
        asked = [(i, selection_condition(kinds, {column: r.v}, {})) for i, r in state.items()]
        by_list = kinds.select("id", *[F.coalesce(c, F.lit(False)).alias(f"m{i}") for i, c in asked]).collect()
        same = frame.select("i", F.when(key.misfit, F.lit(None)).otherwise(key.value).alias("value"), key.wants_missing.alias("missing"), key.misfit.alias("misfit"))
        both = kinds.select("id", F.col(column).alias("cell")).crossJoin(same.withColumnRenamed("i", "n"))
        hit = both.where(~F.col("misfit") & (F.col("value").eqNullSafe(F.col("cell")))).select("n", "id").collect()
        for i, r in state.items():
            want = sorted(row.id for row in by_list if row[f"m{i}"])
            assert sorted(x.id for x in hit if x.n == i) == want, (given, r.v)


def test_misfits_delete_nothing(spark, kinds, either_join):
    none = spark.createDataFrame([], TOMBSTONE_SCHEMA)
    for column, values in (("l", ["5.5", "abc"]), ("d", ["nonsense"]), ("b", ["maybe"]), ("x", ["five"]), ("c", ["0.0000000000000001"])):
        frame = spark.createDataFrame([(v,) for v in values], f"`{column}` string")
        assert plan_delete(kinds, PivotSpec(rows=[column]), frame, none, 1, "s").rows.collect() == []
    # One value that fits none spoils its selection, not the others.
    pairs = spark.createDataFrame([("5", "nonsense"), ("1", "2024-01-06"), (None, "(blank)")], "l string, d string")
    assert sorted(r.id for r in drilldown_many(kinds, PivotSpec(rows=["l", "d"]), pairs).rows.collect()) == [2, 5]


def test_a_delete_broken_off_is_completed(spark, sheet, tmp_path):
    paths = {"tombstone_path": str(tmp_path / "t"), "audit_path": str(tmp_path / "a")}
    where = {"dataset_id": 1, "dataset_name": "x", "sheet_name": "s 1", **paths}
    other = {**where, "dataset_id": 2}
    soft_delete(sheet, SPEC, [{"g": "a"}], **other)
    chosen = spark.createDataFrame([("b",), ("(blank)",)], "g string")

    # Broken off before any tombstone, then after all of them.
    first = begin_delete(spark, SPEC, chosen, **where)
    again = begin_delete(spark, SPEC, chosen, **where)
    assert (first.resumed, again.resumed) == (False, True) and first.audit_id == again.audit_id
    assert write_tombstones(sheet, SPEC, chosen, again) == (3, 2)
    dead = lambda: read_tombstones(spark, **paths, dataset_id=1, sheet_name="s 1")
    assert dead().count() == 0 and spark.read.parquet(paths["tombstone_path"]).count() == 4
    assert ids(exclude_deleted(sheet, dead(), 1, "s 1")) == [1, 2, 3, 4, 4]

    done = soft_delete(sheet, SPEC, chosen, **where)
    assert done["resumed"] and done["audit_id"] == first.audit_id and done["deleted"] == 2
    assert dead().count() == 2 and spark.read.parquet(paths["tombstone_path"]).count() == 4
    assert ids(exclude_deleted(sheet, dead(), 1, "s 1")) == [1, 2]
    assert sorted(rows(read_audits(spark, paths["audit_path"]).select("dataset_id", "status"))) == [(1, "success"), (2, "success")]
    # Another request is another delete.
    assert not soft_delete(sheet, SPEC, spark.createDataFrame([("b",)], "g string"), **where)["resumed"]
    plan = dead()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "sheet_name" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_failed_delete_leaves_nothing_in_force(spark, sheet, tmp_path):
    paths = {"tombstone_path": str(tmp_path / "t"), "audit_path": str(tmp_path / "a")}
    where = {"dataset_id": 1, "dataset_name": "x", "sheet_name": "s", **paths}
    request = begin_delete(spark, SPEC, [{"g": "b"}], **where)
    write_tombstones(sheet, SPEC, [{"g": "b"}], request)
    tombstone_module._record(spark, request, "failed", message="lost")
    assert read_tombstones(spark, **paths).count() == 0
    assert soft_delete(sheet, SPEC, [{"g": "b"}], **where)["deleted"] == 1
    assert read_tombstones(spark, **paths).count() == 1
