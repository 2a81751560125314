import shutil
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from pivotlake import PivotError
from pivotlake.operators.directory import search_directory, starter_list
from pivotlake.operators.logs import boundary_day, keep_latest, purge_logs, read_logs, retained, search_logs, trim_logs, write_logs
from pivotlake.operators.mail import UsageStore, mail_history, recent_recipients, recipient_usage
from pivotlake.functions.text import distinct_ignoring_case, json_list, split_addresses
from pivotlake.functions.zones import iso_text, parse_zone, readable_text
from pivotlake.sources.catalog import catalog_nested, column_kind_counts, register
from pivotlake.sources.directory import load_directory
from pivotlake.sources.files import audit_files, inventory, listing, orphans, stale
from pivotlake.sources.profile import profile
from pivotlake.sources.sheets import files_spanning_lines, land_csv, preview, read_csv, read_csv_text, read_sheet
from tests.conftest import rows


def test_profile_ladder(spark):
    df = spark.createDataFrame(
        [
            ("yes", 0.0, "2024-01-05", "12", "1.5", "12", None, "1/5/2024", "1", 1.5, float("nan"), True, "99999999999999999999"),
            ("No", 1.0, "2024-02-06 10:00", " -7 ", "2e3", "x", None, "12/31/2023", "0", 2.0, None, None, "1"),
            (None, None, None, "0", ".5", "2024-01-01", None, None, None, 3.0, None, False, "2"),
        ],
        "words string, flags double, dates string, ints string, floats string, mixed string, nothing string, "
        "slashes string, bits string, real double, nans double, b boolean, big string",
    )
    got = {r["column_name"]: (r["data_type"], r["is_nullable"]) for r in profile(df).collect()}
    assert got == {
        "words": ("boolean", True),
        "flags": ("boolean", True),
        "dates": ("datetime", True),
        "ints": ("integer", False),
        "floats": ("float", False),
        "mixed": ("string", False),
        "nothing": ("string", True),
        "slashes": ("datetime", True),
        "bits": ("boolean", True),
        "real": ("float", False),
        "nans": ("string", True),
        "b": ("boolean", True),
        "big": ("float", False),
    }
    assert [r["position"] for r in profile(df).orderBy("position").collect()] == list(range(13))


def test_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(profile(df).orderBy("position")) == [(0, "a", "string", False), (1, "b", "string", False)]


def test_catalog_from_one_scan(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    datasets, sheets, columns = register({"f.csv": {"one": df, "two": df.limit(1)}, "g.csv": {"one": df.where("a = 1")}})
    assert rows(datasets.select("id", "filename", "total_rows", "total_columns").orderBy("id")) == [
        (1, "f.csv", 2, 2),
        (2, "g.csv", 1, 2),
    ]
    assert rows(sheets.select("id", "sheet_name", "row_count").orderBy("id")) == [(1, "one", 2), (2, "two", 1), (3, "one", 1)]
    assert rows(column_kind_counts(columns).orderBy("dataset_id")) == [(1, 0, 2, 2), (2, 0, 1, 1)]
    tree = catalog_nested(datasets, sheets, columns).orderBy("id").first()
    assert [s["sheet_name"] for s in tree["sheets"]] == ["one", "two"]
    assert [c["column_name"] for c in tree["sheets"][0]["columns"]] == ["a", "b"]


def test_csv_with_missing_words_and_types(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('id,name,when,score,ok\n1,"a, ""b""",2024-01-02,1.5,yes\n2,N/A,2024-01-03,NaN,no\n3, NA,,2,\n')
    df = read_csv(spark, str(path))
    assert [f.dataType for f in df.schema.fields] == [
        T.LongType(),
        T.StringType(),
        T.TimestampNTZType(),
        T.DoubleType(),
        T.BooleanType(),
    ]
    assert rows(df) == [
        (1, 'a, "b"', datetime(2024, 1, 2), 1.5, True),
        (2, None, datetime(2024, 1, 3), None, False),
        (3, " NA", None, 2.0, None),
    ]
    typed = read_sheet(spark, str(path), schema="id int, score decimal(10,2), when date")
    assert [str(v) for v in rows(typed.select("id", "score", "when"))[0]] == ["1", "1.50", "2024-01-02"]


def test_csv_cells_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert rows(read_csv(spark, str(tmp_path / "m.csv"))) == [(1, "x\ny"), (2, "z")]


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("k,t\n" + "".join(f"{i},plain text\n" for i in range(20_000)))
    (folder / "b.csv").write_text('k,t\n-1,"two\nlines"\n-2,"a ""quoted"" word"\n')
    (folder / "c.csv").write_text('k,t\n-3,"one "" quote"\n')
    names = [f.rsplit("/", 1)[1] for f in files_spanning_lines(spark, str(folder))]
    assert names == ["b.csv"] or names == ["b.csv", "c.csv"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        text = read_csv_text(spark, str(folder), file_column="f", keep_order=True)
        placed = text.select(F.col("f"), F.spark_partition_id().alias("p")).distinct().collect()
        assert len([r for r in placed if r.f.endswith("a.csv")]) > 3
        assert text.count() == 20_003
        assert sorted(r.t for r in text.where("k < 0").collect()) == ['a "quoted" word', 'one " quote', "two\nlines"]
        assert [r.k for r in text.orderBy("__file_order").limit(3).collect()] == ["0", "1", "2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rejected_cells_are_counted_and_kept(spark, tmp_path):
    folder = tmp_path / "s.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("n,x,d,b,t\n1,1.5,2024-01-05,yes,a\n1e5,\"1,234\",someday,maybe,b\n,NaN,,N/A,\n")
    (folder / "b.csv").write_text("n,x,d,b,t\n2.5,2e3,1/5/2024,no,c\nseven,4,2024-02-30,1,d\n")
    landed = land_csv(spark, str(folder), str(tmp_path / "out"), "n int, x double, d date, b boolean, t string")
    assert sorted((r.t or "", r.n, r.x, str(r.d), r.b) for r in landed.rows.collect()) == [
        ("", None, None, "None", None),
        ("a", 1, 1.5, "2024-01-05", True),
        ("b", None, None, "None", None),
        ("c", None, 2000.0, "2024-01-05", False),
        ("d", None, 4.0, "None", True),
    ]
    found = sorted((r.file.rsplit("/", 1)[1], r["column"], r["count"], r.example) for r in landed.rejects.collect())
    assert found == [
        ("a.csv", "b", 1, "maybe"),
        ("a.csv", "d", 1, "someday"),
        ("a.csv", "n", 1, "1e5"),
        ("a.csv", "x", 1, "1,234"),
        ("b.csv", "d", 1, "2024-02-30"),
        ("b.csv", "n", 2, "2.5"),
    ]
    assert land_csv(spark, str(folder), str(tmp_path / "out2")).rejects.count() == 0
    with pytest.raises(PivotError):
        land_csv(spark, str(folder), str(tmp_path / "out3"), "q int")


def test_listing_walks_folders_in_tasks(spark, tmp_path):
    for name in ("a/b/c/deep.csv", "a/x.csv", "a/b/empty.csv", "a/.hidden/y.csv", "_tmp/z.csv", "a/b/blank name+%41.csv", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "12345")
    found = {r.path: r.length for r in listing(spark, str(tmp_path)).collect()}
    assert found == {f"file:{tmp_path}/{n}": 0 if "empty" in n else 5 for n in ("a/b/c/deep.csv", "a/x.csv", "a/b/empty.csv", "a/b/blank name+%41.csv", "top.txt")}
    assert {r.path for r in listing(spark, f"file://{tmp_path}", "*.txt").collect()} == {f"file:{tmp_path}/top.txt"}
    assert listing(spark, str(tmp_path)).where("modificationTime > current_timestamp() - INTERVAL 1 HOUR").count() == 5
    assert listing(spark, str(tmp_path / "missing")).collect() == []
    one = listing(spark, str(tmp_path / "top.txt")).collect()
    assert [(r.path, r.length) for r in one] == [(f"file:{tmp_path}/top.txt", 5)]


def test_csv_without_rows_is_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(PivotError):
        read_csv(spark, str(tmp_path / "e.csv"))
    with pytest.raises(PivotError):
        read_csv(spark, str(tmp_path / "e.csv"), "c int")


def test_preview_is_ordered_and_text_dated(spark):
    df = spark.range(50).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("d"), F.lit(float("inf")).alias("x"))
    shown = rows(preview(df.orderBy(F.desc("id")), ["id"]))
    assert len(shown) == 20 and shown[0] == (0, "2024-01-01 00:00:00", None)
    assert preview(df).count() == 20


def test_directory_first_address_wins_in_file_order(spark, tmp_path):
    users = tmp_path / "users.csv"
    users.write_text(
        '"DisplayName","PrimarySmtpAddress","Alias"\n'
        '" Ann ","ANN@x.org","A1"\n"Bob","",""\n"Ann Two","ann@x.org","a2"\n"","c@x.org","C"\n"None","n@x.org",""\n'
    )
    lists = tmp_path / "lists.csv"
    lists.write_text('"DisplayName","Alias","PrimarySmtpAddress","ManagedBy"\n"Ann list","al","ann@x.org","z"\n')
    found = load_directory(spark, str(users), str(lists))
    assert sorted(rows(found)) == [
        ("ann@x.org", "Ann", "a1", "user"),
        ("ann@x.org", "Ann list", "al", "distribution_list"),
        ("c@x.org", "c@x.org", "c", "user"),
        ("n@x.org", "None", "", "user"),
    ]
    assert [r[1] for r in rows(search_directory(found, "ann"))] == ["Ann", "Ann list"]
    assert [r[3] for r in rows(search_directory(found, "ANN@x.org"))] == ["user", "distribution_list"]
    assert [r[1] for r in rows(search_directory(found, "x.org an", kind="user"))] == ["Ann"]
    assert rows(search_directory(found, " ")) == []
    assert [r[1] for r in rows(starter_list(found, 2))] == ["Ann", "Ann list"]


def test_directory_ranks_name_prefix_before_address_prefix(spark):
    entries = spark.createDataFrame(
        [("kim@x.org", "Zoe", "kim", "user"), ("z@x.org", "Kim", "z", "distribution_list"), ("kim2@x.org", "Abe", "", "user")],
        "email string, name string, alias string, kind string",
    )
    assert [r[1] for r in rows(search_directory(entries, "kim"))] == ["Kim", "Abe", "Zoe"]
    assert [r[1] for r in rows(search_directory(entries, "kim@x.org"))] == ["Zoe"]


def test_file_audit_verdicts(spark, tmp_path):
    root = tmp_path / "landed"
    root.mkdir()
    (root / "good.csv").write_text("a,b\n1,2\n")
    (root / "umlaut.csv").write_text("ä,ö\n1,2\n")
    (root / "nul.csv").write_bytes(b"a,b,c,d,e,f\n1\x002\n")
    (root / "early_nul.csv").write_bytes(b"a\x00b")
    (root / "binary.csv").write_bytes(b"\x01\x02\x03\x04abcd")
    (root / "blank.csv").write_text("  \n \n")
    (root / "big.csv").write_text("x" * 200)
    (root / "notes.txt").write_text("x")
    (root / "fake.xlsx").write_text("a,b\n")
    with zipfile.ZipFile(root / "zip.xlsx", "w") as z:
        z.writestr("other.xml", "x")
    with zipfile.ZipFile(root / "ok.xlsx", "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("xl/workbook.xml", "x")
    found = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in audit_files(spark, str(root)).collect()}
    assert found == {
        "good.csv": "ok",
        "umlaut.csv": "ok",
        "nul.csv": "null_bytes",
        "early_nul.csv": "not_text",
        "binary.csv": "not_text",
        "blank.csv": "empty",
        "big.csv": "ok",
        "notes.txt": "suffix",
        "fake.xlsx": "not_a_workbook",
        "zip.xlsx": "workbook_parts_missing",
        "ok.xlsx": "ok",
    }
    small = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in audit_files(spark, str(root), max_bytes=150).collect()}
    assert small["big.csv"] == "too_large" and small["good.csv"] == "ok"
    named = listing(spark, str(root)).select(
        "path", F.when(F.col("path").endswith("good.csv"), "image/png").otherwise("text/csv; charset=utf-8").alias("content_type")
    )
    typed = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in audit_files(spark, str(root), named).collect()}
    assert typed["good.csv"] == "content_type" and typed["umlaut.csv"] == "ok" and typed["notes.txt"] == "suffix"


def test_inventory_age_and_orphans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("12345")
    (tmp_path / "a" / "y.csv").write_text("1")
    files = listing(spark, str(tmp_path))
    assert rows(inventory(files, F.lit("uploads"))) == [("uploads", 2, 6, 0.0)]
    assert stale(files, "2000-01-01 00:00:00", 7).count() == 0
    assert stale(files, "2100-01-01 00:00:00", 7).count() == 2
    named = spark.createDataFrame([("x.csv",), (None,), ("",)], "stored_filename string")
    assert rows(orphans(files, named).select("name")) == [("y.csv",)]


def test_zones(spark):
    assert parse_zone("UTC+5:30") == ("+05:30", "UTC+05:30")
    assert parse_zone("-0400") == ("-04:00", "UTC-04:00")
    assert parse_zone("utc-3") == ("-03:00", "UTC-03:00")
    assert parse_zone(None) == parse_zone("Nowhere/City") == ("+05:30", "IST")
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-31 20:00:00.5'), (NULL) t(d)")
    assert rows(df.select(iso_text(F.col("d")), readable_text(F.col("d"), "+01:00"))) == [
        ("2024-02-01T01:30:00.500000+05:30", "31 Jan 2024, 21:00:00 UTC+01:00"),
        ("", ""),
    ]


def test_addresses_and_json_lists(spark):
    df = spark.createDataFrame(
        [("a@x.org, B@x.org;\n a@X.ORG ;;", '["p", "", null, 3]'), (None, "nope"), ("", '{"a":1}'), ("q", None)],
        "raw string, js string",
    )
    got = rows(df.select(distinct_ignoring_case(split_addresses(F.col("raw"))), json_list(F.col("js"))))
    assert got == [(["a@x.org", "B@x.org"], ["p", "3"]), ([], []), ([], []), (["q"], [])]


MAILS = [
    (1, datetime(2024, 1, 1), "Hi", '["A@x.org","b@x.org"]', '["a@x.org"]', None, "ok", "p1"),
    (2, datetime(2024, 1, 3), None, '[" a@X.org "]', "broken", "[]", None, "p2"),
]


@pytest.fixture(scope="module")
def history(spark):
    base = spark.createDataFrame(
        MAILS,
        "id long, sent_at timestamp_ntz, subject string, to_addresses_json string, cc_addresses_json string, "
        "bcc_addresses_json string, status string, attachment_path string",
    )
    return base.selectExpr(
        "*", "1L AS dataset_id", "'d' AS dataset_name", "'s' AS sheet_name", "1 AS pivot_rows_count",
        "CAST(NULL AS INT) AS attached_records_count", "CAST(NULL AS STRING) AS error_message",
        "CAST(NULL AS STRING) AS attachment_filename",
    )


def test_mail_history(spark, history):
    files = spark.createDataFrame([("p1",)], "path string")
    got = rows(mail_history(history, files).select("id", "subject", "cc_addresses", "status", "has_attachment").orderBy("id"))
    assert got == [(1, "Hi", ["a@x.org"], "ok", True), (2, "", [], "failed", False)]
    assert rows(mail_history(history, limit=1).select("id")) == [(2,)]


def test_recipient_usage_is_mergeable(history):
    whole = recipient_usage(history)
    assert sorted((r["address"], r["recipient_type"], r["use_count"]) for r in whole.collect()) == [
        ("a@x.org", "cc", 1),
        ("a@x.org", "to", 2),
        ("b@x.org", "to", 1),
    ]
    parts = recipient_usage(history.where("id = 2"), recipient_usage(history.where("id = 1")))
    assert sorted(rows(parts.select(whole.columns))) == sorted(rows(whole))
    assert [r["address"] for r in recent_recipients(whole, "to").collect()] == ["a@x.org", "b@x.org"]


def test_logs(spark):
    logs = spark.createDataFrame(
        [
            (1, datetime(2024, 1, 1), "info", "upload", "File 100%", None),
            (2, datetime(2024, 1, 2), "error", "mail", "Failed", "smtp_x"),
            (3, datetime(2024, 1, 2), "error", "mail", "Other", None),
        ],
        "id int, timestamp timestamp_ntz, level string, category string, message string, details string",
    )
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search_logs(logs)) == [3, 2, 1]
    assert ids(search_logs(logs, query="SMTP_")) == [2]
    assert ids(search_logs(logs, query="100%")) == [1]
    assert ids(search_logs(logs, level="ERROR", category="mail", date_to="2024-01-02")) == [3, 2]
    assert ids(search_logs(logs, date_from="garbage", date_to="2024-01-01T12:00:00Z")) == [1]
    assert ids(keep_latest(logs, 1)) == [3]
    assert ids(retained(logs, "timestamp", "2024-01-08 00:00:00", 7)) == [2, 3]


def test_purge_removes_days_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = spark.range(240).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS timestamp", "'x' AS message")
    logs = logs.unionByName(spark.createDataFrame([(999, None, "undated")], "id bigint, timestamp timestamp_ntz, message string"))
    write_logs(logs, path)
    before = {p.name for p in (tmp_path / "logs" / "day=2024-01-09").iterdir()}
    want = sorted(rows(retained(logs, "timestamp", "2024-01-12 06:30:00", 7)))
    assert purge_logs(spark, path, "2024-01-12 06:30:00", 7) == {"removed": 5, "rewritten": 1}
    assert sorted(rows(read_logs(spark, path).select("id", "timestamp", "message"))) == want
    assert {p.name for p in (tmp_path / "logs" / "day=2024-01-09").iterdir()} == before
    plan = boundary_day(spark, path, "day=2024-01-05")
    assert {f.rsplit("/", 2)[1] for f in plan.inputFiles()} == {"day=2024-01-05"}
    # Nothing more to do, and an appended day stays.
    assert purge_logs(spark, path, "2024-01-12 06:30:00", 7)["removed"] == 0
    write_logs(logs.where("id = 0"), path)
    assert read_logs(spark, path).count() == len(want) + 1


def test_purge_broken_off_is_completed(spark, tmp_path):
    path = tmp_path / "logs"
    logs = spark.range(48).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS timestamp")
    write_logs(logs, str(path))
    (path / "_purge").mkdir()
    # Staged and removed, but not yet put in place.
    logs.where("id BETWEEN 20 AND 23").write.parquet(str(path / "_purge" / "day=2024-01-01"))
    shutil.rmtree(path / "day=2024-01-01")
    # Staged in part only.
    (path / "_purge" / "day=2024-01-02").mkdir()
    assert sorted(r.id for r in read_logs(spark, str(path)).collect()) == list(range(20, 48))
    assert not list((path / "_purge").iterdir())


def test_trim_keeps_the_newest(spark, tmp_path):
    logs = spark.range(100).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT) DIV 3) AS timestamp")
    logs = logs.unionByName(spark.createDataFrame([(500, None), (501, None)], "id bigint, timestamp timestamp_ntz"))
    for limit in (0, 1, 5, 7, 60, 100, 101, 200):
        path = str(tmp_path / f"l{limit}")
        write_logs(logs, path)
        trim_logs(spark, path, limit)
        left = sorted(rows(read_logs(spark, path)), key=str) if limit else []
        assert left == sorted(rows(keep_latest(logs, limit)), key=str), limit


def test_usage_store_merges_a_batch_once(spark, tmp_path):
    mails = spark.createDataFrame(
        [(i, datetime(2024, 1, 1 + i % 20), f'["u{i % 9}@x.org", "V{i % 4}@x.org "]', "[]", None) for i in range(60)],
        "id int, sent_at timestamp_ntz, to_addresses_json string, cc_addresses_json string, bcc_addresses_json string",
    )
    store = UsageStore(spark, str(tmp_path / "u"), buckets=8)
    assert rows(store.usage()) == []
    assert store.merge("a", mails.where("id < 30")) and not store.merge("a", mails.where("id < 30"))
    first = store.versions()
    lone = mails.where("id = 30").withColumn("to_addresses_json", F.lit('["u0@x.org"]'))
    assert store.merge("lone", lone) and store.merge("none", mails.where("false")) and not store.merge("none", mails)
    changed = [b for b, v in store.versions().items() if v != first.get(b)]
    assert len(changed) == 1
    # A merge that was broken off: state written, ledger not.
    broken = UsageStore(spark, str(tmp_path / "u"), buckets=8)
    kept = broken._ledger().collect()
    assert store.merge("b", mails.where("id > 30"))
    shutil.rmtree(tmp_path / "u" / "ledger")
    spark.createDataFrame(kept, broken._ledger().schema).write.parquet(str(tmp_path / "u" / "ledger"))
    assert broken.versions() != {} and broken.merge("b", mails.where("id > 30"))
    want = recipient_usage(mails.where("id <> 30").unionByName(lone))
    assert sorted(rows(broken.usage())) == sorted(rows(want))
    assert broken.vacuum() > 0 and broken.vacuum() == 0
    assert sorted(rows(broken.usage())) == sorted(rows(want))
