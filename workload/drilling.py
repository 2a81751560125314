"""Drill-down, soft deletion, exports, flags and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotlake import PivotSpec, Rule, Totals, pivot
from pivotlake.functions.formats import dash_missing, date_text, number_text
from pivotlake.functions.names import q
from pivotlake.functions.rowkeys import row_key
from pivotlake.operators.drill import drilldown, drilldown_many, selections_of
from pivotlake.operators.flags import compare_flag, duplicate_flag, extreme_flag
from pivotlake.operators.tombstones import (
    AUDIT_SCHEMA,
    TOMBSTONE_SCHEMA,
    audit_search,
    begin_delete,
    delete_preview,
    exclude_deleted,
    key_columns_of,
    plan_delete,
    purge_dataset,
    read_audits,
    read_tombstones,
    soft_delete,
    write_tombstones,
)
from pivotlake.operators.view import collapse, export_frame, having, quick_search, selected_groups, tab_separated
from pivotlake.session import materialise, new_folder
from pivotlake.sources.sinks import extract_frame
from workload.catalogs import catalog
from workload.registry import query
from workload.tables import SALES_COLUMNS_SQL, SALES_SQL, SALESN_SQL, plain, sales, salesn, table

_SPEC = PivotSpec(
    rows=["Region", "OrderDate"],
    columns=["Status"],
    values=["Amount"],
    filters={"Status": ["F", "O"]},
    date_grouping={"OrderDate": "month"},
)

# Drill-down ------------------------------------------------------------------------------


@query(
    "drilldown",
    f"""WITH {SALES_SQL}, hit AS (SELECT * FROM sales WHERE "Status" IN ('F', 'O') AND "Region" = 'ASIA'
          AND strftime("OrderDate", '%Y-%m') = '1996-03')
        SELECT {SALES_COLUMNS_SQL}, (SELECT count(*) FROM hit) AS matched_rows
        FROM hit ORDER BY "OrderID" LIMIT 500""",
)
def drill(spark, sf_dir):
    found = drilldown(
        sales(spark, sf_dir), _SPEC, {"Region": "ASIA", "OrderDate_month": "1996-03"}, order_by=["OrderID"]
    )
    return plain(found.rows.withColumn("matched_rows", found.matched.scalar()))


# The second selection repeats, the third overlaps the first, the last is the blank group.
_SELECTIONS = (
    {"Region": "ASIA", "OrderDate_month": "1996-03"},
    {"Region": "EUROPE", "OrderDate_month": "1997-05"},
    {"Region": "EUROPE", "OrderDate_month": "1997-05"},
    {"Region": "ASIA"},
    {"Region": "(blank)", "OrderDate_month": "1998-01"},
)
_MATCHES = f"""matches AS (
  SELECT *, CASE WHEN "Region" = 'ASIA' AND m = '1996-03' THEN 1 ELSE 0 END
          + CASE WHEN "Region" = 'EUROPE' AND m = '1997-05' THEN 2 ELSE 0 END
          + CASE WHEN "Region" = 'ASIA' THEN 1 ELSE 0 END
          + CASE WHEN "Region" IS NULL AND m = '1998-01' THEN 1 ELSE 0 END AS hits
  FROM (SELECT *, strftime("OrderDate", '%Y-%m') AS m FROM salesn) WHERE "Status" IN ('F', 'O'))"""


@query(
    "drilldown_multi",
    f"""WITH {SALESN_SQL}, {_MATCHES}
        SELECT {SALES_COLUMNS_SQL}, (SELECT CAST(sum(hits) AS BIGINT) FROM matches) AS matched_rows
        FROM matches WHERE hits > 0""",
)
def drill_many(spark, sf_dir):
    found = drilldown_many(salesn(spark, sf_dir), _SPEC, _SELECTIONS)
    return plain(found.rows.withColumn("matched_rows", found.matched.scalar()))


@query(
    "drilldown_from_rows",
    f"""WITH {SALESN_SQL}, big AS (
          SELECT coalesce("Region", '(blank)') AS r, strftime("OrderDate", '%Y-%m') AS m FROM salesn
          WHERE "Status" IN ('F', 'O') GROUP BY 1, 2 HAVING coalesce(sum("Amount") FILTER (WHERE "Status" = 'F'), 0) > 1000000)
        SELECT {SALES_COLUMNS_SQL} FROM salesn WHERE "Status" IN ('F', 'O')
          AND (coalesce("Region", '(blank)'), strftime("OrderDate", '%Y-%m')) IN (SELECT (r, m) FROM big)""",
)
def drill_from_rows(spark, sf_dir):
    """Every pivot row above a bound is a selection; the selections stay a DataFrame."""
    df = salesn(spark, sf_dir)
    rows = having(pivot(df, _SPEC, ordered=False).rows, {"Amount | F": {"from": 1000000.01}})
    return plain(drilldown_many(df, _SPEC, selections_of(rows, _SPEC)).rows)


@query(
    "extract_rows",
    f"""WITH {SALESN_SQL}, {_MATCHES}
        SELECT "OrderID", "Region", "Nation", "Segment", strftime("OrderDate", '%Y-%m-%dT%H:%M:%S') AS "OrderDate",
               "Status", "Priority", CAST("Amount" AS DOUBLE) AS "Amount" FROM matches WHERE hits > 0""",
)
def extract(spark, sf_dir):
    """The extract written as Parquet to the shared folder and read back."""
    path = new_folder(spark, "extract")
    found = drilldown_many(salesn(spark, sf_dir), _SPEC, _SELECTIONS)
    extract_frame(found.rows).write.parquet(path)
    return plain(spark.read.parquet(path))


# Every order with a text that was typed for its customer: a number, one with a fraction, a
# word, a number with an empty fraction, and a number between blanks.
_TYPED_SQL = """typed AS (
  SELECT c_custkey, c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD', 'MACHINERY') AS fits FROM customer WHERE c_acctbal > 0),
gaps AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderstatus FROM orders)"""


def _gaps(spark, sf_dir):
    """Orders with missing customers and dates."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        "o_orderstatus",
    )


def _typed(spark, sf_dir):
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    text = (
        F.when(segment == "BUILDING", F.concat(key, F.lit(".5")))
        .when(segment == "FURNITURE", F.lit("abc"))
        .when(segment == "HOUSEHOLD", F.concat(key, F.lit(".0")))
        .when(segment == "MACHINERY", F.concat(F.lit(" "), key, F.lit(" ")))
        .otherwise(key)
    )
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(text.alias("o_custkey"))


@query(
    "drilldown_frame_misfit",
    f"""WITH {_TYPED_SQL} SELECT o_orderkey, o_custkey, o_orderstatus FROM gaps
        WHERE o_custkey IN (SELECT c_custkey FROM typed WHERE fits)""",
)
def drill_misfit(spark, sf_dir):
    """Texts that are no customer key select nothing, least of all the missing keys."""
    df = _gaps(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus")
    return drilldown_many(df, PivotSpec(rows=["o_custkey"]), _typed(spark, sf_dir)).rows


@query(
    "soft_delete_frame_misfit",
    f"""WITH {_TYPED_SQL}, chosen AS (
          SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderstatus WHEN 'O' THEN ' or so' ELSE '' END AS day FROM orders)
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderstatus FROM gaps
        WHERE o_orderdate IS NULL OR strftime(o_orderdate, '%Y-%m-%d') NOT IN (SELECT day FROM chosen)
           OR strftime(o_orderdate, '%H:%M:%S') <> '00:00:00'""",
)
def delete_misfit(spark, sf_dir):
    """Rows left after a delete by texts of days, some of which are no days."""
    df = _gaps(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    typed = F.when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" or so"))).otherwise(day)
    chosen = table(spark, sf_dir, "orders").select(typed.alias("o_orderdate"))
    dead = _as_tombstones(plan_delete(df, PivotSpec(rows=["o_orderdate"]), chosen, _no_tombstones(spark), 1, "Sheet1").rows)
    return plain(exclude_deleted(df, dead, 1, "Sheet1"))


# Soft deletion -----------------------------------------------------------------------------

_KEY = ("OrderID", "Region", "Status")
_KEY_SQL = """sha256('{"OrderID":' || "OrderID" || ',"Region":' || coalesce('"' || "Region" || '"', 'null')
              || ',"Status":"' || "Status" || '"}')"""


@query(
    "row_key",
    f"""WITH {SALESN_SQL} SELECT "OrderID", sha256(concat('{{"OrderDate":"', strftime("OrderDate", '%Y-%m-%dT%H:%M:%S.%f'),
          '","OrderID":', "OrderID", ',"Priority":"', "Priority", '","Region":',
          coalesce('"' || "Region" || '"', 'null'), '}}')) AS source_key FROM salesn""",
)
def row_keys(spark, sf_dir):
    df = salesn(spark, sf_dir)
    return df.select("OrderID", row_key(df, ["Region", "OrderID", "OrderDate", "Priority"]).alias("source_key"))


def _no_tombstones(spark):
    return spark.createDataFrame([], TOMBSTONE_SCHEMA)


def _as_tombstones(rows):
    """A stored tombstone table: computed once, then read."""
    return materialise(rows.withColumns({"dataset_id": F.lit(1).cast("bigint"), "sheet_name": F.lit("Sheet1")}))


@query(
    "soft_delete_plan",
    f"""WITH {SALESN_SQL}, {_MATCHES} SELECT {_KEY_SQL} AS source_key FROM matches
        WHERE hits > 0 AND NOT ("Region" = 'ASIA' AND m = '1996-03' AND "Region" IS NOT NULL)
        GROUP BY 1""",
)
def delete_plan(spark, sf_dir):
    """Rows deleted before, those of the first selection, are not planned again."""
    df = salesn(spark, sf_dir)
    before = _as_tombstones(plan_delete(df, _SPEC, _SELECTIONS[:1], _no_tombstones(spark), 1, "Sheet1", _KEY).rows)
    return plan_delete(df, _SPEC, _SELECTIONS, before, 1, "Sheet1", _KEY).rows.select("source_key")


@query(
    "soft_delete_apply",
    f"""WITH {SALESN_SQL}, {_MATCHES}
        SELECT {SALES_COLUMNS_SQL} FROM salesn
        WHERE "OrderID" NOT IN (SELECT "OrderID" FROM matches WHERE hits > 0)""",
)
def delete_apply(spark, sf_dir):
    """The sheet after the deletion; keys cover all columns of the row."""
    df = salesn(spark, sf_dir)
    dead = _as_tombstones(plan_delete(df, _SPEC, _SELECTIONS, _no_tombstones(spark), 1, "Sheet1").rows)
    return plain(exclude_deleted(df, dead, 1, "Sheet1"))


@query(
    "soft_delete_copies",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM (
         SELECT *, l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R' AS dead FROM lineitem) x
       WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_shipdate < TIMESTAMP '1996-01-01'
         AND d.l_quantity = x.l_quantity AND d.l_linenumber = x.l_linenumber AND d.l_returnflag = x.l_returnflag
         AND d.l_linestatus = x.l_linestatus)
       GROUP BY 1, 2""",
)
def delete_copies(spark, sf_dir):
    """Lines reduced to four columns are full of copies: all copies go together."""
    lines = table(spark, sf_dir, "lineitem")
    narrow = ("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    doomed = lines.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    keys = _as_tombstones(doomed.select(*key_columns_of(lines, narrow)).distinct())
    left = exclude_deleted(lines.select(*narrow), keys, 1, "Sheet1", narrow)
    return left.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "delete_preview",
    f"""WITH {SALESN_SQL}, {_MATCHES} SELECT CAST(sum(hits) AS BIGINT) AS matched,
          CASE WHEN sum(hits) > 2000 THEN 'HUGE' WHEN sum(hits) > 500 THEN 'LARGE' ELSE '' END AS tag FROM matches""",
)
def dry_run(spark, sf_dir):
    return delete_preview(salesn(spark, sf_dir), _SPEC, _SELECTIONS)


@query(
    "delete_audit",
    f"""WITH {SALESN_SQL}, {_MATCHES}
        SELECT 'sales' AS dataset_name, CAST(5 AS BIGINT) AS pivot_rows_count, 'success' AS status,
               CAST(sum(hits) AS BIGINT) AS source_records_found,
               CAST(count(*) FILTER (WHERE hits > 0) AS BIGINT) AS source_records_deleted FROM matches
        UNION ALL SELECT 'sales', CAST(1 AS BIGINT), 'success', count(*) FILTER (WHERE "Region" = 'ASIA'), 0 FROM matches""",
)
def audit_of_deletes(spark, sf_dir):
    """A delete and a second one that finds its rows deleted before, with their audits."""
    folder = new_folder(spark, "audit")
    df = salesn(spark, sf_dir)
    where = {
        "dataset_id": 1,
        "dataset_name": "sales",
        "sheet_name": "Sheet1",
        "tombstone_path": f"{folder}/tombstones",
        "audit_path": f"{folder}/audits",
    }
    soft_delete(df, _SPEC, _SELECTIONS, **where)
    soft_delete(df, _SPEC, _SELECTIONS[3:4], **where)
    return read_audits(spark, where["audit_path"]).select(
        "dataset_name", "pivot_rows_count", "status", "source_records_found", "source_records_deleted"
    )


@query(
    "delete_interrupted",
    f"""WITH {SALESN_SQL}, {_MATCHES}, n AS (
          SELECT count(*) AS every, count(*) FILTER (WHERE hits > 0) AS hit, (SELECT count(*) FROM salesn) AS sheet FROM matches)
        SELECT 'broken off' AS step, sheet AS rows_left, CAST(0 AS BIGINT) AS in_force, hit AS written, 'pending' AS status FROM n UNION ALL
        SELECT 'second run', sheet - hit, hit, hit, 'success' FROM n UNION ALL
        SELECT 'third run', sheet - hit, hit, hit, 'success,success' FROM n""",
)
def interrupted_delete(spark, sf_dir):
    """A delete broken off after its tombstones were written, run again and once more."""
    folder = new_folder(spark, "interrupted")
    df = salesn(spark, sf_dir)
    paths = {"tombstone_path": f"{folder}/tombstones", "audit_path": f"{folder}/audits"}
    where = {"dataset_id": 1, "dataset_name": "sales", "sheet_name": "Sheet1", **paths}

    def seen(step):
        dead = read_tombstones(spark, **paths, dataset_id=1, sheet_name="Sheet1")
        left, written = exclude_deleted(df, dead, 1, "Sheet1").count(), spark.read.parquet(paths["tombstone_path"]).count()
        ended = sorted(r.status for r in read_audits(spark, paths["audit_path"]).select("status").collect())
        return (step, left, dead.count(), written, ",".join(ended))

    write_tombstones(df, _SPEC, _SELECTIONS, begin_delete(spark, _SPEC, _SELECTIONS, **where))
    steps = [seen("broken off")]
    for step in ("second run", "third run"):
        soft_delete(df, _SPEC, _SELECTIONS, **where)
        steps.append(seen(step))
    return spark.createDataFrame(steps, "step string, rows_left bigint, in_force bigint, written bigint, status string")


@query(
    "dataset_purge",
    f"""WITH {SALESN_SQL}, {_MATCHES}
        SELECT 'datasets' AS kept, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'sheets', 3 UNION ALL
        SELECT 'columns', CAST(23 AS BIGINT) UNION ALL SELECT 'deleted_datasets', 1 UNION ALL
        SELECT 'tombstones', (SELECT count(*) FROM matches WHERE hits > 0) UNION ALL SELECT 'audits', 0""",
)
def purge(spark, sf_dir):
    """Purging one of four datasets keeps the rows of the others."""
    datasets, sheets, columns = catalog(spark, sf_dir, ("orders", "customer", "lineitem", "events"))
    df = salesn(spark, sf_dir)
    dead = materialise(plan_delete(df, _SPEC, _SELECTIONS, _no_tombstones(spark), 1, "Sheet1").rows)
    of = lambda i: dead.withColumn("dataset_id", F.lit(i).cast("bigint"))
    left = purge_dataset(
        {
            "datasets": datasets.withColumn("upload_time", F.lit("2024-01-01").cast("timestamp_ntz")),
            "sheets": sheets,
            "columns": columns,
            "tombstones": of(1).unionByName(of(2)),
            "audits": spark.createDataFrame([], AUDIT_SCHEMA),
            "deleted_datasets": spark.createDataFrame([], "original_id bigint"),
        },
        2,
    )
    out = None
    for name, frame in left.items():
        n = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "audit_search",
    """WITH audits AS (SELECT event_id AS id, ts, event_type AS dataset_name,
           '[{"user":' || user_id || '}]' AS selection_criteria,
           CASE WHEN value > 10 THEN 'success' ELSE 'failed' END AS status FROM events)
       SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", dataset_name, status FROM audits
       WHERE (contains(lower(dataset_name), 'purch') OR contains(lower(selection_criteria), 'purch'))
         AND status = 'success' ORDER BY ts DESC, id DESC LIMIT 100""",
)
def search_audits(spark, sf_dir):
    audits = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.lit(1).cast("bigint").alias("dataset_id"),
        F.col("event_type").alias("dataset_name"),
        F.concat(F.lit('[{"user":'), F.col("user_id").cast("string"), F.lit("}]")).alias("selection_criteria"),
        F.when(F.col("value") > 10, "success").otherwise("failed").alias("status"),
    )
    found = audit_search(audits, query="PURCH", status="success", dataset_id=1)
    return plain(found.select("id", "timestamp", "dataset_name", "status"))


# Views -------------------------------------------------------------------------------------

_NATION_STATUS = PivotSpec(rows=["Nation", "Segment"], columns=["Status"], values=["Amount"])
_WIDE = f"""wide AS (SELECT "Nation", "Segment",
  {", ".join(f'''coalesce(sum("Amount") FILTER (WHERE "Status" = '{s}'), 0) AS "Amount | {s}"''' for s in "FOP")},
  sum("Amount") AS row_total FROM sales GROUP BY 1, 2)"""
_WIDE_DOUBLES = ", ".join(
    f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in ("Amount | F", "Amount | O", "Amount | P", "row_total")
)


@query(
    "having_filter",
    f"""WITH {SALES_SQL}, {_WIDE} SELECT "Nation", "Segment", {_WIDE_DOUBLES} FROM wide
        WHERE "Amount | F" >= 1000000 AND regexp_matches("Segment", 'build', 'i')""",
)
def having_filter(spark, sf_dir):
    rows = pivot(sales(spark, sf_dir), _NATION_STATUS).rows
    return plain(having(rows, {"Amount | F": {"from": 1000000}, "Segment": {"contains": "build"}}))


@query(
    "quick_search",
    f"""WITH {SALES_SQL}, {_WIDE} SELECT "Nation", "Segment", {_WIDE_DOUBLES} FROM wide
        WHERE contains(lower("Nation"), 'nation_1') AND contains(lower("Segment"), 'mach')""",
)
def search(spark, sf_dir):
    rows = pivot(sales(spark, sf_dir), _NATION_STATUS).rows
    return plain(quick_search(rows, " MACH nation_1 ", ["Nation", "Segment"]))


@query(
    "collapse_groups",
    f"""WITH {SALES_SQL} SELECT "Region", "Status", count("OrderID") AS "count_OrderID", 'leaf' AS row_kind,
          1 AS level, "Region" AS parent_key FROM sales WHERE "Region" <> 'ASIA' GROUP BY 1, 2
        UNION ALL SELECT "Region", '', count("OrderID"), 'subtotal', 0, '' FROM sales GROUP BY 1""",
)
def collapsed(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region", "Status"],
        values=[{"field": "OrderID", "aggregation": "count"}],
        totals=Totals(subtotals=True),
    )
    return collapse(pivot(sales(spark, sf_dir), spec, markers=True).rows, ["ASIA"])


@query(
    "export_view",
    f"""WITH {SALES_SQL}, {_WIDE}, shown AS (SELECT * FROM wide WHERE "Segment" = 'BUILDING')
        SELECT 0 AS line, "Nation", {", ".join(
          f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in ("Amount | F", "Amount | O", "row_total"))} FROM shown
        UNION ALL SELECT 1, '', '', '', CAST(sum(row_total) AS VARCHAR) FROM shown""",
)
def export(spark, sf_dir):
    """Two columns are hidden; the grand line only sums the shown row totals."""
    result = pivot(sales(spark, sf_dir), _NATION_STATUS)
    shown = having(result.rows, {"Segment": "BUILDING"})
    return export_frame(shown, result.grand, result.columns, hidden=["Segment", "Amount | P"])


@query(
    "tsv_rows",
    """SELECT concat(conv_id, chr(9), turn, chr(9), role, chr(9),
         regexp_replace(regexp_replace(text, chr(9), ' ', 'g'), '\r?\n', ' ', 'g')) AS line FROM conversations""",
)
def tsv(spark, sf_dir):
    return tab_separated(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"])


@query(
    "selection_groups",
    f"""WITH {SALESN_SQL} SELECT count(*) AS groups FROM (
          SELECT DISTINCT "Region" FROM salesn WHERE "Status" = 'O')""",
)
def groups_selected(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "Status"], values=["Amount"])
    rows = pivot(salesn(spark, sf_dir), spec).rows
    return selected_groups(having(rows, {"Status": "O"}), "Region")


# Flags and formats -----------------------------------------------------------------------------

_BY_DAY = f"""WITH {SALES_SQL}, d AS (
  SELECT strftime("OrderDate", '%Y-%m-%d') AS "OrderDate_day", "Region", sum("Amount") AS s, count(*) AS n
  FROM sales GROUP BY 1, 2), leaf AS (
  SELECT "OrderDate_day", "Region", CAST(s AS DOUBLE) AS "sum_Amount", n AS "count_OrderID" FROM d)"""


def _days(spark, sf_dir):
    spec = PivotSpec(
        rows=["OrderDate", "Region"],
        values=["Amount", {"field": "OrderID", "aggregation": "count"}],
        date_grouping={"OrderDate": "day"},
    )
    return plain(pivot(sales(spark, sf_dir), spec, ordered=False, reuse=True).rows)


def _extreme(name, field, top):
    order, op = ("DESC", ">=") if top else ("ASC", "<=")

    @query(
        name,
        f"""{_BY_DAY}, edge AS (SELECT "{field}" AS v FROM leaf ORDER BY 1 {order}
              LIMIT 1 OFFSET (SELECT greatest(1, CAST(ceil(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT)) - 1 FROM leaf))
            SELECT *, "{field}" {op} (SELECT v FROM edge) AS flagged FROM leaf""",
    )
    def run(spark, sf_dir):
        return extreme_flag(_days(spark, sf_dir), field, "flagged", top=top)


_extreme("cf_top10", "sum_Amount", True)
_extreme("cf_bottom10", "sum_Amount", False)
_extreme("cf_top10_ties", "count_OrderID", True)


@query(
    "cf_duplicates",
    f"""{_BY_DAY} SELECT *, count(*) OVER (PARTITION BY CAST("count_OrderID" AS VARCHAR)) > 1 AS flagged FROM leaf""",
)
def duplicates(spark, sf_dir):
    return duplicate_flag(_days(spark, sf_dir), "count_OrderID", "flagged")


def _compare(name, rule, sql):
    @query(name, f"{_BY_DAY} SELECT *, {sql} AS flagged FROM leaf")
    def run(spark, sf_dir):
        df = _days(spark, sf_dir)
        return df.withColumn("flagged", compare_flag(df, rule))


_compare("cf_gt", Rule("sum_Amount", "gt", 500000), '"sum_Amount" > 500000')
_compare("cf_lt", Rule("sum_Amount", "lt", "100000"), '"sum_Amount" < 100000')
_compare("cf_eq", Rule("count_OrderID", "eq", 2), "CAST(\"count_OrderID\" AS VARCHAR) = '2'")


@query(
    "fmt_number",
    f"""WITH {SALESN_SQL} SELECT "OrderID",
          coalesce(format('{{:,}}', CAST(round("Amount", 0) AS BIGINT)), '—') AS as_integer,
          coalesce(format('{{:,.2f}}', CAST("Amount" AS DOUBLE)), '—') AS as_decimal,
          coalesce('$' || format('{{:,.2f}}', CAST("Amount" AS DOUBLE)), '—') AS as_currency,
          coalesce(format('{{:,}}', "OrderID" * 100) || '%', '—') AS as_percentage,
          coalesce(format('{{:,}}', "OrderID"), '—') AS as_thousands FROM salesn""",
)
def numbers(spark, sf_dir):
    df = salesn(spark, sf_dir)
    kind = lambda c: df.schema[c].dataType
    text = lambda c, fmt: number_text(q(c), kind(c), fmt).alias(f"as_{fmt}")
    return df.select(
        "OrderID",
        text("Amount", "integer"),
        text("Amount", "decimal"),
        text("Amount", "currency"),
        text("OrderID", "percentage"),
        text("OrderID", "thousands"),
    )


@query(
    "fmt_share",
    """SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_discount AS DECIMAL(18,2)) * 100, 0) AS BIGINT) || '%' AS discount,
         CASE WHEN l_tax > 0 THEN CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) ELSE '—' END AS tax FROM lineitem""",
)
def shares(spark, sf_dir):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax").cast("decimal(18,2)")).alias("tax")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", tax)
    return df.select(
        "l_orderkey",
        "l_linenumber",
        number_text(F.col("l_discount"), df.schema["l_discount"].dataType, "percentage").alias("discount"),
        dash_missing(F.col("tax"), df.schema["tax"].dataType).alias("tax"),
    )


_DATE_FORMATS = {
    "yyyy-mm-dd": "strftime(d, '%Y-%m-%d')",
    "dd-mm-yyyy": "strftime(d, '%d-%m-%Y')",
    "MMM yyyy": "strftime(d, '%b %Y')",
    "MMMM yyyy": "strftime(d, '%B %Y')",
    "quarter": "strftime(d, '%Y') || '-Q' || quarter(d)",
    "year": "strftime(d, '%Y')",
}


@query(
    "fmt_date",
    f"""SELECT o_orderkey, {", ".join(f"coalesce({s}, '—') AS \"{f}\"" for f, s in _DATE_FORMATS.items())}
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)""",
)
def dates(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return df.select(
        "o_orderkey", *[date_text(F.col("d"), df.schema["d"].dataType, f).alias(f) for f in _DATE_FORMATS]
    )
