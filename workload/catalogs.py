"""Column profiles, the catalog, previews, CSV, files and saved definitions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pivotlake.plans.checks import check_definitions
from pivotlake.session import new_folder
from pivotlake.sources.catalog import catalog_nested, column_kind_counts, newest_first, register_tables
from pivotlake.sources.files import audit_files, inventory, listing, orphans, stale
from pivotlake.sources.profile import profile
from pivotlake.sources.sheets import land_csv, preview, read_csv
from workload.registry import query
from workload.tables import plain, table

# The columns of the given tables, in order.
_COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
_NAMES = tuple(_COLUMNS)


def catalog(spark, sf_dir, names=_NAMES):
    return register_tables({n: table(spark, sf_dir, n) for n in names})


# The catalog's word for a type of the SQL engine.
_KIND_SQL = """CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float'
  WHEN starts_with(column_type, 'TIMESTAMP') OR column_type = 'DATE' THEN 'datetime' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END"""


def _columns_sql():
    """The columns of all tables as the SQL engine itself describes them."""
    parts = []
    for i, (name, columns) in enumerate(_COLUMNS.items(), 1):
        nulls = ", ".join(f"count(*) <> count({c}) AS {c}" for c in columns)
        parts.append(
            f"SELECT {i} AS dataset_id, '{name}' AS tab, list_position({list(columns)}, column_name) - 1 AS position, column_name, "
            f"{_KIND_SQL} AS data_type, is_nullable FROM (DESCRIBE {name}) JOIN (UNPIVOT (SELECT {nulls} FROM {name}) "
            f"ON {', '.join(columns)} INTO NAME column_name VALUE is_nullable) USING (column_name)"
        )
    return " UNION ALL ".join(parts)


@query(
    "column_profile",
    """SELECT 0 AS position, 'key_text' AS column_name, 'integer' AS data_type, count(*) < 0 AS is_nullable FROM orders
       UNION ALL SELECT 1, 'date_text', 'datetime', count(*) < 0 FROM orders
       UNION ALL SELECT 2, 'price_text', 'float', count(*) < 0 FROM orders
       UNION ALL SELECT 3, 'is_open', 'boolean', count(*) < 0 FROM orders
       UNION ALL SELECT 4, 'flag', 'boolean', count(*) FILTER (WHERE o_orderstatus = 'P') > 0 FROM orders
       UNION ALL SELECT 5, 'nothing', 'string', count(*) > 0 FROM orders
       UNION ALL SELECT 6, 'mixed', 'string', count(*) < 0 FROM orders
       UNION ALL SELECT 7, 'o_orderdate', 'datetime', count(*) <> count(o_orderdate) FROM orders
       UNION ALL SELECT 8, 'o_totalprice', 'float', count(*) <> count(o_totalprice) FROM orders""",
)
def text_profile(spark, sf_dir):
    """Orders as text and as odd types, so that every step of the ladder is taken."""
    status = F.col("o_orderstatus")
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price_text"),
        F.when(status == "O", "Yes").otherwise("no").alias("is_open"),
        F.when(status == "O", 1.0).when(status == "F", 0.0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(status == "O", F.col("o_orderkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("mixed"),
        "o_orderdate",
        "o_totalprice",
    )
    return profile(df)


@query(
    "sheet_catalog",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS id, '{n}' AS filename, count(*) AS total_rows, {len(c)} AS total_columns FROM {n}"
        for i, (n, c) in enumerate(_COLUMNS.items(), 1)
    ),
)
def sheet_catalog(spark, sf_dir):
    datasets, _, _ = catalog(spark, sf_dir)
    dated = datasets.withColumn("upload_time", F.timestamp_add("DAY", "id", F.lit("2024-01-01").cast("timestamp_ntz")))
    return newest_first(dated).select("id", "filename", "total_rows", "total_columns")


@query(
    "catalog_nested",
    f"""SELECT CAST(dataset_id AS BIGINT) AS id, any_value(tab) AS filename,
          string_agg(column_name || ':' || data_type || CASE WHEN is_nullable THEN '?' ELSE '' END, ',' ORDER BY position)
            AS shown FROM ({_columns_sql()}) GROUP BY 1""",
)
def nested(spark, sf_dir):
    tree = catalog_nested(*catalog(spark, sf_dir))
    column = lambda c: F.concat(
        c["column_name"], F.lit(":"), c["data_type"], F.when(c["is_nullable"], "?").otherwise("")
    )
    return tree.select(
        "id", "filename", F.array_join(F.transform(F.col("sheets")[0]["columns"], column), ",").alias("shown")
    )


@query(
    "column_kind_counts",
    f"""SELECT CAST(dataset_id AS BIGINT) AS dataset_id, count(*) FILTER (WHERE data_type = 'datetime') AS date_columns,
          count(*) FILTER (WHERE data_type IN ('integer', 'float')) AS numeric_columns,
          count(*) FILTER (WHERE data_type = 'string') AS text_columns FROM ({_columns_sql()}) GROUP BY 1""",
)
def kind_counts(spark, sf_dir):
    _, _, columns = catalog(spark, sf_dir)
    return column_kind_counts(columns)


@query(
    "preview",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props
       FROM events ORDER BY event_id LIMIT 20""",
)
def first_rows(spark, sf_dir):
    return preview(table(spark, sf_dir, "events"), ["event_id"])


@query(
    "csv_scan_clean",
    """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, o_orderstatus = 'O' AS is_open FROM orders""",
)
def csv_scan(spark, sf_dir):
    """Orders written as CSV with missing-value words, read back with inferred types."""
    path = new_folder(spark, "sheet") + ".csv"
    status = F.col("o_orderstatus")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(status == "P", "N/A").otherwise(status).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(status == "O", "TRUE").otherwise("False").alias("is_open"),
    ).write.option("header", True).csv(path)
    return plain(read_csv(spark, path))


_MISFITS_SQL = """cells AS (
  SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN CAST(o_custkey AS VARCHAR) || 'e0' WHEN '1-URGENT' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust,
         CASE o_orderstatus WHEN 'P' THEN '1,234.5' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)"""


@query(
    "csv_rejects",
    f"""WITH {_MISFITS_SQL}, found AS (
          SELECT 'cust' AS "column", cust AS cell, contains(cust, 'e') AS bad FROM cells UNION ALL
          SELECT 'price', price, contains(price, ',') FROM cells UNION ALL SELECT 'day', day, day = 'soon' FROM cells)
        SELECT "column", CAST(count(*) FILTER (bad) AS BIGINT) AS rejected, min(cell) FILTER (bad) AS example,
               CAST((SELECT count(cust) FILTER (cust <> '' AND NOT contains(cust, 'e')) FROM cells) AS BIGINT) AS customers_left
        FROM found GROUP BY 1""",
)
def rejected_cells(spark, sf_dir):
    """Orders landed from CSV with declared types: how many cells of a column were refused."""
    path = new_folder(spark, "misfits")
    priority, status, cust = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(priority == "5-LOW", F.concat(cust, F.lit("e0"))).when(priority == "1-URGENT", "").otherwise(cust).alias("cust"),
        F.when(status == "P", "1,234.5").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when((status == "F") & (priority == "2-HIGH"), "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    ).write.option("header", True).csv(f"{path}/sheet.csv")
    landed = land_csv(spark, f"{path}/sheet.csv", f"{path}/landed", "o_orderkey bigint, cust bigint, price double, day date")
    left = landed.rows.agg(F.count("cust").alias("n")).scalar()
    counted = landed.rejects.groupBy("column").agg(F.sum("count").alias("rejected"), F.min("example").alias("example"))
    return counted.withColumn("customers_left", left)


@query(
    "csv_mixed_lines",
    """SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN replace(o_orderpriority, '-', '/"') ELSE o_orderpriority END AS words,
         CAST(o_totalprice AS DOUBLE) AS price FROM orders""",
)
def mixed_lines(spark, sf_dir):
    """A folder of files of which only those with pending orders hold cells of two lines."""
    path = new_folder(spark, "mixed") + ".csv"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "P", F.regexp_replace("o_orderpriority", "-", "\n\"")).otherwise(F.col("o_orderpriority")).alias("words"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_orderstatus") == "P").alias("pending"),
    )
    for pending in (False, True):
        part = rows.where(F.col("pending") == pending).drop("pending")
        part.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, "k bigint, words string, price double").withColumn("words", F.regexp_replace("words", "\n", "/"))


# Files ---------------------------------------------------------------------------------------


def _stored(spark, sf_dir, path):
    """Suppliers landed in one folder per region, and a file without any."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers.select("region", "s_suppkey", "s_name").write.partitionBy("region").option("header", True).csv(path)
    suppliers.where(F.lit(False)).select("s_name").coalesce(1).write.text(f"{path}/region=none")
    return F.regexp_extract("path", "region=([^/]+)/", 1)


_STORED_SQL = """stored AS (
  SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'none')"""


@query("storage_inventory", f"WITH {_STORED_SQL} SELECT region AS category, true AS some, region = 'none' AS empty FROM stored")
def storage(spark, sf_dir):
    """What a clean-up of files older than five days would find ten days from now."""
    path = new_folder(spark, "stored")
    region = _stored(spark, sf_dir, path)
    later = (datetime.now(timezone.utc) + timedelta(days=10)).replace(tzinfo=None)
    found = inventory(stale(listing(spark, path), later, 5), region)
    return found.select("category", (F.col("file_count") > 0).alias("some"), (F.col("total_bytes") == 0).alias("empty"))


@query("orphans", f"WITH {_STORED_SQL} SELECT region FROM stored WHERE region IN ('0', '2', 'none')")
def orphaned(spark, sf_dir):
    """Regions with files that no dataset names."""
    path = new_folder(spark, "stored")
    region = _stored(spark, sf_dir, path)
    # Files of one write share their names, so each is known by region and name.
    files = listing(spark, path).select(F.concat(region, F.lit("-"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    named = table(spark, sf_dir, "region").where(~F.col("r_regionkey").isin(0, 2)).select(F.col("r_regionkey").cast("string").alias("named"))
    of = F.substring_index("path", "-", 1)
    datasets = files.join(named, of == F.col("named")).select(F.col("path").alias("stored_filename"))
    return orphans(files, datasets).select(of.alias("region")).distinct()


@query(
    "file_audit",
    """WITH kinds AS (
         SELECT c_nationkey AS nation, CASE WHEN max(c_acctbal) > 9900 THEN '.txt' ELSE '.csv' END AS suffix,
                min(c_acctbal) < -900 AS odd FROM customer GROUP BY 1)
       SELECT CAST(nation AS VARCHAR) AS nation, suffix, CASE WHEN suffix = '.txt' THEN 'suffix' WHEN odd THEN 'null_bytes' ELSE 'ok' END AS verdict FROM kinds
       UNION ALL SELECT 'none', '.csv', CASE WHEN count(*) = 0 THEN 'not_text' ELSE 'ok' END FROM customer WHERE c_custkey IS NULL""",
)
def landed_files(spark, sf_dir):
    """Customers landed in files by nation, poorest first: names of customers deep in debt
    hold a NUL byte, nations with a rich customer are plain text; a file without rows."""
    path = new_folder(spark, "landed")
    customers = table(spark, sf_dir, "customer")
    rich = customers.groupBy(F.col("c_nationkey").alias("nation")).agg((F.max("c_acctbal") > 9900).alias("rich"))
    name = F.when(F.col("c_acctbal") < -900, F.concat(F.lit("a\x00"), F.col("c_name"))).otherwise(F.col("c_name"))
    named = customers.join(rich, F.col("c_nationkey") == F.col("nation")).select("nation", "rich", name.alias("c_name"), "c_acctbal")
    # One file a nation, so that its poorest customer is at its head.
    along = named.repartition("nation").sortWithinPartitions("nation", "c_acctbal")
    along.where("NOT rich").select("nation", "c_name").write.partitionBy("nation").option("header", True).csv(f"{path}/sheets")
    along.where("rich").select("nation", "c_name").write.partitionBy("nation").text(f"{path}/texts")
    customers.where("c_custkey IS NULL").select("c_name").coalesce(1).write.csv(f"{path}/nation=none")
    audited = audit_files(spark, path)
    return audited.select(F.regexp_extract("path", "/nation=([^/]+)/[^/]*$", 1).alias("nation"), "suffix", "verdict").distinct()


# Saved definitions -----------------------------------------------------------------------------


def _definitions(spark, sf_dir):
    """One saved definition per customer over the orders sheet; what is wrong with it
    depends on the market segment."""
    segment = F.col("c_mktsegment")
    good = '{"rows":["o_orderstatus"],"values":["o_totalprice"],"dateGrouping":{"o_orderdate":"month"}}'
    text_sum = '{"rows":["o_orderstatus","nowhere"],"values":[{"field":"o_orderpriority","aggregation":"sum"}],"layout":"wide"}'
    odd = (
        '{"columns":["o_orderstatus"],"filters":{"gone":1},"values":[{"field":"o_totalprice","aggregation":"Median"}],'
        '"sorting":{"o_orderkey":"up"},"dateGrouping":{"o_custkey":"hour"}}'
    )
    display = (
        '{"rows":["o_orderstatus"],"displayOptions":{"numberFormat":{"o_totalprice":"roman"},'
        '"conditionalFormats":[{"field":"o_totalprice","type":"gt"},{"type":"top10"}],"hiddenColumns":["x"]}}'
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("definition_id"),
        F.when(segment == "FURNITURE", 9).otherwise(1).cast("bigint").alias("dataset_id"),
        F.lit("Sheet1").alias("sheet_name"),
        F.when(segment == "AUTOMOBILE", text_sum)
        .when(segment == "BUILDING", odd)
        .when(segment == "HOUSEHOLD", display)
        .otherwise(good)
        .alias("definition"),
    )


_FINDINGS = (
    ("AUTOMOBILE", "error", "layout_unknown", None, "wide"),
    ("AUTOMOBILE", "error", "field_missing", "nowhere", "row"),
    ("AUTOMOBILE", "error", "aggregation_not_allowed", "o_orderpriority", "sum"),
    ("BUILDING", "error", "field_missing", "gone", "filter"),
    ("BUILDING", "error", "aggregation_unknown", "o_totalprice", "median"),
    ("BUILDING", "error", "direction_unknown", "o_orderkey", "up"),
    ("BUILDING", "error", "grain_unknown", "o_custkey", "hour"),
    ("BUILDING", "warning", "grain_on_other_type", "o_custkey", "hour"),
    ("HOUSEHOLD", "warning", "values_missing", None, None),
    ("HOUSEHOLD", "error", "format_unknown", "o_totalprice", "roman"),
    ("HOUSEHOLD", "error", "rule_value_missing", "o_totalprice", "gt"),
    ("HOUSEHOLD", "error", "rule_without_field", None, "top10"),
    ("HOUSEHOLD", "error", "field_missing", "x", "hidden"),
    ("FURNITURE", "error", "dataset_missing", None, "9"),
)


def _text(value):
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


@query(
    "definition_check",
    f"""WITH f(segment, severity, rule, field, detail) AS (VALUES {", ".join(
        "(" + ", ".join(_text(v) for v in row) + ")" for row in _FINDINGS)})
        SELECT c_custkey AS definition_id, CAST(CASE WHEN segment = 'FURNITURE' THEN 9 ELSE 1 END AS BIGINT) AS dataset_id,
               'Sheet1' AS sheet_name, severity, rule, field, detail
        FROM customer JOIN f ON c_mktsegment = segment
        UNION ALL SELECT c_custkey, 1, 'Sheet1', 'warning', 'rows_many', NULL, CAST(n AS VARCHAR)
        FROM customer, (SELECT count(*) AS n FROM orders) WHERE n > 100000 AND c_mktsegment <> 'FURNITURE'""",
)
def saved_definitions(spark, sf_dir):
    datasets, sheets, columns = catalog(spark, sf_dir, ("orders", "customer"))
    return check_definitions(_definitions(spark, sf_dir), datasets, sheets, columns)
