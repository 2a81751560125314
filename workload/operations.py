"""Logs, mail, addresses, the directory and time zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotlake.functions.zones import iso_text, readable_text
from pivotlake.operators.directory import directory_counts, search_directory, starter_list
from pivotlake.operators.logs import keep_latest, purge_logs, read_logs, retained, search_logs, trim_logs, write_logs
from pivotlake.operators.mail import UsageStore, clean_addresses, mail_history, recent_recipients, recipient_usage, search_mail
from pivotlake.session import new_folder
from pivotlake.sources.directory import load_directory
from pivotlake.sources.files import file_name, listing
from workload.registry import query
from workload.tables import DIRECTORY_SQL, LOGS_SQL, MAIL_SQL, directory, list_export, logs, mails, plain, table, user_export

_LOG_COLUMNS = "id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS \"timestamp\", level, category, message, details"


@query(
    "log_search",
    f"""WITH {LOGS_SQL} SELECT {_LOG_COLUMNS} FROM logs
        WHERE (contains(lower(message), 'error 1') OR contains(lower(details), 'error 1')) AND level = 'error'
          AND "timestamp" >= TIMESTAMP '2024-01-02' AND "timestamp" <= TIMESTAMP '2030-01-01 12:30:00'
        ORDER BY logs."timestamp" DESC, id DESC LIMIT 500""",
)
def find_logs(spark, sf_dir):
    found = search_logs(
        logs(spark, sf_dir), query="Error 1", level="ERROR", date_from="2024-01-02", date_to="2030-01-01T12:30:00"
    )
    return plain(found)


@query(
    "log_retention",
    f"""WITH {LOGS_SQL} SELECT {_LOG_COLUMNS} FROM logs WHERE "timestamp" > TIMESTAMP '2024-01-05 06:00:00'""",
)
def keep_recent(spark, sf_dir):
    return plain(retained(logs(spark, sf_dir), "timestamp", "2024-01-12 06:00:00", 7))


@query(
    "log_keep_latest",
    f"""WITH {LOGS_SQL} SELECT {_LOG_COLUMNS} FROM logs ORDER BY logs."timestamp" DESC, id DESC LIMIT 5000""",
)
def newest_logs(spark, sf_dir):
    return plain(keep_latest(logs(spark, sf_dir)))


@query(
    "log_purge",
    f"""WITH {LOGS_SQL} SELECT {_LOG_COLUMNS} FROM logs WHERE "timestamp" > TIMESTAMP '2024-01-05 06:00:00'""",
)
def purged(spark, sf_dir):
    """The table left on disk: days removed whole, one day rewritten."""
    path = new_folder(spark, "logs")
    write_logs(logs(spark, sf_dir), path)
    purge_logs(spark, path, "2024-01-12 06:00:00", 7)
    return plain(read_logs(spark, path))


@query(
    "log_trim",
    f"""WITH {LOGS_SQL} SELECT {_LOG_COLUMNS} FROM logs ORDER BY logs."timestamp" DESC, id DESC LIMIT 5000""",
)
def trimmed(spark, sf_dir):
    """The newest rows left on disk."""
    path = new_folder(spark, "logs")
    write_logs(logs(spark, sf_dir), path)
    trim_logs(spark, path)
    return plain(read_logs(spark, path))


@query(
    "tz_format",
    """SELECT event_id,
         strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE strftime(ts, '.%f') END || '+05:30' AS iso_default,
         strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %H:%M:%S') || ' IST' AS readable_default,
         strftime(ts - INTERVAL 240 MINUTE, '%d %b %Y, %H:%M:%S') || ' UTC-04:00' AS readable_offset,
         strftime(ts, '%d %b %Y, %H:%M:%S') || ' UTC' AS readable_utc FROM events""",
)
def zoned(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        iso_text(ts).alias("iso_default"),
        readable_text(ts, "Mars/Olympus").alias("readable_default"),
        readable_text(ts, "UTC-4:00").alias("readable_offset"),
        readable_text(ts, "UTC").alias("readable_utc"),
    )


# Mail ----------------------------------------------------------------------------------------


@query(
    "mail_history",
    f"""WITH {MAIL_SQL} SELECT id, strftime(sent_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S+05:30') AS sent_at_local,
          subject, replace(replace(replace(to_addresses_json, '["', ''), '"]', ''), '","', ';') AS recipients,
          CASE WHEN dataset_name = 'P' THEN 'boss@example.com' ELSE '' END AS copies, status,
          attachment_path = 'orders.parquet' AS has_attachment
        FROM mails ORDER BY sent_at DESC, id DESC LIMIT 100""",
)
def history(spark, sf_dir):
    files = listing(spark, sf_dir, "*.parquet").select(file_name(F.col("path")).alias("path"))
    shown = mail_history(mails(spark, sf_dir), files)
    return shown.select(
        "id",
        "sent_at_local",
        "subject",
        F.array_join("to_addresses", ";").alias("recipients"),
        F.array_join("cc_addresses", ";").alias("copies"),
        "status",
        "has_attachment",
    )


@query(
    "mail_search",
    f"""WITH {MAIL_SQL}, newest AS (SELECT * FROM mails)
        SELECT id, subject, status FROM newest WHERE status = 'success'
          AND (contains(lower(subject), 'low') OR contains(lower(to_addresses_json), 'low') OR contains(lower(dataset_name), 'low'))""",
)
def find_mail(spark, sf_dir):
    return search_mail(mails(spark, sf_dir), "LOW", "success").select("id", "subject", "status")


_USAGE = f"""{MAIL_SQL}, uses AS (
  SELECT 'c' || o_custkey || '@example.com' AS address, 'to' AS recipient_type, o_orderdate AS sent_at FROM orders
  UNION ALL SELECT 'c' || (o_custkey % 10) || '@example.com', 'to', o_orderdate FROM orders
  UNION ALL SELECT 'boss@example.com', 'cc', o_orderdate FROM orders WHERE o_orderstatus = 'P'),
usage AS (SELECT address, recipient_type, max(sent_at) AS last_used_at, count(*) AS use_count FROM uses GROUP BY 1, 2)"""


@query(
    "recipient_usage_twice",
    f"""WITH {_USAGE} SELECT address, recipient_type, strftime(last_used_at, '%Y-%m-%d %H:%M:%S') AS last_used_at,
        use_count FROM usage""",
)
def usage_twice(spark, sf_dir):
    """Mails merged by status into a store on disk; every batch is sent twice."""
    store = UsageStore(spark, new_folder(spark, "usage"))
    all_mails = mails(spark, sf_dir)
    for _ in range(2):
        for status in ("success", "failed"):
            store.merge(status, all_mails.where(F.col("status") == status))
    return plain(store.usage())


@query(
    "recipient_usage",
    f"""WITH {_USAGE} SELECT address, recipient_type, strftime(last_used_at, '%Y-%m-%d %H:%M:%S') AS last_used_at,
        use_count FROM usage""",
)
def usage(spark, sf_dir):
    """The mails of 1995 to 1997 make the old state, the later ones are merged in."""
    all_mails = mails(spark, sf_dir)
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    old = recipient_usage(all_mails.where(F.col("sent_at") < split))
    return plain(recipient_usage(all_mails.where(F.col("sent_at") >= split), old))


@query(
    "recent_recipients",
    f"""WITH {_USAGE} SELECT address, recipient_type, strftime(last_used_at, '%Y-%m-%d %H:%M:%S') AS last_used_at,
        use_count FROM usage WHERE recipient_type = 'to' ORDER BY usage.last_used_at DESC, address LIMIT 50""",
)
def recent(spark, sf_dir):
    return plain(recent_recipients(recipient_usage(mails(spark, sf_dir)), "to"))


@query(
    "address_clean",
    """SELECT c_custkey,
         'a' || c_custkey || '@example.com' || CASE WHEN c_mktsegment = 'BUILDING' THEN ';not-an-address' ELSE '' END
           || CASE WHEN c_nationkey < 5 THEN '' ELSE ';b' || c_nationkey || '@example.com' END AS addresses,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'not-an-address' ELSE '' END AS invalid FROM customer""",
)
def addresses(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    first = F.concat(F.lit("a"), key, F.lit("@example.com"))
    raw = F.concat(
        F.lit("  "),
        first,
        F.lit(" ;\n, "),
        F.upper(first),
        F.when(F.col("c_mktsegment") == "BUILDING", ",not-an-address ").otherwise(""),
    )
    more = F.when(nation >= 5, F.concat(F.lit("b"), nation.cast("string"), F.lit("@example.com; "), F.upper(first)))
    clean, invalid = clean_addresses(raw, more)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(clean, ";").alias("addresses"), F.array_join(invalid, ";").alias("invalid")
    )


# Directory -------------------------------------------------------------------------------------


@query("directory_load", f"WITH {DIRECTORY_SQL} SELECT * FROM directory")
def load(spark, sf_dir):
    """Both exports written as CSV in line order, then loaded."""
    path = new_folder(spark, "directory")
    user_export(spark, sf_dir).orderBy("line").drop("line").write.option("header", True).option("quoteAll", True).csv(f"{path}/users")
    list_export(spark, sf_dir).orderBy("line").drop("line").write.option("header", True).option("quoteAll", True).csv(f"{path}/lists")
    return load_directory(spark, f"{path}/users", f"{path}/lists")


@query("directory_counts", f"WITH {DIRECTORY_SQL} SELECT kind, count(*) AS entries FROM directory GROUP BY 1")
def counts(spark, sf_dir):
    return directory_counts(directory(spark, sf_dir))


@query(
    "directory_search",
    f"""WITH {DIRECTORY_SQL}, hay AS (SELECT *, lower(concat_ws(' ', name, email, alias)) AS h FROM directory)
        SELECT email, name, alias, kind FROM hay WHERE contains(h, 'team1') AND contains(h, 'supp')
        ORDER BY CASE WHEN email = 'team1 supp' THEN 0 ELSE 1 END, CASE WHEN starts_with(lower(name), 'team1') THEN 0 ELSE 1 END,
          CASE WHEN starts_with(email, 'team1') THEN 0 ELSE 1 END, CASE kind WHEN 'user' THEN 0 ELSE 1 END, lower(name), email
        LIMIT 8""",
)
def look_up(spark, sf_dir):
    return search_directory(directory(spark, sf_dir), " Team1  SUPP ")


@query(
    "directory_starter",
    f"WITH {DIRECTORY_SQL} SELECT email, name, alias, kind FROM directory ORDER BY lower(name), kind, email LIMIT 8",
)
def starter(spark, sf_dir):
    return starter_list(directory(spark, sf_dir))
