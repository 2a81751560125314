"""Registered queries of the package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pivotlake.llm import chat, decontaminate, infill, language, licenses, mixing, near_duplicates, neighbours, prefix_trie, sharding, substrings, token_ids, toxicity
from pivotlake.llm.tables import table, utf8

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    done = chat.formatted(given.unionByName(extra))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("mask")), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.mixed(documents, keep=("doc_id",)).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents, model).select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", "predicted")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_licenses"),
        F.array_join("found.license", ",").alias("licenses"),
        F.array_max("found.containment").alias("containment"),
        F.array_min("found.word").alias("first_word"),
    )


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identified(documents, language.fit(documents))
    return found.select("row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_ids.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.read_documents(shards)


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.prefixes(table(spark, sf_dir, "conversations"), family=20)).drop("code")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = infill.pieces(F.col("output"), F.col("form"))
    return done.select(
        "row.doc_id",
        "n",
        "form",
        F.length(cut["prefix"]).cast("bigint").alias("prefix_chars"),
        F.length(cut["middle"]).cast("bigint").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(utf8()).alias("text_crc32"))
    done = sharding.sharded(given, shards=40, keep=("doc_id", "text_crc32"))
    return done.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op6_chat_formatting"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
steps AS (
  SELECT *, CASE WHEN bool_or(contains(text, '\b') OR contains(text, '\h') OR contains(text, '\e') OR contains(text, '\c')) OVER w THEN 2
                 WHEN bool_or(contains(text, '### ') OR contains(text, '</turn>')) OVER w THEN 1 ELSE 0 END AS step
  FROM given WINDOW w AS (PARTITION BY conv_id)),
coded AS (
  SELECT *, CASE step WHEN 0 THEN text ELSE replace(replace(CASE step WHEN 2 THEN replace(text, '\', '\b') ELSE text END, '### ', '\h'), '</turn>', '\e') END AS code
  FROM steps)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || code || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
ORACLES["op7_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM per_source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per_source)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY cap / weight, source LIMIT 1),
targets AS (SELECT source, source_size, least(weight * level, cap) AS target FROM weighed, chosen),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
along AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.place, d.size) AS step
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN source_size > 0 AND rest > 0 AND (upto <= rest OR (upto - step < rest AND 2 * upto - step < 2 * rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM along
"""
ORACLES["op12_fill_in_middle"] = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS other,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (
  SELECT *, array_to_string(units[1:least(one, other)], '') AS p, array_to_string(units[least(one, other) + 1:greatest(one, other)], '') AS m,
         array_to_string(units[greatest(one, other) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
ORACLES["op11_prefix_trie"] = """
WITH given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations),
coded AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations)),
convs AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM coded),
rebuilt AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN given g ON g.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
  UNION ALL SELECT conv_id, place, role, text FROM convs JOIN given USING (conv_id) WHERE place > h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS node,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
marked AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM paths),
nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256
  FROM marked GROUP BY node),
linked AS (
  SELECT n.*, p.node AS parent, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.node = p.node),
born AS (SELECT parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT l.*, coalesce(b.n, 0) AS n_children FROM linked l LEFT JOIN born b ON b.parent = l.node),
sums AS (
  SELECT p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM full_nodes f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (node)
"""
