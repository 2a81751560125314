"""Search over the address directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pivotlake.functions.names import all_of
from pivotlake.functions.text import haystack

USER, LIST = "user", "distribution_list"

# Fixed value: suggestions of one look-up.
SUGGESTIONS = 8


def search_directory(entries: DataFrame, query: str, kind: str | None = None, limit: int = SUGGESTIONS) -> DataFrame:
    """Entries that contain every word of the query, best first: the exact address,
    then names starting with the first word, then addresses doing so, then users
    before lists, then by name. An empty query finds nothing."""
    text = (query or "").strip().lower()
    words = text.split()
    if not words:
        return entries.limit(0)
    pool = entries if kind is None else entries.where(F.col("kind") == kind)
    hay = haystack(F.col("name"), F.col("email"), F.col("alias"))
    exact = F.col("email") == text
    name = F.lower("name")
    order = [
        F.when(exact, 0).otherwise(1),
        F.when(exact | name.startswith(words[0]), 0).otherwise(1),
        F.when(exact | F.col("email").startswith(words[0]), 0).otherwise(1),
        F.when(F.col("kind") == USER, 0).otherwise(1),
        name,
        F.col("email"),
    ]
    return pool.where(all_of(F.instr(hay, w) > 0 for w in words)).orderBy(*order).limit(limit)


def starter_list(entries: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """The first entries by name, users and lists mixed."""
    return entries.orderBy(F.lower(F.coalesce(F.nullif("name", F.lit("")), "email")), "kind", "email").limit(limit)


def directory_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))
