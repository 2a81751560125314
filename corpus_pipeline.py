"""The training-data pipeline over ``documents``.

Each stage takes what its predecessor kept, as a Parquet table; all but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pivotlake.llm import decontaminate, mixing, near_duplicates, token_ids, toxicity
from pivotlake.llm.tables import stored_by_few, table

# The tokenizer is a program of its own, which SQL cannot express.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model learnt from those given."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no twentieth of benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix as token ids: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.read_documents(token_ids.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored_by_few(stage(spark, docs, sf_dir), name)
    return docs
