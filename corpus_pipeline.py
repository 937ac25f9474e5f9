"""Training-corpus pipeline: each stage is one operator of ``donorlens.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes every stage's result as Parquet below the
shared checkpoint folder and gives it to the next stage. All stages but the
last return the columns of ``documents``; the last returns the packed pieces.

Nulls in any column, empty and very long texts, repeated rows, an empty table and
further columns are handled by each stage's operator as its docstring says: no
stage fails on them, and a row without id or text is a row like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from donorlens.llm import mixing, packing, simhash, surrogates, toxicity
from donorlens.llm.common import documents, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression-distance classifier calls toxic."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, that of the smallest id."""
    return simhash.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return surrogates.pseudonymised_documents(docs, surrogates.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every source to its target: a row appears as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", near_duplicates),
    ("pii surrogates", pseudonymise),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL has no SimHash, no zstandard and no tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
