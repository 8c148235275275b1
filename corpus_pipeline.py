"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, whole texts judged however long, other columns as
they were whatever their names, null and empty texts as its docstring says; rows that repeat an id are judged each, but
near_duplicates keeps one of those with the same text. Empty tables give empty tables. run() writes each stage's rows to
the shared folder, reads them again for the next and removes what has been read. ORACLE_SQL is None: SQL cannot express these stages, so tests hold the
result against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, decontam, langid, neardup, pii
from weftgraph.llm.common import remove_path, written
from weftgraph.llm.queries import tokenizer_path

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language: null and empty texts and those without a letter go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; null texts and rows without id are in none."""
    return neardup.deduplicate(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data as marks; n_chars follows the new text."""
    return pii.redact_rows(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids_sha256 and decoded_sha256; columns of these names give way."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    return bpe.bpe_round_trip(docs, tokenizer_path(), keep=others)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if read:
            remove_path(spark, read)
        read = path
    return docs
