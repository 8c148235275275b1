"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, digest, langid, licenses, neardup, pii, sharding, token_files, transducer
from weftgraph.llm.common import scratch_path, text_or_empty


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    token_files.write_token_files(_documents(spark, sf_dir), tokenizer_path(), out, end_id=2)
    return token_files.token_digest(spark, out)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_documents(spark, sf_dir), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict_languages(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(_documents(spark, sf_dir), tokenizer_path(), limit=1024)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_components(_documents(spark, sf_dir), percent=75)


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    digest = docs.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    out = sharding.hypergeometric_shards(digest, keys=["doc_id", "text_crc32", "size"], shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_digest(pii.pii_spans(_documents(spark, sf_dir)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.document_fingerprints(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_hypergeometric_sharding": op8_hypergeometric_sharding,
    "op9_pii": op9_pii,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {}
