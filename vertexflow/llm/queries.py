"""The thin corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_duplicates
from .language_model import score_texts
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .secrets import scan_secrets
from .token_counts import token_counts
from .url_filter import filter_urls
from .vector_search import nearest


def word_count() -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("n_tokens"))
    return mix_sources(docs, "n_tokens", repetition_limit=2.0).withColumn("weight", F.round("weight", 9))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


# The rules of the query's contract.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _crc(modulus: int):
    """The remainder that splits rows; null for a null id, whose row is held out everywhere."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def quality_model(docs: DataFrame, sf_dir: str):
    """A model from the labels that are not held out."""
    return fit_quality(docs, _table(docs.sparkSession, sf_dir, "labels").where(_crc(3) != 1))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), quality_model(docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_crc(3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), _crc(7) != 2)
    return scored.withColumn("held_out", ~F.col("training")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
