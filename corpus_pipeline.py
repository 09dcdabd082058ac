"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept and is written and read
again in between.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexflow.llm.exact_dedup import without_copies
from vertexflow.llm.mixing import mix_sources
from vertexflow.llm.near_dedup import near_duplicates
from vertexflow.llm.packing import pack_documents
from vertexflow.llm.quality import score_quality
from vertexflow.llm.queries import quality_model, word_count
from vertexflow.llm.text import fresh
from vertexflow.storage import discard, materialize

#: The classifier, copies and packing follow no SQL; tests/llm compares the run with a plain one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.5 or more)."""
    score, predicted = fresh(docs, "score", "predicted")
    scored = score_quality(docs, quality_model(docs, sf_dir), names=(score, predicted))
    return scored.where(F.col(predicted) == 1).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice."""
    tokens, weight, copies = fresh(docs, "tokens", "weight", "copies")
    mixed = mix_sources(docs.withColumn(tokens, word_count()), tokens, repetition_limit=2.0, names=(weight, copies))
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
