"""The corpus pipeline: quality rules, near-dedup, PII, mixing, packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import Workspace
from factloom.llm.mixing import mixed_documents
from factloom.llm.near_dedup import drop_near_duplicates
from factloom.llm.packing import pack
from factloom.llm.pii import mask_pii
from factloom.llm.quality_rules import filter_quality

TOKENIZER = os.path.join(os.path.dirname(public_tokenizers.path("byte_bpe_50k.json")), "byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents within the fences of their language and source."""
    return filter_quality(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return drop_near_duplicates(spark, docs, width=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return mask_pii(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix; a document comes once for each round that takes words of it, with those words."""
    return mixed_documents(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences, a row per piece."""
    return pack(spark, docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing and similarity by sketches are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is removed once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        ws = Workspace(spark, "pipeline")
        docs = ws.keep(stage(spark, docs, sf_dir))
        if last:
            last.forget()
        last = ws
    return docs
