"""Corpus pipeline: quality filter, exact dedup, near-duplicate removal, packing.

``run`` applies the stages to ``documents``; each stage's result is written as Parquet in the
shared scratch folder and read again by the next, so a lost executor costs that stage's tasks
only.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.jaccard_join import keep_representatives
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import END_ID, QUALITY_CUT, TOKENIZER, WINDOW
from tidemark.llm.seq_pack import pack_documents
from tidemark.session import scratch_path
from tidemark.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_CUT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest doc_id stays."""
    return keep_representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left, one row per piece with its ids."""
    out = pack_documents(docs, public_tokenizers.path(TOKENIZER), WINDOW, END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "ids")


STAGES = [("quality_filter", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("packing", packing)]

# The classifier, the similarity classes and the packing cannot be written in SQL; the tests
# hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
