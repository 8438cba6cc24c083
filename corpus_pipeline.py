"""A corpus pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame; every stage works on all that the one before kept.

1. quality: documents that the classifier scores below 0.7 go. Held-out rows of the classifier's query are held out here too.
2. lines: repeated lines go from every document's text, wherever their first occurrence stands; a document of whose lines none
   is left goes; empty lines count as none. Documents without any line but empty ones stay as they are.
3. near_duplicates: of the documents linked by a Jaccard similarity of 0.8 or more, directly or through others, one stays: the
   one with the smallest id (of equal ids, the first row).
4. personal_data: mentions of personal data get keyed surrogates.
5. packing: all that is left is cut into sequences of at most 2048 tokens.

All stages but the last return the columns of their input. Tables without rows give tables without rows.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm import jaccard, lines, packing, quality, surrogates
from lumenscan.llm.blocks import crc_mod, free_name, stored
from lumenscan.llm.queries import SURROGATE_KEY

LEAST = 0.7     # score from which a document counts as good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    name = free_name(docs, "_quality")
    return quality.with_score(docs, model, name=name).where(F.col(name) >= LEAST).drop(name)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # empty lines are never removed: a document that lost lines and has only empty ones left has lost all that it says
    kept = lines.dedup_lines(docs, tau=lines.TAU).where((F.col("n_removed") == 0) | (F.replace("text", F.lit("\n"), F.lit("")) != ""))
    return _as_documents(kept, docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs).select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(surrogates.with_surrogates(docs, SURROGATE_KEY), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near_duplicates", near_duplicates_stage), ("personal_data", personal_data_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
