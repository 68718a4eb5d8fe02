"""A corpus pipeline over documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import bpe, linededup, mixing, neardup, quality
from triage.llm.common import DOC_COLUMNS, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, DOC_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with the lines that stay in it; of a line and its near copies one stays in the corpus."""
    return linededup.dedup_lines(docs, DOC_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, DOC_COLUMNS, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time, in training order."""
    return mixing.training_order(docs, list(DOC_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digest of what they decode to, with its position in the training order.

    Stages hand on the columns of documents alone, so the order is that of the
    stored rows: a file's number, then the row's in it. Rows that come from no
    file stand as their partitions give them.
    """
    try:
        placed = docs.select(*DOC_COLUMNS, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        position = F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long") * F.lit(1 << 36) + F.col("__row")
    except AnalysisException:
        placed, position = docs, F.monotonically_increasing_id()
    return bpe.encode(placed, public_tokenizers.path("word_bpe_49k.json"), digest=True, position=F.coalesce(position, F.lit(0)))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Union-find over links, quantile sketches and BPE merges are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
