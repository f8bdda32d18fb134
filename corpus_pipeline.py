"""A corpus pipeline: quality, near-duplicates, decontamination, mixing and sharding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read
again as the next stage's documents. All stages but the last return the columns of documents.

Every stage takes empty tables, rows whose id or text is null or repeated, and columns of any name;
what becomes of such rows stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemark.llm import decontaminate, jaccard, kneser_ney, mixing, sharding
from wavemark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose perplexity is within their language's quantile, and what ties with
    it. Texts that are null, empty or of white space go; equal rows share their verdict; rows without
    id are judged like any other."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 over five-word shingles connect: that of the
    smallest id, then of the smallest checksum of text, one row of it. Rows without id or without a
    word are in no group and stay."""
    return jaccard.keep_one(docs, jaccard.JaccardConfig(width=5, least=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item; a text that is null or empty holds none, and
    equal rows share their verdict."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks, whole copies first; a document
    without words is not taken, and of documents that tie the smaller ids go first."""
    return mixing.resampled(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot along the Hilbert curve; null texts count as empty, null ids sort first,
    and equal rows take neighbouring slots."""
    return sharding.with_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The language model's perplexities are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
