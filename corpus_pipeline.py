"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); its rows are written as Parquet to the shared folder and
read again as the next stage's documents. Rejected documents go, repeated lines are cut out of the texts, one
document of each group of near copies stays, documents that hold a benchmark item go, and what is left is
packed: the last stage returns a row for each piece of a document with its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warnloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from warnloom.llm.words import table
from warnloom.sources.staging import stage

# Packing depends on hashes; no SQL gives these rows. tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
