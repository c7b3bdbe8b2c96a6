"""Dashboard figures kept up to date: partial sums for each batch of reports, added up when read.

A batch's sums are rows of (kind, key, n) in a folder of their own, at most one for each severity, threat type and technique. A batch that
runs again overwrites its folder, so nothing counts twice. Reports that are deleted are taken back by a batch of
negative sums. Reading adds up the folders: it never looks at a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indicators import ioc_total
from .rows import struct_rows

SCHEMA = "kind STRING, key STRING, n BIGINT"


def partial_sums(reports: DataFrame, sign: int = 1) -> DataFrame:
    """kind, key, n of analysed reports, each added (or with -1 taken back) once."""
    fact = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    one = F.lit(1)
    facts = F.concat(
        F.array(
            fact("total", F.lit("reports"), one),
            fact("total", F.lit("indicators"), ioc_total(F.col("iocs"))),
            fact("severity", F.col("severity"), one),
            fact("threat_type", F.col("threat_type"), one),
        ),
        F.transform("techniques", lambda t: fact("technique", F.concat_ws(" ", t["id"], t["name"]), one)),
    )
    return struct_rows(reports, [], facts).groupBy("kind", "key").agg((F.sum("n") * sign).alias("n"))


def write_sums(reports: DataFrame, path: str, batch: int, sign: int = 1) -> None:
    """Write the sums of a batch to its folder, over what is there from an earlier try."""
    partial_sums(reports, sign).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, n over all batches, without what has gone again."""
    sums = spark.read.schema(f"{SCHEMA}, batch BIGINT").parquet(path)
    return sums.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0")


def severity_distribution(sums: DataFrame) -> DataFrame:
    return sums.filter("kind = 'severity'").select(F.col("key").alias("severity"), F.col("n").alias("n_reports"))


def threat_type_distribution(sums: DataFrame) -> DataFrame:
    return sums.filter("kind = 'threat_type'").select(F.col("key").alias("threat_type"), F.col("n").alias("n_reports"))


def top_techniques(sums: DataFrame, n: int = 10) -> DataFrame:
    """Techniques by number of reports, by name on ties: technique, n_reports."""
    listed = sums.filter("kind = 'technique'").select(F.col("key").alias("technique"), F.col("n").alias("n_reports"))
    return listed.orderBy(F.desc("n_reports"), "technique").limit(n)


def dashboard_kpis(sums: DataFrame) -> DataFrame:
    """One row: reports, critical, total_iocs, techniques_seen."""
    total = lambda kind, key: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("key") == key), F.col("n"))), F.lit(0).cast("long"))
    return sums.agg(
        total("total", "reports").alias("reports"),
        total("severity", "Critical").alias("critical"),
        total("total", "indicators").alias("total_iocs"),
        F.count_if(F.col("kind") == "technique").alias("techniques_seen"),
    )
