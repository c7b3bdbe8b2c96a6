"""Roll-ups over analysed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import ioc_total
from .rows import element_rows, newest_first


def dashboard_scope(reports: DataFrame, newest: int | None = 200) -> DataFrame:
    """The newest reports by time and id, or all of them with `newest=None`."""
    if newest is None:
        return reports
    return reports.orderBy(*newest_first(reports)).limit(newest)


def severity_distribution(reports: DataFrame) -> DataFrame:
    return reports.groupBy("severity").agg(F.count(F.lit(1)).alias("n_reports"))


def threat_type_distribution(reports: DataFrame) -> DataFrame:
    return reports.groupBy("threat_type").agg(F.count(F.lit(1)).alias("n_reports"))


def dashboard_kpis(reports: DataFrame) -> DataFrame:
    """One row: reports, critical, total_iocs, techniques_seen.

    Each report appears once for each of its techniques, and once where it has none; what counts
    reports looks at position 0 only, so one pass serves all four figures.
    """
    rows = reports.select(
        "severity",
        ioc_total(F.col("iocs")).alias("n_iocs"),
        F.posexplode_outer(F.transform("techniques", lambda t: F.struct(t["id"], t["name"]))).alias(
            "pos", "technique"
        ),
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return rows.agg(
        F.count_if(first).alias("reports"),
        F.count_if(first & (F.col("severity") == "Critical")).alias("critical"),
        F.coalesce(F.sum(F.when(first, F.col("n_iocs"))), F.lit(0)).alias("total_iocs"),
        F.count_distinct("technique").alias("techniques_seen"),
    )


def top_techniques(reports: DataFrame, n: int = 10) -> DataFrame:
    """Techniques by number of reports, by id on ties: technique, n_reports."""
    return (
        element_rows(reports, [], F.transform("techniques", lambda t: F.struct(t["id"], t["name"])), "t", None)
        .groupBy(F.concat_ws(" ", "t.id", "t.name").alias("technique"))
        .agg(F.count(F.lit(1)).alias("n_reports"))
        .orderBy(F.desc("n_reports"), "technique")
        .limit(n)
    )


def report_kpis(reports: DataFrame) -> DataFrame:
    """Per report: type, severity, indicators of all labels, techniques."""
    return reports.select(
        "report_id",
        "threat_type",
        "severity",
        ioc_total(F.col("iocs")).alias("indicators"),
        F.size("techniques").alias("techniques"),
    )
