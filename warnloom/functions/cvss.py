"""CVSS records: reading vulnerability JSON and banding scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bind

RECORD = "struct<score: double, severity: string, vector: string, version: string>"
ENRICHED = (
    "array<struct<id: string, score: double, severity: string, vector: string, version: string>>"
)

# Metric lists of a vulnerability record in order of preference.
METRIC_LISTS = ["cvssMetricV31", "cvssMetricV30", "cvssMetricV40", "cvssMetricV2"]
_ENTRY = "array<struct<cvssData: struct<baseScore: double, baseSeverity: string, vectorString: string>>>"
_METRICS = "struct<" + ", ".join(f"{name}: {_ENTRY}" for name in METRIC_LISTS) + ">"
NVD_SCHEMA = f"struct<metrics: {_METRICS}, vulnerabilities: array<struct<cve: struct<metrics: {_METRICS}>>>>"

# Lower bounds of the score bands.
BANDS = [(9, "critical"), (7, "high"), (4, "medium")]
LOWEST_BAND, NO_SCORE = "low", "n/a"


def parse_metrics(json: Column) -> Column:
    """Struct (score, severity, vector, version) of the preferred non-empty metric list, or null.

    Accepts a bare record or the API answer that wraps it.
    """
    def preferred(metrics: Column) -> Column:
        record = F.lit(None).cast(RECORD)
        for name in reversed(METRIC_LISTS):
            data = F.get(metrics[name], F.lit(0))["cvssData"]
            record = F.when(
                F.size(metrics[name]) > 0,
                F.struct(
                    data["baseScore"].alias("score"),
                    F.nullif(F.upper(data["baseSeverity"]), F.lit("")).alias("severity"),
                    data["vectorString"].alias("vector"),
                    F.lit(name.replace("cvssMetricV", "v")).alias("version"),
                ),
            ).otherwise(record)
        return record

    metrics = bind(
        F.from_json(json, NVD_SCHEMA),
        lambda p: F.coalesce(F.get(p["vulnerabilities"], F.lit(0))["cve"]["metrics"], p["metrics"]),
    )
    return bind(metrics, preferred)


def band(score: Column) -> Column:
    result = F.when(score.isNull(), NO_SCORE)
    for bound, name in BANDS:
        result = result.when(score >= bound, name)
    return result.otherwise(LOWEST_BAND)
