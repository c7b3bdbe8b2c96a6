"""The report table: saving, listing, fetching, deleting, JSON and Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import IOC_LABELS
from ..operators.joins import BROADCAST_ROWS, is_small
from ..operators.rows import newest_first

RESULT_TYPE = (
    "struct<filename: string, word_count: int, threat_type: string,"
    " threat_type_scores: map<string, int>, severity: string, severity_reasons: array<string>,"
    " summary: string, iocs: struct<"
    + ", ".join(f"{label}: array<string>" for label in IOC_LABELS)
    + ">, cves_enriched: array<struct<id: string, score: double, severity: string,"
    " vector: string, version: string>>, entities: struct<malware: array<string>,"
    " products: array<string>, organizations: array<string>, locations: array<string>>,"
    " techniques: array<struct<id: string, name: string, tactic: string, keywords: array<string>,"
    " matched_keywords: array<string>, hits: int>>, timeline: array<struct<date: string,"
    " event: string>>, recommended_actions: array<string>, text_excerpt: string>"
)
RESULT_FIELDS = [
    "filename", "word_count", "threat_type", "threat_type_scores", "severity",
    "severity_reasons", "summary", "iocs", "cves_enriched", "entities", "techniques", "timeline",
    "recommended_actions", "text_excerpt",
]


def save_reports(df: DataFrame, path: str) -> DataFrame:
    """Append analysed reports and return the table. Reports that have no `created_at` yet get the current
    second; others keep theirs. Ids are the source's own; numbering rows would force a global order."""
    stamped = _stamped(df)
    stamped.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(stamped.schema).parquet(path)


def write_version(df: DataFrame, path: str) -> DataFrame:
    """Write reports, such as those a deletion leaves, as a table of its own at a new path, and return it.
    Times of creation are kept. A path that exists is an error, so no table is overwritten while read."""
    stamped = _stamped(df)
    stamped.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(stamped.schema).parquet(path)


def _stamped(df: DataFrame) -> DataFrame:
    now = F.date_trunc("second", F.current_timestamp())
    return df.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in df.columns else now)


def list_reports(reports: DataFrame, limit: int | None = 50) -> DataFrame:
    """Newest reports first, without the heavy columns; all of them with `limit=None`."""
    listed = reports.select("report_id", "filename", "threat_type", "severity", "created_at").orderBy(*newest_first(reports))
    return listed if limit is None else listed.limit(limit)


def _join_ids(reports: DataFrame, ids: DataFrame | Iterable[int], how: str) -> DataFrame:
    """Join with distinct ids. A list counted to be small is broadcast, so the wide rows stay put."""
    if not isinstance(ids, DataFrame):
        ids = reports.sparkSession.createDataFrame([(i,) for i in ids], "report_id BIGINT")
    ids = ids.select("report_id").distinct()
    return reports.join(F.broadcast(ids) if is_small(ids, BROADCAST_ROWS) else ids, "report_id", how)


def get_reports_by_id(reports: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """The reports with these ids; ids without a report give no row."""
    return _join_ids(reports, ids, "left_semi")


def delete_reports(reports: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """The reports without these ids, to be written as a new version of the table (never over the
    path being read). Unknown ids change nothing."""
    return _join_ids(reports, ids, "left_anti")


def result_to_json(reports: DataFrame) -> DataFrame:
    """Add `result_json`, the whole result as JSON text with null fields kept."""
    fields = [f for f in RESULT_FIELDS if f in reports.columns]
    return reports.withColumn(
        "result_json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    )


def result_from_json(df: DataFrame, json: str = "result_json") -> DataFrame:
    """Restore the result columns from JSON text: report_id and the result fields."""
    return df.select("report_id", F.from_json(json, RESULT_TYPE).alias("r")).select("report_id", "r.*")


def _lines(items: Column, line, nothing: str | None = None) -> Column:
    """One line for each item, or a placeholder line."""
    lines = F.transform(items, line)
    if nothing is None:
        return lines
    return F.when(F.size(items) > 0, lines).otherwise(F.array(F.lit(nothing)))


def markdown() -> Column:
    """A report as Markdown text."""

    def vulnerability(c):
        scored = F.concat(
            F.lit(" — CVSS "), c["score"].cast("string"), F.lit(" ("),
            F.coalesce(c["severity"], F.lit("None")), F.lit(")"),
        )
        return F.concat(F.lit("- "), c["id"], F.when(c["score"].isNotNull(), scored).otherwise(""))

    vulnerabilities = F.when(
        F.size("cves_enriched") > 0, _lines(F.col("cves_enriched"), vulnerability)
    ).otherwise(
        _lines(F.col("iocs.cves"), lambda c: F.concat(F.lit("- "), c), "- None found")
    )
    indicators = [
        F.when(
            F.size(F.col("iocs")[label]) > 0,
            F.concat(
                F.array(F.lit(f"### {label}")),
                _lines(F.col("iocs")[label], lambda v: F.concat(F.lit("- `"), v, F.lit("`"))),
            ),
        ).otherwise(F.array().cast("array<string>"))
        for label in IOC_LABELS
    ]
    head = F.array(
        F.concat(F.lit("# THREAT REPORT — "), "filename"),
        F.lit(""),
        F.concat(F.lit("**Threat Type:** "), "threat_type"),
        F.concat(F.lit("**Severity:** "), "severity"),
        F.lit(""),
        F.lit("## Summary"),
        F.col("summary"),
        F.lit(""),
        F.lit("## Vulnerabilities"),
    )
    sections = [
        head,
        vulnerabilities,
        F.array(F.lit(""), F.lit("## Affected Products")),
        _lines(F.col("entities.products"), lambda p: F.concat(F.lit("- "), p), "- None identified"),
        F.array(F.lit(""), F.lit("## Attack Techniques (MITRE ATT&CK)")),
        _lines(
            F.col("techniques"),
            lambda t: F.concat(
                F.lit("- "), t["id"], F.lit(" — "), t["name"], F.lit(" ("), t["tactic"], F.lit(")")
            ),
            "- None mapped",
        ),
        F.array(F.lit(""), F.lit("## Indicators of Compromise")),
        *indicators,
        F.array(F.lit(""), F.lit("## Recommended Actions")),
        F.transform(
            "recommended_actions",
            lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a),
        ),
    ]
    return F.array_join(F.concat(*sections), "\n")


def render_markdown(reports: DataFrame) -> DataFrame:
    """report_id, filename, markdown."""
    return reports.select("report_id", "filename", markdown().alias("markdown"))


def write_markdown(reports: DataFrame, path: str) -> None:
    """One row of a Parquet table for each report; file names as `<stem>_report.md`."""
    render_markdown(reports).withColumn(
        "filename", F.concat(F.regexp_replace("filename", r"\.[^.]*\z", ""), F.lit("_report.md"))
    ).write.mode("append").parquet(path)
