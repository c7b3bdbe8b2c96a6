"""Threat type, severity, actions and techniques. Input: report_id and normalised text; severity
also needs `iocs`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions.core import literal_array
from ..functions.lexicons import (
    ACTIONS,
    CRITICAL_ACTION,
    IOC_LABELS,
    SEVERITY_KEYWORDS,
    TECHNIQUES,
    THREAT_KEYWORDS,
    UNKNOWN_THREAT,
)
from .rows import element_rows, struct_rows


def with_keywords(df: DataFrame) -> DataFrame:
    """Add `found_keywords`, the lexicon terms present in the text; every rule reads this column."""
    return df.withColumn("found_keywords", K.keywords_in(F.col("text")))


def _found(df: DataFrame) -> DataFrame:
    return df if "found_keywords" in df.columns else with_keywords(df)


def threat_type_scores(df: DataFrame) -> DataFrame:
    """Score of every type for every report, zeros included: report_id, label, ord, score."""
    scores = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(i).alias("ord"),
                F.size(K.hits(F.col("found_keywords"), words)).alias("score"),
            )
            for i, (label, words) in enumerate(THREAT_KEYWORDS.items())
        ]
    )
    return struct_rows(_found(df), "report_id", scores)


def classify_threat_type(df: DataFrame) -> DataFrame:
    """Add `threat_type_scores` and `threat_type`."""
    scored = _found(df).withColumn("threat_type_scores", K.threat_type_scores(F.col("found_keywords")))
    return scored.withColumn("threat_type", K.threat_type(F.col("threat_type_scores")))


def matched_keywords(df: DataFrame) -> DataFrame:
    """Which keyword triggered what: report_id, rule (threat, severity, technique), label, pos, keyword."""
    groups = [
        *(("threat", label, words) for label, words in THREAT_KEYWORDS.items()),
        *(("severity", label, words) for label, words in SEVERITY_KEYWORDS.items()),
        *(("technique", tid, words) for tid, _, _, words in TECHNIQUES),
    ]
    rules = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(label).alias("label"),
                K.hits(F.col("found_keywords"), words).alias("words"),
            )
            for rule, label, words in groups
        ]
    )
    by_rule = struct_rows(_found(df), "report_id", rules)
    return element_rows(by_rule, ["report_id", "rule", "label"], "words", "keyword")


def severity_counts(iocs: Column) -> tuple[Column, Column]:
    """(CVEs, indicators of every label but domains): the two counts severity looks at."""
    sizes = [F.size(iocs[label]) for label in IOC_LABELS if label != "domains"]
    return F.size(iocs["cves"]), sum(sizes[1:], sizes[0])


def severity_keyword_tier(df: DataFrame) -> DataFrame:
    """Strongest keyword tier alone: report_id, severity, reason (null for Low)."""
    tiered = _found(df).withColumn("tier", K.severity_tier(F.col("found_keywords")))
    return tiered.select(
        "report_id",
        K.severity_name(F.col("tier.level")).alias("severity"),
        K.tier_reason(F.col("tier")).alias("reason"),
    )


def severity_cve_signal(df: DataFrame) -> DataFrame:
    """Reports that reference CVEs: report_id, n_cves, reason."""
    n_cves, _ = severity_counts(F.col("iocs"))
    return df.select("report_id", n_cves.alias("n_cves")).filter("n_cves > 0").withColumn(
        "reason", K.cve_reason(F.col("n_cves"))
    )


def severity_ioc_signal(df: DataFrame) -> DataFrame:
    """Reports with five or more indicators, domains not counted: report_id, n_iocs, reason."""
    _, n_iocs = severity_counts(F.col("iocs"))
    return df.select("report_id", n_iocs.alias("n_iocs")).filter("n_iocs >= 5").withColumn(
        "reason", K.ioc_reason(F.col("n_iocs"))
    )


def classify_severity(df: DataFrame) -> DataFrame:
    """Add `severity` and `severity_reasons`."""
    n_cves, n_iocs = severity_counts(F.col("iocs"))
    counted = _found(df).withColumns(
        {"_tier": K.severity_tier(F.col("found_keywords")), "_cves": n_cves, "_iocs": n_iocs}
    )
    signals = F.col("_tier"), F.col("_cves"), F.col("_iocs")
    return counted.withColumns(
        {
            "severity": K.severity_name(K.severity_level(*signals)),
            "severity_reasons": K.severity_reasons(*signals),
        }
    ).drop("_tier", "_cves", "_iocs")


def recommend_actions(df: DataFrame) -> DataFrame:
    """Add `recommended_actions` from `threat_type` and `severity`. The action table is a constant of
    nine rows, so it is a lookup in a map literal."""
    pairs = [x for label, texts in ACTIONS.items() for x in (F.lit(label), literal_array(texts))]
    listed = F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.col("threat_type")),
        literal_array(ACTIONS[UNKNOWN_THREAT]),
    )
    return df.withColumn(
        "recommended_actions",
        F.when(F.col("severity") == "Critical", F.concat(F.array(F.lit(CRITICAL_ACTION)), listed))
        .otherwise(listed),
    )


def map_techniques(df: DataFrame) -> DataFrame:
    """Add `techniques`, matched ATT&CK techniques with the most keyword hits first."""
    return _found(df).withColumn("techniques", K.techniques(F.col("found_keywords")))


def technique_hits(df: DataFrame) -> DataFrame:
    """One row for each matched technique: report_id, pos, technique_id, name, tactic,
    matched_keywords, hits."""
    return (
        struct_rows(map_techniques(df), "report_id", "techniques", pos="pos")
        .withColumnRenamed("id", "technique_id")
        .drop("keywords")
    )
