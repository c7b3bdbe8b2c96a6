"""The whole analysis of a table of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, cvss as C, entities, indicators, narrative, text
from ..operators.metrics import counted
from ..sources.reports import RESULT_FIELDS


def spread_input(df: DataFrame, key: str = "report_id") -> DataFrame:
    """Spread a small input over the cores: one file may arrive as a single partition while the
    analysis is bound by CPU. Inputs that already have a partition for each core are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def analyze_reports(
    df: DataFrame,
    cvss: DataFrame | None = None,
    cvss_lookup: bool = True,
    yearless_dates: bool = False,
    keep_text: bool = True,
    min_chars: int | None = None,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Analyse reports (report_id, filename, text): one row of nested results for each. Ids are unique.

    Every step is a projection of the row it reads, CVSS lookup included while the dimension is of
    checked size, so the plan has no shuffle: it runs as one stage over however many splits.
    `keep_text` keeps the normalised text beside the excerpt: the search for similar reports reads it.
    With `min_chars`, reports of fewer characters are left out, as on a stream;
    `text.split_min_length` gives the rejected ones. A `gazetteer` (name, bucket) fills organisations and
    locations, found in the row by an automaton.
    """
    out = text.normalise(df if min_chars is None else text.filter_min_length(df, min_chars))
    out = classify.with_keywords(indicators.extract_iocs(out))
    out = entities.extract_entities(out, gazetteer=gazetteer)
    out = classify.classify_severity(classify.classify_threat_type(out))
    out = classify.recommend_actions(classify.map_techniques(out))
    out = narrative.extract_timeline(narrative.summarize(out), yearless=yearless_dates)
    out = out.withColumns(
        {
            "word_count": T.word_count(F.col("text")),
            "text_excerpt": T.text_excerpt(F.col("text")),
        }
    )
    if cvss is None or not cvss_lookup:
        out = C.without_enrichment(out)
    else:
        # Last, when the text itself is no longer in the row.
        out = C.enrich_cves(out, cvss)
    kept = ["text"] if keep_text else []
    # The metric also keeps the optimizer from moving a caller's filter on a result column below the
    # analysis, where the whole rule behind that column would be computed a second time.
    return counted(out.select("report_id", *RESULT_FIELDS, *kept), "analysed")
