"""CVSS enrichment. Input: report_id and `iocs`; a dimension (cve_id, score, severity, vector, version)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cvss as V
from .joins import is_small, lookup_join
from .metrics import counted
from .rows import element_rows, struct_rows

IN_ROW_ROWS = 400_000
_FIELDS = ["score", "severity", "vector", "version"]


def parse_nvd_metrics(df: DataFrame, json: str = "json") -> DataFrame:
    """Vulnerability records as JSON text to the dimension; a record without metrics gives nulls."""
    return df.withColumn("_m", V.parse_metrics(F.col(json))).select(
        "cve_id", *[F.col(f"_m.{f}").alias(f) for f in _FIELDS]
    )


def _keyed(cvss: DataFrame) -> DataFrame:
    """One record for each id. Of repeated ids the highest score counts, then the greater other fields;
    a record without a score, as a failed lookup leaves it, only where there is no other."""
    return cvss.groupBy(F.upper("cve_id").alias("cve_key")).agg(
        F.max(F.struct(*_FIELDS)).alias("record")
    )


def _lookup(keyed: DataFrame):
    """A function from arrays of CVEs to arrays of enriched CVEs, over a dimension of checked size that
    is broadcast once per executor. Whole Arrow batches are looked up at a time."""
    table = keyed.select("cve_key", "record.*").toArrow()
    shared = keyed.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(V.ENRICHED)
    def lookup(cves: pa.Array) -> pa.Array:
        records = shared.value
        flat = cves.flatten()
        found = pc.index_in(pc.utf8_upper(flat), value_set=records["cve_key"])
        columns = [flat, *[records[f].combine_chunks().take(found) for f in _FIELDS]]
        entries = pa.StructArray.from_arrays(columns, names=["id", *_FIELDS])
        lengths = pc.fill_null(pc.list_value_length(cves), 0)
        ends = pc.cumulative_sum(lengths)
        offsets = pa.concat_arrays([pa.array([0], ends.type), ends]).cast(pa.int32())
        return pa.ListArray.from_arrays(offsets, entries)

    return lookup


def _enriched_entry(cve: Column, record: Column) -> Column:
    return F.struct(cve.alias("id"), *[record[f].alias(f) for f in _FIELDS])


def enrich_cves(df: DataFrame, cvss: DataFrame, in_row_rows: int | None = None, **join_options) -> DataFrame:
    """Add `cves_enriched`: for each CVE, in order and as written, its CVSS record or nulls.

    A dimension counted to have at most `in_row_rows` (IN_ROW_ROWS) rows is broadcast and looked up for the array of
    each row, so wide report rows are never exploded or shuffled. (An array cannot be the key of a
    broadcast join.) A larger one is joined to the exploded CVEs alone, and only the collected result
    meets the reports again.
    """
    keyed = _keyed(cvss)
    cves = F.col("iocs.cves")
    if is_small(cvss, IN_ROW_ROWS if in_row_rows is None else in_row_rows):
        # The count keeps the CVE search a column of its own. Merged into the argument, its nested
        # lambdas can stop Spark from recognising the function as one to run in Python.
        listed = counted(df.withColumn("_cves", cves), "enriched")
        return listed.withColumn("cves_enriched", _lookup(keyed)("_cves")).drop("_cves")
    mentions = element_rows(df, "report_id", cves, "cve").withColumn("cve_key", F.upper("cve"))
    joined = lookup_join(
        mentions, keyed, ["cve_key"], spread_by=["report_id", "pos"], **join_options
    )
    entries = F.sort_array(
        F.collect_list(F.struct("pos", _enriched_entry(F.col("cve"), F.col("record")).alias("x")))
    )
    collected = joined.groupBy("report_id").agg(entries.alias("_entries"))
    return (
        df.join(collected, "report_id", "left")
        .withColumn(
            "cves_enriched",
            F.coalesce(F.transform("_entries", lambda e: e["x"]), F.array()).cast(V.ENRICHED),
        )
        .drop("_entries")
    )


def without_enrichment(df: DataFrame) -> DataFrame:
    """Add an empty `cves_enriched`: the lookup is switched off."""
    return df.withColumn("cves_enriched", F.array().cast(V.ENRICHED))


def displayed_vulnerabilities(df: DataFrame) -> DataFrame:
    """What a reader is shown: the enriched CVEs, or the bare ids where there are none:
    report_id, pos, id, score, severity, band."""
    bare = F.transform(
        "iocs.cves",
        lambda c: F.struct(
            c.alias("id"),
            F.lit(None).cast("double").alias("score"),
            *[F.lit(None).cast("string").alias(f) for f in _FIELDS[1:]],
        ),
    )
    shown = F.when(F.size("cves_enriched") > 0, F.col("cves_enriched")).otherwise(bare)
    rows = struct_rows(df, "report_id", shown, pos="pos")
    return cvss_band(rows.select("report_id", "pos", "id", "score", "severity"))


def cvss_band(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("band", V.band(F.col(score)))
