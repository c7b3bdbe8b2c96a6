"""Indicator extraction. Input: report_id and normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.core import dedupe_ci as dedupe_values
from ..functions.lexicons import IOC_LABELS
from .rows import element_rows, struct_rows


def extract_label(df: DataFrame, label: str) -> DataFrame:
    """Every match of one label as written, repeats included: report_id, pos, value."""
    return element_rows(df, "report_id", I.find_label(F.col("text"), label), "value")


def extract_cves(df: DataFrame) -> DataFrame:
    return extract_label(df, "cves")


def extract_ipv4(df: DataFrame) -> DataFrame:
    return extract_label(df, "ipv4")


def extract_urls(df: DataFrame) -> DataFrame:
    return extract_label(df, "urls")


def extract_emails(df: DataFrame) -> DataFrame:
    return extract_label(df, "emails")


def extract_md5(df: DataFrame) -> DataFrame:
    return extract_label(df, "md5")


def extract_sha1(df: DataFrame) -> DataFrame:
    return extract_label(df, "sha1")


def extract_sha256(df: DataFrame) -> DataFrame:
    return extract_label(df, "sha256")


def extract_domains(df: DataFrame) -> DataFrame:
    return extract_label(df, "domains")


def dedupe_ci(df: DataFrame, values: str) -> DataFrame:
    """Drop case-insensitive repeats from the string array `values`, first casing and order kept."""
    return df.withColumn(values, dedupe_values(values))


def trim_url_tail(df: DataFrame, urls: str = "urls") -> DataFrame:
    return df.withColumn(urls, I.trim_url_tail(F.col(urls)))


def drop_embedded_domains(
    df: DataFrame, domains: str = "domains", urls: str = "urls", emails: str = "emails"
) -> DataFrame:
    return df.withColumn(
        domains, I.drop_embedded_domains(F.col(domains), F.col(urls), F.col(emails))
    )


def extract_iocs(df: DataFrame) -> DataFrame:
    """Add `iocs`, a struct of eight string arrays in label order. A narrow projection.

    The order matters: repeats go first, then URL tails (so trimmed URLs may repeat), then domains
    that are part of the trimmed URLs or of an e-mail address.
    """
    text = F.col("text")
    patterns = [label for label in IOC_LABELS if label not in I.HASH_LENGTHS]
    wide = df.withColumns(
        {f"_{label}": I.find_label(text, label) for label in patterns} | {"_hashes": I.hashes(text)}
    )
    wide = wide.withColumns(
        {f"_{label}": dedupe_values(f"_{label}") for label in patterns}
        | {f"_{label}": dedupe_values(I.hashes_sql("_hashes", label)) for label in I.HASH_LENGTHS}
    )
    wide = trim_url_tail(wide, "_urls")
    wide = drop_embedded_domains(wide, "_domains", "_urls", "_emails")
    iocs = F.struct(*[F.col(f"_{label}").alias(label) for label in IOC_LABELS])
    return wide.withColumn("iocs", iocs).drop("_hashes", *[f"_{label}" for label in IOC_LABELS])


def labelled(iocs: Column) -> Column:
    """Array of structs (ioc_type, values) in label order."""
    return F.array(
        *[F.struct(F.lit(x).alias("ioc_type"), iocs[x].alias("values")) for x in IOC_LABELS]
    )


def iocs_long(df: DataFrame) -> DataFrame:
    """One row for each indicator: report_id, ioc_type, pos, value."""
    by_label = struct_rows(df, "report_id", labelled(F.col("iocs")))
    return element_rows(by_label, ["report_id", "ioc_type"], "values", "value")


def ioc_counts_by_label(df: DataFrame, labels=tuple(IOC_LABELS[1:])) -> DataFrame:
    """List sizes per report, by default for every label but the CVEs: report_id, ioc_type, n."""
    by_label = struct_rows(df, "report_id", labelled(F.col("iocs")))
    return by_label.filter(F.col("ioc_type").isin(*labels)).select(
        "report_id", "ioc_type", F.size("values").alias("n")
    )


def ioc_total(df: DataFrame) -> DataFrame:
    return df.select("report_id", I.ioc_total(F.col("iocs")).alias("ioc_total"))


def indicator_counts(df: DataFrame) -> DataFrame:
    """Indicators of each kind over all reports: ioc_type, n_reports, n_indicators."""
    return (
        struct_rows(df, [], labelled(F.col("iocs")))
        .filter(F.size("values") > 0)
        .groupBy("ioc_type")
        .agg(
            F.count(F.lit(1)).alias("n_reports"),
            F.sum(F.size("values")).cast("long").alias("n_indicators"),
        )
    )
