"""The report corpus the registered queries run on: every document with a report-like ending.

The given documents hold addresses, hashes and names but no dates, CVEs or threat keywords, so each
one gets one of nine short endings. The CVSS dimension is derived from the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import spread_input
from ..sources.files import parse_cvss_json

# Folders of the documents as files.
FOLDERS = 512
ENDINGS = [
    "On March 12, 2026, ransomware encrypted files via CVE-2023-28252 and cve-2023-28252. C2 at "
    "185.220.101.47, see hxxp://login-bad[.]tk/reset, and http://login-bad.tk/reset. Emotet loader "
    "dropped by Cobalt Strike! A ransom note was left.",
    "Spearphishing lure from support@helpdesk-update[.]com on 2 April 2026. Hash "
    "d41d8cd98f00b204e9800998ecf8427e seen. Domain mail-auth[.]xyz reused.",
    "Botnet traffic flood (ddos) on 2026-04-02. Brute force against RDP and VPN. Windows Server "
    "affected.",
    "Nothing notable happened in this period.",
    "Actively exploited zero-day CVE-2024-21413 hits unpatched servers. The vulnerability was "
    "published 2024-02-13. Cisco gear is safe.",
    "Data breach confirmed 03/15/2026. The group exfiltrated files, leaked them and stole data.",
    "Trojan dropper with rootkit found. Suspicious hosts 10.0.0.1, 10.0.0.2, 10.0.0.3, 10.0.0.4 "
    "and 10.0.0.5 seen. Its hash is 44d88612fea8a8f36de82e1278abb02f44d88612fea8a8f36de82e1278abb02f.",
    "Password spray, then mimikatz dumping of lsass. Every credential was reset.",
    "An advanced persistent nation-state APT29 group ran espionage with lateral movement by psexec.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, filename, text, as they would arrive."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_endings(spread_input(documents, "doc_id"))


def with_endings(documents: DataFrame) -> DataFrame:
    ending = F.get(
        F.array(*[F.lit(e) for e in ENDINGS]), F.pmod("doc_id", F.lit(len(ENDINGS))).cast("int")
    )
    return documents.select(
        F.col("doc_id").alias("report_id"),
        F.concat(F.lit("report-"), "doc_id", F.lit(".txt")).alias("filename"),
        F.concat("text", F.lit("\n"), ending).alias("text"),
    )


def cvss_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cached-lookup JSON object for each document, with nulls and broken text among them."""
    tenths = F.pmod(F.col("doc_id") * 7, F.lit(101))
    score = F.concat_ws(".", F.floor(tenths / 10).cast("string"), F.pmod(tenths, F.lit(10)).cast("string"))
    record = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit("null")).otherwise(
        F.concat(
            F.lit('{"score": '), score, F.lit(', "severity": "'),
            F.when(tenths >= 90, "CRITICAL").when(tenths >= 70, "HIGH").otherwise("MEDIUM"),
            F.lit('", "vector": "V'), F.col("doc_id").cast("string"), F.lit('", "version": "v31"}'),
        )
    )
    whole = F.concat(
        F.lit('{"CVE-2023-'), (F.col("doc_id") + 28200).cast("string"), F.lit('": '), record,
        F.lit(', "CVE-2024-'), (F.col("doc_id") + 21400).cast("string"), F.lit('": '), record,
        F.lit("}"),
    )
    broken = F.concat(F.lit("not json "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.when(F.pmod("doc_id", F.lit(17)) == 0, broken).otherwise(whole).alias("value")
    )


def write_cvss_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The same as files: each one object over many lines; the broken texts are files of their own."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [lead + value[1:-1]]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": ["}" if lead == "," else "{}"]})

    texts = cvss_json(spark, sf_dir)
    whole = F.startswith("value", F.lit("{"))
    texts.filter(whole).mapInArrow(lines, "value STRING").write.text(f"{path}/records")
    texts.filter(~whole).write.text(f"{path}/broken")


def write_text_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Every document as a .txt file of its own, in FOLDERS folders; rows that share an id are lines of one file. Tasks write files
    where they belong: Spark's writer has the driver rename each, and sets each one's permissions by a process of its own on
    a local disk."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    lines = F.sort_array(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text"))))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).cast("string")
    name = F.concat_ws("/", F.lit(path), folder, F.concat(F.lit("report-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = fs.FileSystem.from_uri(name)[1]
                folder = place.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                # The same file again if a task is repeated.
                with files.open_output_stream(place) as out:
                    out.write(text.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    texts.select(name.alias("name"), "text").mapInArrow(write, "n BIGINT").agg(F.sum("n")).first()


def cvss_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_cvss_json(cvss_json(spark, sf_dir))


def nvd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerability JSON for each document: cve_id, json. Versions, wrapping and gaps vary."""
    doc_id = F.col("doc_id").cast("string")
    kind = F.pmod("doc_id", F.lit(7))

    def entry(score, severity):
        return F.concat(
            F.lit('[{"cvssData": {"baseScore": '), F.lit(score), F.lit(', "baseSeverity": "'),
            F.lit(severity), F.lit('", "vectorString": "N'), doc_id, F.lit('"}}]'),
        )

    def metrics(*pairs):
        parts = [F.lit('{"metrics": {')]
        for i, (name, value) in enumerate(pairs):
            parts += [F.lit(("" if i == 0 else ", ") + f'"{name}": '), value]
        return F.concat(*parts, F.lit("}}"))

    json = (
        F.when(kind == 0, metrics(("cvssMetricV2", entry("5.0", "low")), ("cvssMetricV31", entry("9.8", "critical"))))
        .when(kind == 1, metrics(("cvssMetricV30", entry("7.5", "High"))))
        .when(kind == 2, metrics(("cvssMetricV40", entry("8.1", "HIGH")), ("cvssMetricV31", F.lit("[]"))))
        .when(kind == 3, metrics(("cvssMetricV2", F.concat(F.lit('[{"cvssData": {"baseScore": 4.3, "vectorString": "N'), doc_id, F.lit('"}, "baseSeverity": "MEDIUM"}]')))))
        .when(kind == 4, F.lit('{"metrics": {}}'))
        .when(kind == 5, F.concat(F.lit('{"vulnerabilities": [{"cve": '), metrics(("cvssMetricV31", entry("6.1", "medium"))), F.lit("}]}")))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("CVE-2025-"), (F.col("doc_id") + 10000).cast("string")).alias("cve_id"),
        json.alias("json"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look for, with overlaps: common pairs and words of the benchmark table's texts."""
    words = F.split(F.lower(F.regexp_replace("text", r"[^A-Za-z]+", " ")), " ")
    start = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    organisations = start.select(
        F.array_join(F.slice("w", 1, 2), " ").alias("name"), F.lit("organizations").alias("bucket")
    )
    places = start.select(
        F.array_join(F.slice("w", 2, 3), " ").alias("name"), F.lit("locations").alias("bucket")
    )
    return organisations.unionByName(places).distinct()


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of six labels: the longer words of the benchmark table's texts."""
    words = F.split(F.lower(F.regexp_replace("text", r"[^A-Za-z]+", " ")), " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("pos", "keyword"))
    group = F.pmod("item_id", F.lit(6))
    return rows.filter(F.length("keyword") >= 4).select(
        F.concat(F.lit("group-"), group.cast("string")).alias("label"), group.cast("int").alias("ord"), "keyword", (F.col("item_id") * 1000 + F.col("pos")).cast("int").alias("kw_ord")
    )
