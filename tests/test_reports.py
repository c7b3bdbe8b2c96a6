"""The whole analysis, the report table, the dashboard and the stream."""

import pytest
from pyspark.sql import functions as F

from warnloom.functions.lexicons import IOC_LABELS
from warnloom.operators import cvss, dashboard
from warnloom.operators.similarity import find_similar_incidents
from warnloom.operators.text import split_min_length
from warnloom.plans.analyze import analyze_reports
from warnloom.sources import files, reports, staging
from warnloom.streaming.analyze import analyze_stream

INCIDENT = """Incident note 7

On May 4, 2025 the team saw ransomware on two hosts at 10.1.2.3.\tIt used CVE-2024-1000 and
hxxp://bad[.]top/a, with Emotet on Windows Server. The files were encrypted within one hour.

A ransom note was left on every share. Staff had clicked a link in a phishing mail.
The logs were kept. Nothing else was lost on that day. Recovery took three days in all.
"""
QUIET = "A long and quiet week went by in the office, and there was nothing to write about at all."
DIMENSION = [("CVE-2024-1000", 9.8, "CRITICAL", "AV", "v31")]


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.createDataFrame(
        DIMENSION, "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING"
    )


@pytest.fixture(scope="module")
def analysed(spark, report, dimension):
    return staging.stage(analyze_reports(report(INCIDENT, QUIET, INCIDENT), dimension), "analysed")


def test_whole_result(analysed):
    out = analysed.filter("report_id = 1").first()
    assert out.filename == "r1.txt" and out.word_count == 75
    assert out.threat_type == "Ransomware" and out.severity == "Critical"
    assert out.severity_reasons == ["keywords: ransomware", "1 CVE(s) referenced"]
    assert out.threat_type_scores["Ransomware"] == 3 and out.threat_type_scores["DDoS"] == 0
    assert out.iocs.asDict() == dict.fromkeys(IOC_LABELS, []) | {
        "cves": ["CVE-2024-1000"], "ipv4": ["10.1.2.3"], "urls": ["http://bad.top/a"],
    }
    assert [tuple(c) for c in out.cves_enriched] == DIMENSION
    assert out.entities.malware == ["Emotet"] and out.entities.products == ["Windows Server"]
    assert [(t.id, t.hits) for t in out.techniques] == [
        ("T1486", 3), ("T1566", 1), ("T1190", 1), ("T1204", 1),
    ]
    assert [e.date for e in out.timeline] == ["May 4, 2025"]
    assert out.recommended_actions[0].startswith("Treat as an active incident")
    assert len(out.recommended_actions) == 5
    assert "\t" not in out.text_excerpt and out.text_excerpt.startswith("Incident note 7\n\nOn May")
    # Scores by hand, in hits per word: 1/16, 1/11 and 1/7 (times 1.5), 1/8, 2/9, then nothing.
    assert out.summary.startswith("It used CVE-2024-1000") and out.summary.endswith("in a phishing mail.")


def test_without_lookup(report, dimension):
    assert analyze_reports(report(INCIDENT), dimension, cvss_lookup=False).first().cves_enriched == []
    assert analyze_reports(report(INCIDENT)).first().cves_enriched == []


def test_result_does_not_depend_on_partitions(spark, report, dimension):
    df = report(*[f"{INCIDENT} {i}" for i in range(20)])
    one = analyze_reports(df.repartition(1), dimension).orderBy("report_id").collect()
    many = analyze_reports(df.repartition(16), dimension).orderBy("report_id").collect()
    assert one == many


def test_empty_and_null_texts(report):
    out = analyze_reports(report("", None, "\n \n")).collect()
    assert len(out) == 3
    for row in out:
        assert (row.word_count, row.threat_type, row.severity, row.summary) == (0, "Unknown / Other", "Low", "")
        assert row.timeline == [] and row.techniques == []


def test_json_round_trip(analysed):
    restored = reports.result_from_json(reports.result_to_json(analysed).select("report_id", "result_json"))
    result = [c for c in analysed.columns if c != "text"]  # the text stands beside the result
    assert restored.select(result).orderBy("report_id").collect() == analysed.select(result).orderBy("report_id").collect()


def test_markdown(analysed):
    texts = {r.report_id: r.markdown for r in reports.render_markdown(analysed).collect()}
    lines = texts[1].split("\n")
    assert lines[0] == "# THREAT REPORT — r1.txt"
    assert "- CVE-2024-1000 — CVSS 9.8 (CRITICAL)" in lines
    assert "- T1486 — Data Encrypted for Impact (Impact)" in lines
    at = lines.index("## Indicators of Compromise")
    assert lines[at + 1 : at + 7] == [
        "### cves", "- `CVE-2024-1000`", "### ipv4", "- `10.1.2.3`", "### urls", "- `http://bad.top/a`",
    ]
    assert lines[-1] == "5. Hunt for lateral movement across the domain"
    for text in ("- None found", "- None identified", "- None mapped"):
        assert text in texts[2].split("\n")


def test_markdown_of_bare_and_unrated_cves(spark, report, dimension):
    bare = reports.render_markdown(analyze_reports(report(INCIDENT))).first().markdown
    assert "\n- CVE-2024-1000\n" in bare
    unrated = spark.createDataFrame(
        [("CVE-2024-1000", 5.0, None, None, None)],
        "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING",
    )
    text = reports.render_markdown(analyze_reports(report(INCIDENT), unrated)).first().markdown
    assert "- CVE-2024-1000 — CVSS 5.0 (None)" in text


def test_save_list_get_delete(spark, analysed, tmp_path):
    path = str(tmp_path / "reports")
    table = reports.save_reports(analysed, path)
    table = reports.save_reports(analysed.withColumn("report_id", F.col("report_id") + 10), path)
    listed = reports.list_reports(table, limit=4).collect()
    assert [r.report_id for r in listed] == [13, 12, 11, 3]
    assert listed[0].created_at.microsecond == 0
    found = reports.get_reports_by_id(table, [2, 12, 99]).orderBy("report_id").collect()
    assert [r.report_id for r in found] == [2, 12] and found[0].entities.malware == []
    kept = reports.save_reports(reports.delete_reports(table, [2, 2, 99]).drop("created_at"), str(tmp_path / "v2"))
    assert sorted(r.report_id for r in kept.collect()) == [1, 3, 11, 12, 13]
    reports.write_markdown(table, str(tmp_path / "markdown"))
    names = {r.filename for r in spark.read.parquet(str(tmp_path / "markdown")).collect()}
    assert names == {"r1_report.md", "r2_report.md", "r3_report.md"}


def test_time_of_creation_orders_and_stays(spark, analysed, tmp_path):
    """Ids of files are hashes, so a smaller one may be newer; a new version of a table keeps its times."""
    old = analysed.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    table = reports.save_reports(old, str(tmp_path / "v1"))
    table = reports.save_reports(old.withColumns({"report_id": -F.col("report_id"), "created_at": F.timestamp_seconds(F.lit(1_800_000_000))}), str(tmp_path / "v1"))
    assert [r.report_id for r in reports.list_reports(table, None).collect()] == [-1, -2, -3, 3, 2, 1]
    assert [r.report_id for r in dashboard.dashboard_scope(table, 2).collect()] == [-1, -2]
    kept = reports.write_version(reports.delete_reports(table, [-1, 3]), str(tmp_path / "v2"))
    times = lambda df: {(r.report_id, r.created_at) for r in df.select("report_id", "created_at").collect()}
    assert times(kept) == {x for x in times(table) if x[0] not in (-1, 3)}


def test_similarity_reads_whole_stored_texts(spark, report):
    late = " ".join(f"filler{i}" for i in range(1500)) + " zebra quagga okapi were seen by the gate."
    table = analyze_reports(report(late, "nothing of the kind " * 20))
    found = find_similar_incidents("zebra quagga okapi", table).collect()
    assert [r.report_id for r in found] == [1]


def test_gazetteer_names_and_rule_names(spark, report):
    """A malware or product name overrides a name of the gazetteer that overlaps it."""
    names = [("Cisco Systems", "organizations"), ("Windows", "locations"), ("Acme Corp", "organizations"), ("Berlin", "locations"), ("Emotet", "malware")]
    gaz = spark.createDataFrame(names, "name STRING, bucket STRING")
    found = analyze_reports(report("Acme Corp of Berlin runs Cisco Systems gear and Windows Server. acme corp again.", "Nothing here."), gazetteer=gaz)
    got = {r.report_id: r.entities for r in found.collect()}
    assert (got[1].organizations, got[1].locations) == (["Acme Corp"], ["Berlin"])
    assert got[1].products == ["Cisco", "Windows Server"] and (got[2].organizations, got[2].locations) == ([], [])


def test_files_of_any_case_below_the_folder(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.txt", "b.TXT", "c.tXt", "sub/d.txt", "e.md"):
        (tmp_path / "in" / name).write_text(f"text of {name}")
    path = str(tmp_path / "in")
    assert sorted(r.filename for r in files.read_text_reports(spark, path).collect()) == ["a.txt", "b.TXT", "c.tXt", "d.txt"]
    query = files.stream_text_reports(spark, path).writeStream.format("memory").queryName("seen_files").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(r.filename for r in spark.table("seen_files").collect()) == ["a.txt", "b.TXT", "c.tXt", "d.txt"]


def test_repeated_cvss_records_prefer_a_score(spark, report):
    rows = [("CVE-2024-1000", None, None, None, None), ("cve-2024-1000", 9.8, "CRITICAL", "V", "v31"), ("CVE-2024-1000", 5.0, "MEDIUM", "V", "v31")]
    records = spark.createDataFrame(rows, "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING")
    assert analyze_reports(report("Seen CVE-2024-1000 here."), records).first().cves_enriched[0].score == 9.8


def test_batch_and_stream_keep_the_same_rows(spark, report, tmp_path, monkeypatch):
    """Also with a CVSS dimension of any size: beyond the bound it is joined, which needs a table."""
    monkeypatch.setattr(cvss, "IN_ROW_ROWS", 0)
    report("short", INCIDENT, None).write.parquet(str(tmp_path / "in"))
    rows = [("CVE-2024-1000", 9.8, "CRITICAL", "V", "v31")]
    records = spark.createDataFrame(rows, "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING")
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    analyze_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), records).awaitTermination()
    batch = analyze_reports(report("short", INCIDENT, None), records, min_chars=50)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.report_id for r in batch.collect()] == [r.report_id for r in out.collect()] == [2]
    assert out.first().cves_enriched == batch.first().cves_enriched
    accepted, rejected = split_min_length(report("short", INCIDENT, None))
    assert [r.report_id for r in accepted.collect()] == [2] and sorted(r.report_id for r in rejected.collect()) == [1, 3]


def test_dashboard(analysed):
    assert dashboard.dashboard_kpis(analysed).first().asDict() == {
        "reports": 3, "critical": 2, "total_iocs": 6, "techniques_seen": 4,
    }
    assert {r.severity: r.n_reports for r in dashboard.severity_distribution(analysed).collect()} == {
        "Critical": 2, "Low": 1,
    }
    assert {r.threat_type: r.n_reports for r in dashboard.threat_type_distribution(analysed).collect()} == {
        "Ransomware": 2, "Unknown / Other": 1,
    }
    top = [(r.technique.split()[0], r.n_reports) for r in dashboard.top_techniques(analysed, 3).collect()]
    assert top == [("T1190", 2), ("T1204", 2), ("T1486", 2)]
    assert [r.report_id for r in dashboard.dashboard_scope(analysed, 2).collect()] == [3, 2]
    per_report = {r.report_id: (r.indicators, r.techniques) for r in dashboard.report_kpis(analysed).collect()}
    assert per_report == {1: (3, 4), 2: (0, 0), 3: (3, 4)}
    empty = dashboard.dashboard_kpis(analysed.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_stream_of_files(spark, tmp_path, dimension):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def run():
        stream = files.stream_text_reports(spark, str(folder), max_files=1)
        query = analyze_stream(stream, str(out / "t"), str(out / "c"), dimension)
        query.awaitTermination()
        return {r.filename: r for r in spark.read.parquet(str(out / "t")).collect()}

    (folder / "a.txt").write_text(INCIDENT)
    (folder / "short.txt").write_text("too short")
    first = run()
    assert set(first) == {"a.txt"} and first["a.txt"].cves_enriched[0].score == 9.8
    (folder / "b.txt").write_text(QUIET)
    second = run()
    assert set(second) == {"a.txt", "b.txt"}
    assert second["a.txt"] == first["a.txt"]
