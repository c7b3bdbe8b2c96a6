"""Figures from the sums of batches against figures from all reports."""

import pytest

from warnloom.operators import dashboard, rollup
from warnloom.plans.analyze import analyze_reports
from warnloom.sources.files import load_cvss_dimension, stream_text_reports
from warnloom.streaming.analyze import analyze_stream

TEXTS = [
    "Ransomware encrypted files via CVE-2023-28252. C2 at 185.220.101.47.", "Phishing mail from a@b.com and http://x.tk/a.",
    "Nothing happened here at all, as far as anybody could tell today.", "Password spray and mimikatz dumping of lsass. Brute force on RDP.",
    "Botnet ddos flood on 2026-04-02 against many hosts of the network.", "Actively exploited zero-day CVE-2024-21413 hits unpatched servers.",
]


@pytest.fixture(scope="module")
def analysed(spark, report):
    return analyze_reports(report(*TEXTS * 4)).cache()


def same(sums, reports):
    rows = lambda df: sorted(map(tuple, df.collect()))
    for name in ("severity_distribution", "threat_type_distribution", "top_techniques", "dashboard_kpis"):
        assert rows(getattr(rollup, name)(sums)) == rows(getattr(dashboard, name)(reports)), name


def test_batches_add_up_and_a_batch_may_run_again(spark, analysed, tmp_path):
    path = str(tmp_path / "sums")
    for batch in (0, 1, 2, 1, 0):
        rollup.write_sums(analysed.filter(f"report_id % 3 = {batch}"), path, batch)
    same(rollup.read_sums(spark, path), analysed)
    # Deleted reports are taken back.
    rollup.write_sums(analysed.filter("report_id <= 10"), path, 3, sign=-1)
    same(rollup.read_sums(spark, path), analysed.filter("report_id > 10"))
    rollup.write_sums(analysed.filter("report_id > 10"), path, 4, sign=-1)
    same(rollup.read_sums(spark, path), analysed.limit(0))


def test_no_reports(spark, analysed, tmp_path):
    rollup.write_sums(analysed.limit(0), str(tmp_path / "none"), 0)
    same(rollup.read_sums(spark, str(tmp_path / "none")), analysed.limit(0))


def test_stream_keeps_sums_and_reads_the_dimension_for_each_batch(spark, tmp_path):
    records, incoming = tmp_path / "cvss", tmp_path / "in"
    records.mkdir()
    incoming.mkdir()
    (records / "a.json").write_text('{"CVE-2023-28252": {"score": 7.8, "severity": "HIGH"}}')
    for name in ("a", "b"):
        (incoming / f"{name}.txt").write_text(f"Report {name}: CVE-2023-28252 and CVE-2024-21413 were used against the servers.")
    calls = []

    def dimension(session):
        calls.append(1)
        if len(calls) == 2:
            (records / "b.json").write_text('{"CVE-2024-21413": {"score": 9.8, "severity": "CRITICAL"}}')
        return load_cvss_dimension(session, str(records))

    source = stream_text_reports(spark, str(incoming), max_files=1)
    analyze_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), dimension, sums=str(tmp_path / "sums")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    scores = [[c.score for c in r.cves_enriched] for r in out.collect()]
    assert len(calls) == 2 and sorted(scores, key=repr) == sorted([[7.8, None], [7.8, 9.8]], key=repr)
    same(rollup.read_sums(spark, str(tmp_path / "sums")), out)
