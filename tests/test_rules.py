"""Classification, severity, techniques, entities, actions and CVSS."""

import json

import pytest
from pyspark.sql import functions as F

from warnloom.functions import cvss as V
from warnloom.functions import names as N
from warnloom.functions.lexicons import (
    CRITICAL_ACTION,
    STOP_WORDS,
    TECHNIQUES,
    THREAT_KEYWORDS,
    all_keywords,
)
from warnloom.functions import keywords as K
from warnloom.operators import classify, cvss, entities, indicators
from warnloom.sources import files


def by_id(df):
    return {row.report_id: row for row in df.collect()}


def test_lexicon_sizes():
    assert [len(words) for words in THREAT_KEYWORDS.values()] == [6, 6, 7, 6, 5, 4, 6, 5]
    assert len(TECHNIQUES) == 15 and sum(len(t[3]) for t in TECHNIQUES) == 74
    assert len(all_keywords()) == 103


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    default = StopWordsRemover.loadDefaultStopWords("english")
    assert set(STOP_WORDS) == {w for w in default if "'" not in w}


def test_keywords_found_equal_plain_containment(spark, report):
    words = all_keywords()
    texts = ["", "nothing here", *words, " ".join(words), "CAPTURED exploiteD", "data\nencrypted", "zero-dayzero day"]
    found = by_id(report(*texts).select("report_id", K.keywords_in(F.col("text")).alias("k")))
    for i, text in enumerate(texts, 1):
        assert set(found[i].k) == {w for w in words if w in text.lower()}, text
        assert len(found[i].k) == len(set(found[i].k))


def test_threat_type_presence_ties_and_default(spark, report):
    out = by_id(classify.classify_threat_type(report(
        "ransomware ransomware ransomware", "lure. trojan.", "all quiet", "captured", "mimikatz exploit",
    )))
    assert out[1].threat_type_scores["Ransomware"] == 1
    assert out[2].threat_type == "Phishing"  # tie of one each, first declared
    assert out[3].threat_type == "Unknown / Other" and set(out[3].threat_type_scores.values()) == {0}
    assert out[4].threat_type == "APT / Targeted Intrusion"
    assert out[5].threat_type == "Vulnerability Exploitation"
    assert list(out[1].threat_type_scores) and len(out[1].threat_type_scores) == 8


def test_severity(spark, report):
    ips = " ".join(f"10.0.0.{i}" for i in range(5))
    domains = " ".join(f"d{i}.com" for i in range(9))
    out = by_id(classify.classify_severity(indicators.extract_iocs(report(
        "Widespread ransomware, double extortion, zero-day and zero day, data encrypted, phishing",
        "calm " + ips, "calm " + domains, "calm", "phishing " + ips, "CVE-2024-1000",
    ))))
    assert out[1].severity == "Critical"
    assert out[1].severity_reasons == ["keywords: ransomware, zero-day, zero day, data encrypted"]
    assert (out[2].severity, out[2].severity_reasons) == ("High", ["5 indicators of compromise found"])
    assert (out[3].severity, out[3].severity_reasons) == (
        "Low", ["no high-impact keywords or indicators found"],
    )
    assert out[4].severity == "Low"
    assert out[5].severity_reasons == ["keywords: phishing", "5 indicators of compromise found"]
    assert out[5].severity == "High"
    assert out[6].severity_reasons == ["keywords: cve-", "1 CVE(s) referenced"]


def test_techniques_order_and_keywords(spark, report):
    df = report("Exploited via RDP and VPN; brute force", "deleted\nbackups", "smb psexec c2")
    rows = classify.technique_hits(df).orderBy("report_id", "pos").collect()
    assert [(r.report_id, r.technique_id, r.hits, r.matched_keywords) for r in rows] == [
        (1, "T1133", 3, ["rdp", "vpn", "brute force"]),
        (1, "T1190", 2, ["exploit", "exploited"]),
        (1, "T1110", 1, ["brute force"]),
        (3, "T1021", 2, ["psexec", "smb"]),
        (3, "T1071", 1, ["c2"]),
    ]
    nested = by_id(classify.map_techniques(df))
    assert nested[2].techniques == [] and nested[1].techniques[0].keywords == TECHNIQUES[2][3]


def test_actions(spark):
    df = spark.createDataFrame(
        [(1, "DDoS", "Critical"), (2, "DDoS", "Low"), (3, "never heard of", "High")],
        "report_id INT, threat_type STRING, severity STRING",
    )
    out = by_id(classify.recommend_actions(df))
    assert out[1].recommended_actions == [CRITICAL_ACTION, *out[2].recommended_actions]
    assert out[3].recommended_actions[0] == "Manually review the report"


def test_entities(spark, report):
    df = report(
        "EMOTET then Emotet, Cobalt Strike; cobalt\nstrike on Windows Server and windows. RyukReadMe contié",
        "éconti _ryuk maze-like",
    )
    out = by_id(entities.extract_entities(df))
    assert out[1].entities.malware == ["EMOTET", "Cobalt Strike"]
    assert out[1].entities.products == ["Windows Server", "windows"]
    assert out[1].entities.organizations == [] and out[1].entities.locations == []
    assert out[2].entities.malware == ["maze"]
    late = report("x" * 200_001 + " emotet")
    assert entities.extract_entities(late).first().entities.malware == ["emotet"]
    assert entities.extract_entities(late, max_chars=200_000).first().entities.malware == []


def test_noise(spark):
    values = ["1.2.3.4", "x.com", "X.COM", "a.b.com", "x.online", "CVE-2024-1", "CVE-2024-1234", "Emotet"]
    df = spark.createDataFrame([(v,) for v in values], "entity STRING")
    assert [r.entity for r in entities.drop_ioc_noise(df).collect()] == [
        "a.b.com", "x.online", "CVE-2024-1234", "Emotet",
    ]


def brute_gazetteer(text, names):
    """All whole-token occurrences; then longest first, leftmost first, without overlap."""
    import re

    tokens = re.findall(r"\w+|\W", text)
    spans = []
    for name, bucket in names:
        want = re.findall(r"\w+|\W", name.lower())
        for i in range(len(tokens) - len(want) + 1):
            if [t.lower() for t in tokens[i : i + len(want)]] == want:
                spans.append((-len(want), i, "".join(tokens[i : i + len(want)]), bucket))
    used, kept = set(), []
    for n, start, name, bucket in sorted(spans):
        places = set(range(start, start - n))
        if not places & used:
            used |= places
            kept.append((start, name, bucket))
    return kept


@pytest.mark.parametrize("options", [{}, {"most": 2}])
def test_gazetteer_against_brute_force(spark, report, options):
    import random

    rng = random.Random(3)
    vocabulary = ["acme", "north", "bank", "of", "Paris", "é", "AT&T", "x"]
    names = [
        ("Acme", "organizations"), ("acme north", "organizations"), ("north bank of", "organizations"),
        ("bank of paris", "organizations"), ("Paris", "locations"), ("AT&T", "organizations"),
        ("of paris é x", "locations"),
    ]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 25))) for _ in range(120)]
    # One hot name in a third of all reports.
    texts += ["Paris " * 30] * 60
    gaz = spark.createDataFrame(names, "name STRING, bucket STRING")
    kept = entities.gazetteer_spans(report(*texts), gaz, overlaps=False, **options).collect()
    got = {}
    for r in kept:
        got.setdefault(r.report_id, []).append((r.start, r.name, r.bucket))
    for i, text in enumerate(texts, 1):
        assert sorted(got.get(i, [])) == sorted(brute_gazetteer(text, names)), text
    out = entities.extract_gazetteer(report(*texts), gaz, **options).collect()
    firsts = {(r.report_id, r.bucket, r.name.lower()) for r in out}
    assert len(firsts) == len(out)
    assert {(i, b, n.lower()) for i, rows in got.items() for _, n, b in rows} == firsts


DIMENSION = [
    ("CVE-2024-1000", 9.8, "CRITICAL", "v", "v31"), ("CVE-2024-1001", 10.0, None, None, "v2"),
    ("CVE-2024-1002", None, None, None, None),
]
DIMENSION_SCHEMA = "cve_id STRING, score DOUBLE, severity STRING, vector STRING, version STRING"


@pytest.mark.parametrize("options", [{}, {"in_row_rows": 0}, {"in_row_rows": 0, "broadcast_rows": 0, "salts": 4}])
def test_enrichment_is_the_same_by_lookup_broadcast_and_salted_join(spark, report, options):
    dimension = spark.createDataFrame(DIMENSION, DIMENSION_SCHEMA)
    hot = ["again CVE-2024-1000"] * 40
    df = indicators.extract_iocs(report("cve-2024-1001 CVE-2024-9999 CVE-2024-1000", "none", "CVE-2024-1002", *hot))
    out = by_id(cvss.enrich_cves(df, dimension, **options))
    assert len(out) == 43
    assert [tuple(c) for c in out[1].cves_enriched] == [
        ("cve-2024-1001", 10.0, None, None, "v2"),
        ("CVE-2024-9999", None, None, None, None),
        ("CVE-2024-1000", 9.8, "CRITICAL", "v", "v31"),
    ]
    assert out[2].cves_enriched == []
    assert tuple(out[3].cves_enriched[0]) == ("CVE-2024-1002", None, None, None, None)
    assert all(out[i].cves_enriched[0].score == 9.8 for i in range(4, 44))


def test_displayed_vulnerabilities_and_bands(spark, report):
    df = indicators.extract_iocs(report("CVE-2024-1000 cve-2024-1001", "quiet"))
    shown = cvss.displayed_vulnerabilities(cvss.without_enrichment(df)).collect()
    assert [(r.id, r.score, r.band) for r in shown] == [
        ("CVE-2024-1000", None, "n/a"), ("cve-2024-1001", None, "n/a"),
    ]
    scores = spark.createDataFrame([(s,) for s in (None, 9.0, 8.9, 7.0, 6.9, 4.0, 3.9, 0.0)], "score DOUBLE")
    assert [r.band for r in cvss.cvss_band(scores).collect()] == [
        "n/a", "critical", "high", "high", "medium", "medium", "low", "low",
    ]


def test_nvd_metrics(spark):
    def entry(score, severity="high"):
        return [{"cvssData": {"baseScore": score, "baseSeverity": severity, "vectorString": "V"}}]

    records = {
        "a": {"metrics": {"cvssMetricV2": entry(1.0), "cvssMetricV40": entry(2.0), "cvssMetricV30": entry(3.0), "cvssMetricV31": entry(4.0)}},
        "b": {"metrics": {"cvssMetricV2": entry(1.0), "cvssMetricV40": entry(2.0), "cvssMetricV31": []}},
        "c": {"metrics": {"cvssMetricV31": entry(5.0, "")}},
        "d": {"metrics": {}},
        "e": {"vulnerabilities": [{"cve": {"metrics": {"cvssMetricV2": entry(6.0)}}}]},
        "f": {"metrics": {"cvssMetricV31": [{}], "cvssMetricV2": entry(7.0)}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()], "cve_id STRING, json STRING")
    out = {r.cve_id: (r.score, r.severity, r.version) for r in cvss.parse_nvd_metrics(df).collect()}
    assert out == {
        "a": (4.0, "HIGH", "v31"), "b": (2.0, "HIGH", "v40"), "c": (5.0, None, "v31"),
        "d": (None, None, None), "e": (6.0, "HIGH", "v2"), "f": (None, None, "v31"),
    }


def test_cvss_file_missing_broken_or_good(spark, tmp_path):
    assert files.load_cvss_dimension(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "broken.json").write_text("{oops")
    assert files.load_cvss_dimension(spark, str(tmp_path / "broken.json")).count() == 0
    good = {"CVE-1": {"score": 7.8, "severity": "HIGH", "vector": "x", "version": "v31"}, "CVE-2": None}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    rows = files.load_cvss_dimension(spark, str(tmp_path / "good.json")).collect()
    assert {tuple(r) for r in rows} == {("CVE-1", 7.8, "HIGH", "x", "v31"), ("CVE-2", None, None, None, None)}
    assert V.BANDS and N.NAMES


def test_enrichment_with_an_empty_dimension(spark, report):
    nothing = spark.createDataFrame([], DIMENSION_SCHEMA)
    df = indicators.extract_iocs(report("CVE-2024-1000", "none"))
    out = by_id(cvss.enrich_cves(df, nothing))
    assert [tuple(c) for c in out[1].cves_enriched] == [("CVE-2024-1000", None, None, None, None)]
    assert out[2].cves_enriched == []
