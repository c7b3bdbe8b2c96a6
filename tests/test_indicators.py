"""Indicator extraction against the plain patterns in Python, and on texts built to hurt."""

import random
import re
import time

from pyspark.sql import functions as F

from warnloom.functions import indicators as I
from warnloom.functions.core import dedupe_ci, first_per_key
from warnloom.functions.lexicons import DOMAIN_TLDS, IOC_LABELS
from warnloom.operators import indicators

# The plain patterns.
PLAIN = {
    "cves": re.compile(r"\bCVE-\d{4}-\d{4,7}\b", re.I),
    "ipv4": re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    "urls": re.compile(r"\bhttps?://[^\s)\"'<>]+", re.I),
    "emails": re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "md5": re.compile(r"\b[a-fA-F0-9]{32}\b"),
    "sha1": re.compile(r"\b[a-fA-F0-9]{40}\b"),
    "sha256": re.compile(r"\b[a-fA-F0-9]{64}\b"),
    "domains": re.compile(r"\b(?:[a-zA-Z0-9-]+\.)+(?:" + "|".join(DOMAIN_TLDS) + r")\b", re.I),
}


def texts_from(pieces, count, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randrange(1, length))) for _ in range(count)]


def all_matches(df, label):
    rows = df.select("report_id", I.find_label(F.col("text"), label)).orderBy("report_id").collect()
    return [row[1] for row in rows]


def test_every_label_finds_what_the_plain_pattern_finds(spark, report):
    pieces = [
        "a", "b", "foo", "com", "net", "ir", "COM", ".", ".", "..", "-", "_", "@", "@", " ", "é", "١",
        "1", "23", "255", "%", "+", "/", "http://", "hTTps://", "x.org", "a@b.co", ":", ",", ")", '"',
        "CVE-2024-", "cve-1999-12345", "12345678", "\n", "\xa0", "0123456789abcdef" * 2, "deadbeef",
        "0123456789ABCDEF" * 4, "f" * 40, "com-", "-com", "中", "1.2.3.4", ".5.66.777", "8.8.8",
    ]
    texts = texts_from(pieces, 3000, 14, 7)
    df = report(*texts).repartition(8).cache()
    for label, pattern in PLAIN.items():
        want = [pattern.findall(t) for t in texts]
        got = all_matches(df, label)
        wrong = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
        assert not wrong, (label, len(wrong), wrong[:3])
        assert sum(map(len, want)) > 0, label


def test_dedupe_keeps_first_casing_and_order(spark):
    values = ["b", "A", "B", "a", "c", "b", "Ä", "ä", "C"]
    df = spark.createDataFrame([(values,), ([],), (["x", "x"],)], "v array<string>")
    got = [r[0] for r in df.select(dedupe_ci("v")).collect()]
    assert got == [["b", "A", "c", "Ä"], [], ["x"]]
    general = [r[0] for r in df.select(first_per_key(F.col("v"), F.lower)).collect()]
    assert general == got


def test_rules_apply_in_order(spark, report):
    df = report(
        'See http://a.tk/x, http://a.tk/x. and HTTP://A.TK/X) then mail root@b.com; b.com a.tk own.org '
        "OWN.ORG 999.1.1.1 cve-2020-1111 CVE-2020-1111"
    )
    iocs = indicators.extract_iocs(df).first().iocs
    assert iocs.urls == ["http://a.tk/x", "http://a.tk/x", "HTTP://A.TK/X"]  # tails go after repeats
    assert iocs.emails == ["root@b.com"]
    assert iocs.domains == ["own.org"]
    assert iocs.ipv4 == ["999.1.1.1"]
    assert iocs.cves == ["cve-2020-1111"]
    assert list(iocs.asDict()) == IOC_LABELS


def test_url_tail_characters(spark):
    urls = ["http://x/.,;:!?)\\]\"'", "http://x/a(b)", "http://x/a.b", ")))"]
    df = spark.createDataFrame([(urls,)], "urls array<string>")
    assert df.select(I.trim_url_tail(F.col("urls"))).first()[0] == [
        "http://x/", "http://x/a(b", "http://x/a.b", "",
    ]


def test_long_forms_and_counts_agree(spark, report):
    df = indicators.extract_iocs(report("a.com b@c.com 1.2.3.4 5.6.7.8", "nothing", "x.io"))
    long_rows = indicators.iocs_long(df).collect()
    assert {(r.report_id, r.ioc_type, r.pos, r.value) for r in long_rows} == {
        (1, "ipv4", 0, "1.2.3.4"), (1, "ipv4", 1, "5.6.7.8"), (1, "emails", 0, "b@c.com"),
        (1, "domains", 0, "a.com"), (3, "domains", 0, "x.io"),
    }
    counts = {(r.report_id, r.ioc_type): r.n for r in indicators.ioc_counts_by_label(df).collect()}
    assert len(counts) == 21 and counts[1, "ipv4"] == 2 and (1, "cves") not in counts
    assert {r.report_id: r.ioc_total for r in indicators.ioc_total(df).collect()} == {1: 4, 2: 0, 3: 1}
    totals = {r.ioc_type: (r.n_reports, r.n_indicators) for r in indicators.indicator_counts(df).collect()}
    assert totals == {"ipv4": (1, 2), "emails": (1, 1), "domains": (2, 2)}


def test_long_runs_stay_linear(spark, report):
    """Each of these takes minutes, or overflows the stack, with patterns that restart at every label."""
    n = 200_000
    df = report("a." * n, "1.2." * n, "." * n, "a@" * n, "a-" * n + ".com", "x" * n + "@" + "b." * n)
    start = time.monotonic()
    rows = indicators.extract_iocs(df).select("report_id", "iocs.domains", "iocs.emails").collect()
    assert time.monotonic() - start < 60
    found = {r.report_id: r for r in rows}
    assert len(found[5].domains) == 1 and not found[1].domains and not found[4].emails


def test_a_report_with_very_many_indicators(spark, report):
    n = 60_000
    text = " ".join(f"host{i % (n // 2)}.Com" if i % 2 else f"HOST{i % (n // 2)}.com" for i in range(n))
    start = time.monotonic()
    domains = indicators.extract_iocs(report(text)).first().iocs.domains
    assert time.monotonic() - start < 60
    assert len(domains) == n // 2 and domains[0] == "HOST0.com" and domains[1] == "host1.Com"
