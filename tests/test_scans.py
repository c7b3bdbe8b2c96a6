"""Scans in Python: what they leave to patterns, and that they are there."""

import pytest
from pyspark.sql import functions as F

from warnloom.functions import indicators as I, names as N, scans, timeline as D
from warnloom.operators import text as T
from warnloom.operators.narrative import summarize, with_sentences
from warnloom.plans.analyze import analyze_reports

TEXTS = [
    "", "x", "Viſta. WİNDOWS and wındows and Lİnux.", "EMOTET?! cve-2024-1000 at 1.2.3.4... End.", "a" * 31 + " " + "b" * 32, "On 3 March 2024. Then ٥/١/٢٠. 2024-01-02)\" x.",
    "A..b. .c.\x85d?　e!\") f", " ".join(f"Word {i} of ransomware text here. Plain words go on and on." for i in range(9)), "﷐ 2024-01-01. May 5 2024﷐x",
]


@pytest.mark.parametrize("guarded,pattern", [(N.names_in, N.NAMES), (I.cves, I.CVE), (I.ipv4, I.IPV4), (I.hashes, I.HASH)])
def test_guards_lose_no_match(report, guarded, pattern):
    df = report(*TEXTS)
    rows = df.select(guarded(F.col("text")).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_sentences_dates_and_summaries_are_those_of_the_columns(report):
    df = report(*TEXTS)
    for r in with_sentences(df).collect():
        assert r.sentences == scans._sentences(r.text)
    whole = F.filter(F.transform(D.sentences(D.mark_dates(F.col("text"))), lambda s: F.struct(D.unmark(s).alias("sentence"), D.marked_dates(s).alias("dates"))), lambda x: F.size(x["dates"]) > 0)
    for r in df.select(D.dated_sentences(F.col("text")).alias("a"), whole.alias("b")).collect():
        assert [(x.sentence, x.dates) for x in r.a] == [tuple(x) for x in r.b]
    for n in (1, 4):
        assert [r.summary for r in summarize(df, n).orderBy("report_id").collect()] == [r.summary for r in summarize(with_sentences(df), n).orderBy("report_id").collect()]


def test_the_analysis_tries_few_patterns_on_every_text(report):
    plan = analyze_reports(T.clean_text(report("x")))._jdf.queryExecution().optimizedPlan().toString()
    # Keywords, words and sentences are scanned in Python; nothing is cut into sentences by a pattern.
    assert "BatchEvalPython" in plan and "regexp_count" not in plan and "wannacry" in plan


EDGES = [
    None, "", "wıde eMOTET,emotet EMOTETs\nemotet́ cobalt strike windowsemotet windows", "CVE-2024-1234567 cve-2024-12345678 xCVE-2024-1111 Cve-2023-28252cve-2023-28253 cve-٢٠٢٤-1000,cve-2024-100",
    "a@b.co, a@b.co;x@y.org\x85@ @@ a@b.c q@r.com.@s.de", "a..b.com .c.net. x.com.y z.org\nfoo.bar.ru/x-y.com é.com a.comé", "a" * 65 + " " + "0" * 40 + "," + "F" * 64 + "\x1c" + "b" * 32 + "é",
    "On 3 March 2024. In Auguﬆ 2024. 3 Auguſt 2024 here. MAY 5, 2024! Room 2024 is free. 1/2/24? 5 mAy 2023.", "HXXPS://x.com hXxp://y.net ahxxp:// xxp",
]


@pytest.mark.parametrize("guarded,pattern,group", [(N.names_in, N.NAMES, 0), (I.cves, I.CVE, 0), (I.hashes, I.HASH, 0), (I.emails, I.EMAIL, 1), (I.domains, I.DOMAIN, 1)])
def test_parts_of_a_text_lose_no_match(report, guarded, pattern, group):
    df = report(*TEXTS, *EDGES)
    whole = F.regexp_replace("text", r"\.(?=\.)", ". ") if guarded is I.domains else F.col("text")
    rows = df.select("text", guarded(F.col("text")).alias("a"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(group)).alias("b")).collect()
    assert all((r.a or []) == (r.b or []) for r in rows) and sum(len(r.a or []) for r in rows) > 2


def test_words_and_dates_are_those_of_patterns(report):
    texts = [t for t in TEXTS + EDGES if t]
    assert [scans.count_words(t) for t in texts] == [len(scans._WORDS.findall(t)) for t in texts]
    for r in report(*texts).select("text", D.dated_sentences(F.col("text")).alias("a"), D.dated_sentences(F.col("text"), undated=True).alias("b")).collect():
        assert r.a == [x for x in r.b if x.dates]
    assert T.refang(report(EDGES[-1])).first().text == "https://x.com http://y.net ahxxp:// xxp"


def test_patterns_read_parts_of_a_text_only(report):
    df = report("x").select("text", N.names_in(F.col("text")).alias("a"), I.cves(F.col("text")).alias("b"), I.emails(F.col("text")).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(pythonUDF" in plan and "regexp_extract_all(text" not in plan


@pytest.mark.parametrize("phrases", [["c2", "ip ", "apt", "cve-", "zero day", "x"], ["emotet", *"abcdef"]])
def test_candidates_leave_out_no_phrase(phrases):
    find = scans._candidates(phrases)
    texts = [t.lower() for t in [*TEXTS, *EDGES, "c2", "ap", "apt", "zero dayé", "ip x"] if t]
    assert all({k for k in phrases if k in t} <= set(find(t)) for t in texts)
    assert scans._candidates(["emotet"] * 6)("emote motel") == [] and find("") == [k for k in phrases if len(k) < 3]
