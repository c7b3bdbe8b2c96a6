"""Rules by a caller's lexicon against plain search."""

import random
import re

import pytest

from warnloom.operators import lexicon as L

SCHEMA = "label STRING, ord INT, keyword STRING, kw_ord INT"
ROWS = [
    ("spill", 0, "Oil", 2), ("spill", 0, "oil slick", 1), ("spill", 0, "oil", 5), ("fire", 1, "fire", 1), ("fire", 1, "smoke", 2),
    ("fire", 1, "ash", 3), ("quake", 2, "ash", 1), ("quake", 2, "é", 2), ("none", 3, "", 1), ("none", 3, None, 2), ("none", 3, "zzz", 3),
]
WORDS = ["an OIL slick", "boil", "Fire!", "smoke", "crash.", "É", "calm day", "sea.", "zz z", "\n"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(60)] + ["", None, "x oil " * 30_000]


def found(text):
    """label -> (ord, its keywords in order) where any is found."""
    low, out = (text or "").lower(), {}
    for label, order, keyword, place in ROWS:
        if keyword and keyword.lower() in low:
            words = out.setdefault(label, (order, {}))[1]
            words[keyword.lower()] = min(place, words.get(keyword.lower(), place))
    return {label: (order, sorted(words, key=words.get)) for label, (order, words) in out.items()}


def test_scores_and_best_label(spark, report, lexicon, texts):
    got = {(r.report_id, r.label): r.score for r in L.lexicon_scores(report(*texts), lexicon).collect()}
    labels = {r[0]: r[1] for r in ROWS}
    assert got == {(i, label): len(found(t).get(label, (0, []))[1]) for i, t in enumerate(texts, 1) for label in labels}
    best = {r.report_id: r.label for r in L.classify_by_lexicon(report(*texts), lexicon, unknown="?").collect()}
    for i, t in enumerate(texts, 1):
        scores = found(t)
        assert best[i] == (min(scores, key=lambda x: (-len(scores[x][1]), labels[x])) if scores else "?")


def test_tier_and_ranking(spark, report, lexicon, texts):
    tiers = {r.report_id: (r.label, r.reason) for r in L.lexicon_tier(report(*texts), lexicon, "low").collect()}
    ranked = {}
    for r in L.lexicon_ranking(report(*texts), lexicon).collect():
        ranked.setdefault(r.report_id, []).append((r.pos, r.label, r.matched_keywords, r.hits))
    for i, t in enumerate(texts, 1):
        hits = found(t)
        first = min(hits, key=lambda x: hits[x][0], default=None)
        assert tiers[i] == (("low", None) if first is None else (first, "keywords: " + ", ".join(hits[first][1][:4])))
        order = sorted(hits, key=lambda x: (-len(hits[x][1]), hits[x][0]))
        assert sorted(ranked.get(i, [])) == [(k, x, hits[x][1], len(hits[x][1])) for k, x in enumerate(order)]


def test_parts_give_the_same(spark, report, lexicon, texts):
    read = lambda most: sorted((r.report_id, [tuple(h) for h in r.lexicon_hits]) for r in L.with_hits(report(*texts), lexicon, most=most).collect())
    assert read(3) == read(1000)


def test_sentences(spark, report, lexicon):
    text = "An oil slick met the smoke today. Nothing else was seen by anyone there. Short one. Ash and ash fell on É again."
    rows = sorted((r.sent_idx, r.hits) for r in L.score_sentences_by(report(text), lexicon).collect())
    assert rows == [(0, 3), (1, 0), (3, 2)]
    assert rows == sorted((r.sent_idx, r.hits) for r in L.score_sentences_by(report(text), lexicon, most=2).collect())


def test_empty_lexicon_and_table(spark, report, lexicon):
    none = spark.createDataFrame([], SCHEMA)
    assert [r.label for r in L.classify_by_lexicon(report("oil"), none, unknown="?").collect()] == ["?"]
    assert L.lexicon_scores(report("oil"), none).collect() == [] and L.lexicon_ranking(report("oil"), none).collect() == []
    assert [r.hits for r in L.score_sentences_by(report("There is oil in the sea."), none).collect()] == [0]
    assert L.lexicon_scores(report("oil").limit(0), lexicon).collect() == []


def test_no_join_or_shuffle(spark, report, lexicon):
    plan = L.with_hits(report("oil"), lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Join|Exchange", plan)
