"""Ranked search against scoring every document."""

import math
import random
import re

import pytest

from warnloom.llm import lexical as L

SCHEMA = "doc_id BIGINT, text STRING, item STRING, n INT, m INT, rank INT"
ITEMS = "item_id BIGINT, text STRING, doc_id STRING, score INT"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, top=10):
    cut = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for doc, t in cut:
            score = 0
            for term in set(terms(text)):
                tf, df = t.count(term), sum(term in x for _, x in cut)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + 90 * len(t) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, **options):
    table = spark.createDataFrame([(*d, "x", 1, 2, 3) for d in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS)
    read = L.ranked_search(table, asked, **options)
    assert read.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in read.collect()], key=repr) == expected(docs, items, options.get("top", 10))


def text(rng, n):
    return "".join(rng.choice(["Ab", "b", "çé", "d2", "e", "f-g", "H", "zz\x7f"]) + rng.choice([" ", "\n", ", ", "_", "é "]) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 15])
def test_scores_ties_nulls_and_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_POSTINGS", block)
    rng = random.Random(block)
    docs = [(i, text(rng, rng.choice([0, 1, 3, 8, 8, 8, 30]))) for i in rng.sample(range(1000), 60)]
    docs += [(2000 - i, "ab b h") for i in range(25)] + [(7, "ab e"), (7, "ab e"), (None, "ab b h"), (None, None), (3000, ""), (3001, "... ---"), (3002, "ab " * 20_000)]
    items = [(1, "AB b, h"), (2, "zz çé"), (2, "other text of the same id: e"), (3, None), (4, ""), (5, "unknown"), (6, "ab ab ab"), (6, "ab ab ab"), (None, "f-G d2")]
    check(spark, docs, items)
    check(spark, docs[:30], items, top=3)


def test_rounds_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ROUND_BYTES", 60)
    rng = random.Random(1)
    check(spark, [(i, text(rng, 12)) for i in range(40)], [(i, text(rng, 4)) for i in range(8)])


def test_floors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "FIRST_VISITS", 1)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))) for i in range(200)]
    check(spark, docs, [(i, " ".join(rng.sample("abcdefgh", 3))) for i in range(6)])


def test_no_documents_or_items(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a")], [])
    check(spark, [(1, None), (2, "...")], [(1, "a")])
