"""Leaks against brute force over every window, and planted copies."""

import random
import re
from collections import Counter

from warnloom.llm.decontaminate import drop_leaks, find_leaks

WORDS = [f"w{i}" for i in range(300)]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def best(text, item):
    ws, iw = words(text), words(item)
    b, top = grams(iw), 0.0
    for s in range(len(ws)):
        a = grams(ws[s : s + len(iw)])
        n = sum((a & b).values())
        top = max(top, n / (sum(a.values()) + sum(b.values()) - n)) if n else top
    return top


def corpus():
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 50)))) for i in range(12)]
    items += [(50, None), (51, ""), (3, items[3][1])]
    docs = []
    for i in range(120):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        item = items[i // 2 % 12][1].split()
        if i % 2 == 0:
            for _ in range(rng.randint(0, 2)):  # changed, lost and added words
                at = rng.randrange(len(item))
                item = [*item[:at], *rng.choice([["zz"], [item[at], "yy"], []]), *item[at + 1 :]] or ["zz"]
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 2 else ", ".join(body), "en", i))
    docs += [(None, None, None, 0), (200, "", "en", 0), (0, docs[0][1], "en", 0)]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, similarity INT")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(frame, bench).collect()}
    want = {(d, i): s for d, text, *_ in docs for i, item in items for s in [best(text, item)] if s >= 0.8}
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    clean = drop_leaks(frame, bench)
    assert clean.columns == frame.columns
    leaky = {d for d, _ in want}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, *_ in docs if d not in leaky), key=str)


def test_runs_of_one_word_lose_nothing(spark):
    """Similarity of just 0.8, and all that differs is one repeated shingle: fingerprints are far apart there."""
    rng = random.Random(3)
    items, docs = [], []
    for i in range(60):
        same = [f"v{i}x{rng.randrange(10**6)}" for _ in range(100)]
        items.append((i, " ".join(same + ["uu"] * 12)))
        docs.append((i, " ".join(same + [f"t{i}"] * 12), i))
    assert all(abs(best(d[1], x[1]) - 0.8) < 1e-9 for d, x in zip(docs, items))
    got = find_leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, w INT"), spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(60)}
    assert max(r.hamming for r in got) > 19


def test_long_texts_ties_and_caller_columns(spark):
    rng = random.Random(4)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    filler = " ".join(rng.choice(WORDS) for _ in range(30_000))
    docs = [(1, f"{filler} {item} {filler} {item}", "a", "b"), (2, filler, "c", "d")]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, _key STRING, row STRING")
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    (found,) = find_leaks(frame, bench).collect()
    assert (found.doc_id, found.start, found.similarity) == (1, 30_000, 1.0)  # of equal windows the first
    assert [tuple(r) for r in drop_leaks(frame, bench).collect()] == [docs[1]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id BIGINT, text STRING")
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == 1
    assert drop_leaks(docs, bench).count() == 0
