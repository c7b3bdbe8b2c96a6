"""Repeated byte strings against plain search; the suffix collection against sorting."""

import hashlib
import random

import numpy as np
import pytest

from warnloom.llm import suffix_dedup as S

SCHEMA = "doc_id BIGINT, text STRING, block INT, spans STRING, kept INT"


@pytest.mark.parametrize("most", [2, 50])
def test_collection_is_the_sorted_suffixes(most):
    rng = random.Random(most)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, rng.choice([3, 12, 40])))) for _ in range(rng.randint(1, 25))]
        built = S.Collection(strings, most)
        suffixes = sorted(((s[len(s) - k :], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: x[:2])
        assert list(zip(built.string.tolist(), built.size.tolist())) == [x[1:] for x in suffixes]
        same = lambda a, b: next((n for n in range(most) if n >= min(len(a), len(b)) or a[n] != b[n]), most)
        assert built.lcp.tolist() == [0] + [same(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
        letters = [None, *built.alphabet.tolist()]
        assert [letters[x] for x in built.bwt.tolist()] == [strings[i][len(strings[i]) - k - 1] if k < len(strings[i]) else None for _, i, k in suffixes]


def expected(rows, length):
    first = {}
    keyed = [((1, 0) if i is None else (0, i), (t or "").encode()) for i, t in rows]
    for key, data in keyed:
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for (i, _), (key, data) in zip(rows, keyed):
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < key:
                gone[k : k + length] = [True] * length
        spans, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = end + 1
        out.append((i, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def check(spark, rows, length=50, parts=3):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in S.repeated_spans(table, length).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(rows, length)))
    return table, found


def words(rng, n):
    return " ".join(rng.choice(["alpha", "be", "gamma", "délta", "e"]) for _ in range(n))


def test_passages_copies_nulls_and_edges(spark):
    rng = random.Random(5)
    passage, other = words(rng, 40), words(rng, 15)
    rows = [(i, words(rng, rng.randint(0, 60)) + (passage if i % 3 else passage[:49] + other) + words(rng, rng.randint(0, 20))) for i in range(40, 0, -1)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(100, rows[0][1]), (100, rows[0][1]), (None, rows[3][1]), (None, None), (7, ""), (8, None)]
    rows += [(-5, "x" * 400), (200, "x" * 1000), (201, "x" * 49), (202, passage[:50]), (203, passage[1:50]), (204, other * 2)]
    table, found = check(spark, rows)
    report = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedupe_report(table).collect()}
    assert report == {(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in found}


@pytest.mark.parametrize("length, frequent", [(3, 3), (8, 20_000), (20, 5)])
def test_many_chance_repeats(spark, monkeypatch, length, frequent):
    monkeypatch.setattr(S, "SHARD_CODES", 50)
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 40)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "COLLECTION", 7)
    rng = random.Random(length)
    check(spark, [(rng.randint(1, 25), words(rng, rng.randint(0, 30))) for _ in range(40)], length)


def test_segments_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, n).encode() for n in (0, 90, 3, 400, 0, 12, 1)] + [b"x" * 700]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    read = lambda: {(a + k, c) for a, n, c, _ in zip(*(x.tolist() for x in S.segments(data, ends, 50, 24))) for k in range(n)}
    whole = read()
    assert {a for a, _ in whole} == {e - len(t) + k for t, e in zip(texts, ends.tolist()) for k in range(len(t) - 49)}
    monkeypatch.setattr(S, "SLICE", 33)
    assert read() == whole


def test_small_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    rng = random.Random(9)
    long = words(rng, 3000)
    check(spark, [(1, long[200:900]), (2, long), (3, long[5000:]), (4, long[:100] + long[400:700])])


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert S.dedupe_report(table).collect() == []
    check(spark, [(1, None), (2, "")])
