"""The language model against a plain version, and its compact lists."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from warnloom.llm import ngram_lm
from warnloom.llm.ngram_lm import LEVELS, Bigrams, EliasFano, NgramTrie, Pairs, language_model, mapped_answers, merged_trie, planes
from warnloom.llm.words import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
@pytest.mark.parametrize("most", [1 << 10, 1 << 40, (1 << 63) - 1])
def test_compact_list(n, most):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, most, n).astype(np.uint64))
    packed = EliasFano.of(values)
    assert (packed.values() == values).all()
    asked = np.concatenate([values, rng.integers(0, most, 50).astype(np.uint64), np.array([0, most], np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert packed.search(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_trie_and_its_files(tmp_path):
    rng = np.random.default_rng(1)
    codes = np.unique((rng.integers(0, 40, 2000).astype(np.uint64) << np.uint64(50)) | rng.integers(0, 1 << 20, 2000).astype(np.uint64))
    counts = rng.integers(1, 2000, len(codes))
    trie = NgramTrie.of(codes, counts)
    trie.save(str(tmp_path))
    asked = np.concatenate([codes, codes + np.uint64(1 << 21)])
    for t in (trie, NgramTrie.open(str(tmp_path))):
        got = LEVELS[t.ask(asked)]
        assert (got[len(codes) :] == 0).all() and (got[: len(codes)] <= counts).all() and (got[: len(codes)] > counts / 1.11 - 1).all()
        assert (got[: len(codes)][counts < 128] == counts[counts < 128]).all()


def test_shards_answer_from_mapped_levels(monkeypatch, tmp_path):
    contexts = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 50).astype(np.uint64))
    pairs = Pairs.of(np.repeat(contexts, 3), np.tile(np.array([1, 5, 9], np.uint64), 50))
    counts = np.arange(150, dtype=np.uint32)
    kinds = []
    ask = NgramTrie.ask_words

    def watched(trie, *args):
        kinds.extend(type(x) for x in (trie.counts, trie.contexts.low, trie.contexts.high, trie.pointers.high, trie.successors.low))
        return ask(trie, *args)

    monkeypatch.setattr(ngram_lm.tempfile, "tempdir", str(tmp_path))
    monkeypatch.setattr(NgramTrie, "ask_words", watched)
    told, n = mapped_answers([(pairs, counts), (pairs, counts)])
    assert n == 149 and all((LEVELS[x] == 2 * counts).all() for x in told)
    assert set(kinds) == {np.memmap} and not list(tmp_path.iterdir())
    assert mapped_answers([(pairs, 0 * counts)])[1] == 0


def test_counts_of_any_size_are_close():
    counts = np.array([1, 4095, 4096, 23_124_960, 30_000_000, 7 * 10**12, 2**62])
    got = LEVELS[NgramTrie.of(np.arange(1, 8, dtype=np.uint64), counts).ask(np.arange(1, 8, dtype=np.uint64))]
    assert (got[:3] == counts[:3]).all() and (abs(got / counts - 1) < 0.0006).all()


def test_pointers_bound_the_successors_of_a_context():
    codes = np.array([1 << 40, 1 << 40 | 7, 2 << 40, 2 << 40 | 7, 5 << 40 | 7], np.uint64)
    trie = NgramTrie.of(codes, np.arange(1, 6), 40)
    assert trie.ask(np.append(codes, np.uint64(3 << 40))).tolist() == [1, 2, 3, 4, 5, 0]
    trie.pointers = EliasFano.of(np.array([0, 1, 4, 5], np.uint64))
    assert trie.ask(codes).tolist() == [1, 0, 3, 4, 5]


def test_more_contexts_than_a_million_and_a_frequent_successor():
    # "the" and the end follow half of the words; the other half has its own successors, and none of "the".
    n = 600_000
    words = ["the", *[f"w{i}" for i in range(2 * n)]]
    even, odd = np.arange(1, 2 * n, 2), np.arange(2, 2 * n + 1, 2)
    seen = np.column_stack([even, np.zeros(n, np.int64), odd, odd]).reshape(-1)  # even the odd odd
    unseen = np.column_stack([odd, np.zeros(n, np.int64)]).reshape(-1)  # odd the
    flat = np.concatenate([seen, unseen]).astype(np.uint32)
    row = {"sizes": [len(seen), len(unseen)], "words": words, "tokens": planes(flat)}
    trained = np.repeat([True, False], [len(seen) + 1, len(unseen) + 1])
    shards = 2
    grams = Bigrams(row, shards)
    counts = np.bincount(grams.inverse[trained], minlength=grams.sizes[1]).astype(np.uint32)
    level = np.zeros(grams.sizes[1], np.uint16)
    for at in grams.members[1]:
        pairs = Pairs.of(grams.contexts[at], grams.words[at])
        again = Pairs.read(*pairs.columns(), len(pairs.contexts), len(at))
        assert (again.contexts == pairs.contexts).all() and (again.words == pairs.words).all() and (again.at == pairs.at).all()
        level[at] = merged_trie([(again, counts[at])]).ask_words(again.contexts, again.at, again.words)
    assert (LEVELS[level] == counts).all()
    assert len(np.unique(grams.contexts)) > 1 << 20


def plain(rows):
    cut = [((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, t, *_ in rows]
    cut = [[w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t).split(" ") if w] for t in cut]
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1 for d, *_ in rows]
    uni, big, ctx = Counter(), Counter(), Counter()
    for words, h in zip(cut, held):
        if not h:
            uni.update([*words, None])
            big.update(zip([None, *words], [*words, None]))
            ctx.update([None, *words])
    n, v = sum(uni.values()), len(uni)
    b = math.log(v) / math.log(n) if v > 1 and n > 1 else 0.5
    out = []
    for (d, *_), words, h in zip(rows, cut, held):
        base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
        score = 0.0
        for c, w in zip([None, *words], [*words, None]):
            m = max(ctx[c], 1) ** b
            k = LEVELS[np.searchsorted(LEVELS, big[c, w], "right") - 1]
            score += math.log10((k + m * base(w)) / (ctx[c] + m))
        toks = [*words, None]
        out.append((d, h, len(toks), sum(uni[w] > 0 for w in toks), n, sum(math.log10(base(w)) for w in toks), score))
    return out


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(3)
    words = ["the", "The", "é", "É", "漢", "a.b", "x", " y"] + [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice([" ", "\n", "\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 50))), 1) for i in range(150)]
    rows += [(None, None, 1), (5, "", 1), (200, "w1 " * 5000, 1), (200, "w1 " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score INT").repartition(3)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, language_model(docs).collect()), key=key), sorted(plain(rows), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)
    assert language_model(docs.limit(0)).count() == 0
    assert language_model(docs.filter("doc_id = 5")).count() >= 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_texts_are_likelier_than_by_single_words(spark):
    got = language_model(table(spark, SF_DIR, "documents")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
