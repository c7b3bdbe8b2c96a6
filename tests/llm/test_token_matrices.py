"""Packed matrices: an exact round trip, and the tree against a plain search."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from warnloom.llm.token_matrices import CapacityTree, encoder, pack_rows, packed_matrices, unpack  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_tree_equals_a_plain_search():
    rng = random.Random(1)
    tree, there = CapacityTree(100), set()
    for _ in range(3000):
        space = rng.randint(0, 100)
        if rng.random() < 0.5:
            tree.set(space, True)
            there.add(space)
        else:
            tree.set(space, False)
            there.discard(space)
        size = rng.randint(0, 100)
        assert tree.least(size) == min((s for s in there if s >= size), default=None)


def test_rows_hold_their_pieces():
    rng = random.Random(2)
    sizes = [rng.randint(0, 50) for _ in range(500)]
    rows = pack_rows(sizes, 50)
    assert sorted(i for row in rows for i in row) == list(range(500))
    assert all(sum(sizes[i] for i in row) <= 50 for row in rows)
    assert len(rows) <= 1.1 * sum(sizes) / 50 + 1


def test_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", "x", "ünï 漢字 " * 900] + [" ".join(rng.choice(["the", "token", "é", "42", "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "again", "y"), (7, "again", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING").repartition(3)
    got, back = packed_matrices(docs, RANKS, length=64, rows_each=8).collect(), defaultdict(list)
    assert len({r.matrix_id for r in got}) == len(got)
    for r in got:
        assert len(r.ids) == len(r.positions) == 2 * r.n_rows * 64 and r.cu_seqlens[-1] == r.n_rows * 64
        flat = np.frombuffer(bytes(r.positions), np.uint16)
        assert all((flat[a:b] == np.arange(b - a)).all() for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
        for doc, start, ids in unpack(r):
            back[doc].append((start, ids.tolist()))
    encode = encoder(RANKS).encode_ordinary
    want = Counter((d, i) for d, t, _ in rows for i in [tuple(encode(t or ""))] if rows.count((d, t, _)) == 1)
    for (doc, ids), _ in want.items():
        if doc != 7:
            assert tuple(x for _, part in sorted(back[doc]) for x in part) == ids
    assert len(back[7]) >= 3 and sum(p == encode("again") for _, p in back[7]) == 2
    assert packed_matrices(docs.limit(0), RANKS).count() == 0
