"""Packing: nothing lost, nothing over capacity, and close to the tokens' own cost."""

import random
from collections import defaultdict

import pytest

from warnloom.llm.packing import CAPACITIES, best_fit_packing, cost, pack_documents, pack_lengths


def test_plan_is_valid_and_no_dearer_than_single_sizes():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.choice([0, 1, 5, 256, 257, rng.randint(1, 4096)]) for _ in range(rng.randint(0, 200))]
        bins = pack_lengths(sizes)
        assert sorted(i for _, members in bins for i in members) == list(range(len(sizes)))
        for capacity, members in bins:
            held = sum(sizes[i] for i in members)
            assert held <= capacity and capacity == min(c for c in CAPACITIES if c >= held)
        for only in CAPACITIES[-1:]:
            single = pack_lengths(sizes, (only,))
            assert sum(cost(c) for c, _ in bins) <= sum(cost(c) for c, _ in single)


def brute_optimum(sizes, capacities):
    best = [float("inf")]

    def go(i, held):
        if i == len(sizes):
            best[0] = min(best[0], sum(cost(min(c for c in capacities if c >= h)) for h in held))
            return
        for k in range(len(held)):
            if held[k] + sizes[i] <= max(capacities):
                go(i + 1, [*held[:k], held[k] + sizes[i], *held[k + 1 :]])
        go(i + 1, [*held, sizes[i]])

    go(0, [])
    return best[0]


def test_near_the_optimum_of_small_cases():
    rng = random.Random(4)
    for _ in range(40):
        sizes = [rng.randint(1, 60) for _ in range(6)]
        got = sum(cost(c) for c, _ in pack_lengths(sizes, (16, 32, 64)))
        assert got <= 1.35 * brute_optimum(sizes, (16, 32, 64))


@pytest.mark.parametrize("same", [False, True])
def test_every_token_has_one_place(spark, same):
    rng = random.Random(6)
    rows = [(1, 700)] * 9000 if same else [(rng.choice([None, i]), rng.choice([None, 0, 3, 5000, 8192, rng.randint(1, 9000)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, n_tokens INT")
    got = best_fit_packing(docs).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert sum(r.piece == 0 for r in got) == len(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_start, r.n_tokens)):
            assert r.bin_start == at
            at += r.n_tokens
        assert len({r.capacity for r in members}) == 1 and at <= members[0].capacity in CAPACITIES
    used = sum(r.n_tokens for r in got) / sum(m[0].capacity for m in bins.values())
    assert used > (0.65 if same else 0.9)


def test_documents_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (1, "a b c", 9), (2, None, 0), (None, "", 0), (3, "w " * 5000, 0)], "doc_id BIGINT, text STRING, bin_id INT")
    got = pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.n_tokens) for r in got) == [(0, 0, 0, 0), (1, 0, 0, 3), (1, 0, 0, 3), (2, 0, 0, 0), (3, 0, 0, 4096), (3, 1, 4096, 904)]
    assert pack_documents(docs.limit(0)).count() == 0
