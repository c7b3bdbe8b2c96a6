"""The pipeline against a plain version of its decisions on a small fixture."""

import random

import pytest

import corpus_pipeline
from test_decontaminate import best
from test_jaccard_join import brute
from test_line_dedup import distance
from test_quality_rules import plain
from warnloom.sources.staging import stage


def fixture():
    rng = random.Random(21)
    words = [f"word{i}" for i in range(2000)]
    line = lambda n=12: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(25)) for i in range(4)]
    common, docs = line(), []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(5, 9))]
        if i % 5 == 0:
            lines.insert(1, common)
        if i % 7 == 0:
            lines.insert(2, items[i % 4][1])
        if i % 11 == 10:
            lines = [lines[0]] * 9
        if i % 6 == 5 and docs:
            lines = [x + ("" if k % 4 else " word7q") for k, x in enumerate(docs[-1][1].split("\n"))]
        docs.append((i, "\n".join(lines), "en", "s", 0))
    docs.append((60, docs[0][1].replace("\n", " "), "en", "s", 0))
    return docs, items


def lines_left(docs):
    first, out = {}, []
    for d, t, *_ in docs:
        for p, x in enumerate(t.split("\n")):
            if len(x) >= 20:
                first.setdefault(x, (d, p))
    alike = lambda x, y: abs(len(x) - len(y)) <= 2 and len({*x.split()} & {*y.split()}) > 4  # noqa: E731  two edits touch four words at most
    near = {x for x in first for y in first if x != y and first[y] < first[x] and alike(x, y) and distance(x, y) <= 2}
    for d, t, *rest in docs:
        kept = [x for p, x in enumerate(t.split("\n")) if len(x) < 20 or (x not in near and first[x] == (d, p))]
        if kept:
            out.append((d, "\n".join(kept), *rest))
    return out


def test_stages_equal_the_plain_version(spark, tmp_path):
    docs, items = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    want = [d for d in docs if not plain(d[1])[-1]]
    steps = [want]
    steps.append(lines_left(steps[-1]))
    groups = {d: c for d, _, c in brute(steps[-1], 5, 80)}
    steps.append([d for d in steps[-1] if groups[d[0]] == d[0]])
    steps.append([d for d in steps[-1] if not any(best(d[1], x) >= 0.8 for _, x in items)])
    assert len(docs) > len(steps[0]) > len(steps[2]) > len(steps[3]) and steps[0] != steps[1]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, function), expected in zip(corpus_pipeline.STAGES, steps):
        now = stage(function(spark, now, sf), "test")
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(d[:2] for d in expected), name
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.n_tokens) for r in packed} == {(d, len(t.split())) for d, t, *_ in steps[-1]}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_odd_and_no_rows(spark, tmp_path, k):
    sf = str(tmp_path)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 20_000, "fr", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{sf}/labels.parquet")
    function = corpus_pipeline.STAGES[k][1]
    assert function(spark, docs, sf).count() == {0: 0, 4: 8}.get(k, 4)
    assert function(spark, docs.limit(0), sf).count() == 0
