"""Line removal against brute force, and the bit-parallel test against plain edit distance."""

import random

import pytest
from pyspark.sql import functions as F

from warnloom.llm.line_dedup import dedupe_lines, drop_repeated_lines, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        line[at : at + rng.choice([0, 1])] = rng.choice([[], ["q"], ["é"]])
    return "".join(line)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_band_equals_edit_distance(spark, most):
    rng, pairs = random.Random(most), []
    for _ in range(400):
        a = "".join(rng.choice("abé漢") for _ in range(rng.randint(0, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    got = spark.createDataFrame(pairs, "a STRING, b STRING").coalesce(1).select(within(F.col("a"), F.col("b"), most).alias("near")).collect()
    assert [r.near for r in got] == [distance(a, b) <= most for a, b in pairs]


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 60))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 6))]
        docs.append((rng.choice([i, i, None]) if i > 50 else i, "\n".join(lines), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (3, docs[3][1], "x"), (102, "short\nshort\n" + base[0] + "\n\n" + base[0], "x")]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, hash STRING")
    got = {(r.doc_id, r.hash, r.before): (r.text, r.lines_removed) for r in dedupe_lines(frame.withColumn("before", F.col("text"))).collect()}
    order = {(d, t): (d if d is not None else 1 << 63, spark.range(1).select(F.xxhash64(F.lit(d).cast("bigint"), F.lit(t))).first()[0]) for d, t, _ in docs if d is None}
    first: dict[str, tuple] = {}
    for d, t, _ in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if len(line) >= 20:
                at = (*order.get((d, t), (d, 0)), pos)
                first[line] = min(first.get(line, at), at)
    near = {x for x in first for y in first if x != y and first[y] < first[x] and distance(x, y) <= 2}
    assert len(near) > 20
    for d, t, _ in docs:
        kept = [line for pos, line in enumerate((t or "").split("\n")) if len(line) < 20 or (line not in near and first[line] == (*order.get((d, t), (d, 0)), pos))]
        want = None if t is None else "\n".join(kept)
        assert got[d, "x", t] == (want, len((t or "").split("\n")) - len(kept)), (d, t)


def test_stage_drops_emptied_documents_and_keeps_columns(spark):
    line = "a line that is long enough to count here"
    docs = spark.createDataFrame([(1, line, "en", "s", 1), (2, line, "en", "s", 1), (3, "", "en", "s", 0), (4, None, None, None, None)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    got = drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.n_chars) for r in got.collect() if r.doc_id < 4) == [(1, len(line)), (3, 0)] and got.count() == 3
    assert dedupe_lines(docs.limit(0)).count() == 0


def test_caller_columns_of_our_names_stay(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, line, 5, "x", 7), (2, f"{line}\nother", 6, "y", 8)], "doc_id BIGINT, text STRING, _gone INT, _key STRING, _lines INT")
    got = sorted(tuple(r) for r in dedupe_lines(docs).collect())
    assert got == [(1, line, 5, "x", 7, 1, 0), (2, "other", 6, "y", 8, 2, 1)]
    named = spark.createDataFrame([(1, line, 5, "x"), (2, line, 6, "y")], "doc_id BIGINT, text STRING, n_lines INT, lines_removed STRING")
    assert [tuple(r) for r in drop_repeated_lines(named).collect()] == [(1, line, 5, "x")]
