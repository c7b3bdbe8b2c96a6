"""The Merkle manifest against a plain recursive build."""

import hashlib
import zlib

import pytest

from warnloom.llm.merkle import COLUMNS, verify_documents

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, digest STRING, tree STRING, idx INT, _place INT"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def climb(leaves, fan):
    """The root, and for every leaf its siblings as (before, after) by level."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        parents, below = [], []
        for s in range(0, len(nodes), fan):
            run = nodes[s : s + fan]
            for k in range(len(run)):
                for i in under[s + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha("".join(run)))
            below.append(sum(under[s : s + fan], []))
        nodes, under = parents, below
    return nodes[0], paths


def expected(rows, fan):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for x in langs}
    trees = {x: climb([leaf_of(r) for r in order[x]], fan) for x in langs}
    root, over = climb([trees[x][0] for x in langs], fan)
    out = []
    for x, top in zip(langs, over, strict=True):
        for row, path in zip(order[x], trees[x][1], strict=True):
            path, leaf = path + top, leaf_of(row)
            node, text = leaf, row["text"]
            if zlib.crc32(("" if row["doc_id"] is None else str(row["doc_id"])).encode()) % 3 == 0 and text is not None:
                node = leaf_of(row | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in text)})
            for before, after in path:
                node = sha(before + node + after)
            out.append((row["doc_id"], leaf, trees[x][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def rows_of(*rows):
    return [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in rows]


def check(spark, rows, fan=8):
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    read = verify_documents(table, fan)
    assert read.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in read.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(rows, fan)))
    return found


def test_many_trees_of_different_heights(spark):
    rows = [(i, f"Text {i}\nÄÖ", lang, "s", i, "x", "y", 1, 2) for lang, n in [("en", 75), ("de", 9), ("fr", 8), ("es", 1), ("", 2), (None, 17), ("zz", 64)] for i in range(n * 3, 0, -3)]
    found = check(spark, rows_of(*rows))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("fan", [2, 3])
def test_other_fans(spark, fan):
    check(spark, rows_of(*[(i, f"A{i}", "en" if i % 5 else None, None, None, None, None, None, None) for i in range(19)]), fan)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(7, "Same", "en", "a", 4, "d", "t", 0, 0)] * 20
    rows += [(7, "Other of the same id", "en", "a", 4, "d", "t", 0, 0), (None, "No id", "en", None, None, None, None, None, None), (None, None, "en", None, None, None, None, None, None)]
    rows += [(9, None, None, None, None, None, None, None, None), (12, "", None, "", 0, "", "", 0, 0), (-3, "Long " * 200_000, "de", "b", 1_000_000, "", "", 0, 0)]
    check(spark, rows_of(*rows))


def test_one_row_and_none(spark):
    ((_, leaf, subroot, root, proof, _, _),) = check(spark, rows_of((1, "Alone", "en", "s", 5, "", "", 0, 0)))
    assert leaf == subroot == root and proof == sha("")
    assert verify_documents(spark.createDataFrame([], SCHEMA)).collect() == []
