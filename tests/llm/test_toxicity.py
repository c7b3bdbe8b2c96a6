"""The clause machine, learning, and held-out accuracy."""

import os

import pytest
from pyspark.sql import functions as F

from warnloom.llm.toxicity import CLAUSE, CONTEXTS, Grammar, compose, flag_machine, negation_machine, toxicity, TARGET
from warnloom.llm.words import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_product_has_all_states():
    both = compose(negation_machine(2), flag_machine(TARGET))
    assert len(both.mark) == 6 and len(CLAUSE.mark) == 16


def test_context_of_the_clause_counts():
    grammar = Grammar({"moron": 2.0})
    at = lambda text: [i for i, v in enumerate(grammar.features(text)[:CONTEXTS]) if v]
    assert at("a morons thing") == [0]
    assert at("not a moron") == [1]
    assert at("it was called moron") == [2]
    assert at("moron, that is what you are") == [3]
    assert at("you are not. A moron") == [0]
    assert at("you are not a moron") == [4]
    assert at("nothing here") == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    got = toxicity(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    held = got.filter("held_out").join(table(spark, SF_DIR, "labels"), "doc_id")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "x", 4), (2, "", 5), (2, "", 5), (3, "w " * 50_000, 1)], "doc_id BIGINT, text STRING, score INT")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id BIGINT, toxic INT")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0
