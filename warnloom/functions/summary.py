"""Extractive summary as column expressions over a sentence array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bind
from .text import has_odd_blanks, plain_words, space_words

SUMMARY_SENTENCES = 4
MIN_WORDS, MAX_WORDS = 5, 60


def position_bonus(index: Column, total: Column) -> Column:
    return F.when(index < 3, 1.5).when(index > total - 4, 1.2).otherwise(1.0)


def scored(sentences: Column, found: Column) -> Column:
    """Structs (score, sent_idx, hits, words, sentence) for every sentence of scorable length.

    `found` holds the terms of the whole text, so only those few are looked for in a sentence.
    """

    def measured(terms: Column, odd: Column) -> Column:
        return F.transform(
            sentences,
            lambda s, i: F.struct(
                bind(
                    F.lower(s), lambda low: F.size(F.filter(terms, lambda k: F.contains(low, k)))
                ).alias("hits"),
                F.greatest(F.when(odd, space_words(s)).otherwise(plain_words(s)), F.lit(1)).alias("words"),
                i.alias("i"),
                s.alias("s"),
            ),
        )

    return scored_measures(sentences, bind(has_odd_blanks(sentences), lambda odd: bind(found, lambda terms: measured(terms, odd))))


def scored_measures(sentences: Column, measured: Column) -> Column:
    """The same from structs (hits, words, i, s) of every sentence."""
    return bind(
        F.size(sentences),
        lambda total: F.transform(
            F.filter(measured, lambda m: m["words"].between(MIN_WORDS, MAX_WORDS)),
            lambda m: F.struct(
                (m["hits"] / m["words"] * 100 * position_bonus(m["i"], total)).alias("score"),
                m["i"].alias("sent_idx"),
                m["hits"].alias("hits"),
                m["words"].alias("words"),
                m["s"].alias("sentence"),
            ),
        ),
    )


def summary(sentences: Column, found: Column, n: int = SUMMARY_SENTENCES) -> Column:
    """The n best sentences (later one first on ties) in text order; short texts stay whole."""
    ranked = F.reverse(F.sort_array(scored(sentences, found)))
    best = F.sort_array(
        F.transform(F.slice(ranked, 1, n), lambda r: F.struct(r["sent_idx"], r["sentence"]))
    )
    return F.when(F.size(sentences) <= n, F.array_join(sentences, " ")).otherwise(
        F.array_join(F.transform(best, lambda b: b["sentence"]), " ")
    )
