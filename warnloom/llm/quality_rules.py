"""Quality rules whose cutoffs are chosen under a risk bound.

Every rule is a number per text and rejects above a cutoff. For each stratum (a language) and rule, the
cutoffs of a grid are tested from lax to strict on labelled good texts: a cutoff passes while an exact
binomial test shows that it rejects less than the rule's share of the allowed false rejections. The
tests stop at the first failure (a fixed sequence needs no correction), and the error is divided by the
number of rules and strata (Bonferroni). A stratum without enough labelled texts gets no cutoff and loses
nothing. All of it is DataFrame expressions; texts stay in their rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import bind
from ..operators.joins import lookup_join
from ..sources.staging import stage
from .words import SPACE, word_array

SYMBOLS = "#*$%&|<>"

# Each rule: the number it looks at, and its grid of cutoffs from lax to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "marks": ("n_marks / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
}


def characters(text: Column, kept_out: str) -> Column:
    """How many characters of `text` are in the list `kept_out`."""
    return F.length(text) - F.length(F.translate(text, kept_out, ""))


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted with their positions (n log n); those equal to a neighbour repeat, and
    each covers the words up to the next one's start, three at most."""
    return bind(words, _repeat_words)


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = bind(
            placed,
            lambda s: F.filter(s, lambda e, k: ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))),
        )
        at = F.sort_array(F.transform(repeated, lambda e: e["i"]))
        reach = bind(at, lambda a: F.transform(a, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1), p + 3) - p)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.aggregate(reach, F.lit(0), lambda total, n: total + n))

    return F.when(F.size(words) < 4, 0).otherwise(bind(hashes, covered)).cast("long")


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the numbers that the rules look at, in a struct `quality`: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks and base_failed. A null text has no words,
    and so fails the base rule."""
    read = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    read = read.withColumn("_words", word_array(F.col("_text")))
    read = read.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    words, body = F.col("_words"), F.col("_text")
    numbers = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        characters(body, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        characters(body, "!?").cast("long").alias("n_marks"),
    )
    read = read.withColumn("_numbers", numbers).drop("_words", "_lines", "_text")
    failed = (F.col("_numbers.n_words") < 50) | (100 * F.col("_numbers.n_repeat_words") > 50 * F.col("_numbers.n_words"))
    return read.withColumn("quality", F.col("_numbers").withField("base_failed", failed)).drop("_numbers")


def rule_values(q: str = "quality") -> Column:
    """The rules of a text, by name, each with its value."""
    parts = []
    for name, (formula, _) in RULES.items():
        named = re.sub(r"\b(n_\w+|word_chars)\b", rf"{q}.\1", formula)
        parts.append(F.struct(F.lit(name).alias("rule"), F.expr(f"coalesce(try_divide(1.0D * {named.split(' / ')[0]}, {named.split(' / ')[1]}), 0D)").alias("value")))
    return F.array(*parts)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """The exact probability of at most k of n with probability p each, for k up to n * p; 1 beyond."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("log"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))
    odds = F.log(F.lit(p / (1 - p)))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1).cast("double") / i) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add)["sum"]
    return F.when(k > n * p, 1.0).when(k == 0, F.exp(n * F.log1p(F.lit(-p)))).otherwise(F.least(total, F.lit(1.0)))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", allowed: float = 0.03, error: float = 0.05, id_col: str = "doc_id") -> DataFrame:
    """stratum, cutoffs (map of rule to cutoff): for labelled good texts of a stratum, all rules together
    reject more than the share `allowed` with probability `error` at most, over all strata.

    `measured` has the id, the stratum and `quality`; labels have the id and `quality`, 1 for good. Repeated
    labels count as good if any is; null ones are left out."""
    good = labels.filter("quality = 1").select(F.col(id_col).alias("_id")).distinct()
    held = measured.filter("NOT quality.base_failed").select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), "quality")
    held = lookup_join(held, good, ["_id"], "left_semi").select("_stratum", F.explode(rule_values()).alias("r"))
    grid = F.expr("CASE r.rule " + " ".join(f"WHEN '{name}' THEN array({', '.join(map(repr, g))})" for name, (_, g) in RULES.items()) + " END").cast("array<double>")
    # Values reject at the grid points below them: all from the first such point on.
    held = held.select("_stratum", "r.rule", F.size(F.filter(grid, lambda c: c >= F.col("r.value"))).alias("spared"))
    counts = held.groupBy("_stratum", "rule", "spared").agg(F.count("*").alias("n"))
    by_rule = counts.groupBy("_stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("spared", F.col("n").alias("k"))).alias("seen"))
    by_rule = stage(by_rule, "quality-counts")  # a row for each stratum and rule
    strata = max(1, by_rule.select("_stratum").distinct().count())
    grid = F.expr("CASE rule " + " ".join(f"WHEN '{name}' THEN array({', '.join(map(repr, g))})" for name, (_, g) in RULES.items()) + " END").cast("array<double>")
    points = by_rule.select("_stratum", "rule", "n", "seen", F.posexplode(grid).alias("at", "cutoff"))
    rejected = F.aggregate("seen", F.lit(0).cast("long"), lambda total, s: total + F.when(s["spared"] <= F.col("at"), s["k"]).otherwise(0))
    points = points.withColumn("k", rejected)
    tested = points.withColumn("passes", binomial_at_most(F.col("k"), F.col("n"), allowed / len(RULES)) <= error / (len(RULES) * strata))
    order = Window.partitionBy("_stratum", "rule").orderBy("at")
    passed = tested.withColumn("so_far", F.min("passes").over(order)).filter("so_far").groupBy("_stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return passed.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` with `rejected_by`, the rules that reject a text, and `kept`. Cutoffs are few rows (one for
    each stratum that has many labelled texts); they are broadcast if counted to be small."""
    read = measured.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    read = lookup_join(read, cutoffs, ["_stratum"])
    rejected = F.transform(F.filter(rule_values(), lambda r: r["value"] > F.col("cutoffs")[r["rule"]]), lambda r: r["rule"])
    read = read.withColumn("rejected_by", F.coalesce(F.when(F.col("cutoffs").isNotNull(), rejected), F.array().cast("array<string>")))
    return read.withColumn("kept", ~F.col("quality.base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: its numbers, base_failed, rejected_by and kept. The numbers are computed
    once and staged (some bytes a document), then give both the cutoffs and the verdicts."""
    measured = stage(quality_metrics(docs).select("doc_id", "lang", "quality"), "quality")
    judged = judge(measured, choose_cutoffs(measured, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names], "kept", "rejected_by")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, unchanged. Columns of any name but those starting with an
    underscore may stand beside doc_id, text and lang."""
    # Numbers are computed once and staged with a key of the row; rows of one key are equal in all that is judged.
    key = F.xxhash64("doc_id", "text", "lang")
    measured = stage(quality_metrics(docs.select(key.alias("_key"), "doc_id", "text", "lang")).select("_key", "doc_id", "lang", "quality"), "quality")
    cutoffs = stage(choose_cutoffs(measured, labels), "cutoffs")
    gone = stage(judge(measured, cutoffs).filter("NOT kept").select("_key").distinct(), "rejected-rows")
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return lookup_join(rows, gone, ["_key"], "left_anti", spread_by=["_key"]).select("_row.*")
