"""Rules by a caller's lexicon: a table of label, ord, keyword, kw_ord.

A keyword counts where the lower-cased text contains it, as for the built-in lists. Labels go by `ord` and the keywords of one by
`kw_ord` (the least of each, if rows differ); null and empty keywords are never found. The
lexicon is compiled into an automaton and each text is run through it once, whatever the number of keywords; no
row is joined with a keyword. A null text has no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import summary as S
from ..functions.core import bind
from ..functions.lexicons import UNKNOWN_THREAT
from ..functions.text import space_words
from . import automaton as A
from .narrative import with_sentences
from .rows import struct_rows

HITS = "array<struct<ord:int,label:string,kw_ord:int,keyword:string>>"


def tidy(lexicon: DataFrame) -> DataFrame:
    """ord, label, kw_ord, keyword: one row for each label and keyword."""
    rows = lexicon.select("label", F.col("ord").cast("int").alias("ord"), F.lower("keyword").alias("keyword"), F.col("kw_ord").cast("int").alias("kw_ord"))
    rows = rows.filter("keyword <> ''").groupBy("label", "keyword").agg(F.min("ord").alias("ord"), F.min("kw_ord").alias("kw_ord"))
    first = rows.groupBy("label").agg(F.min("ord").alias("first")).select(F.col("label").alias("_label"), "first")
    return rows.join(first, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("first").alias("ord"), "label", "kw_ord", "keyword")


def grouped(rows: list) -> tuple[A.Phrases, list[list[dict]]]:
    """The keywords, and for each what it stands for."""
    meanings: dict[str, list[dict]] = {}
    for r in rows:
        meanings.setdefault(r["keyword"], []).append(r.asDict())
    return A.Phrases(list(meanings)), list(meanings.values())


def with_hits(df: DataFrame, lexicon: DataFrame, text: str = "text", most: int = A.MOST_PHRASES) -> DataFrame:
    """Add `lexicon_hits`, the labels and keywords found in the text, by ord, label and kw_ord."""
    listed = A.parts(tidy(lexicon), ["keyword"], most)
    for k, rows in enumerate(listed):
        phrases, meanings = grouped(rows)

        def find(texts: list, phrases=phrases, meanings=meanings) -> list:
            return [[m for i in {i for _, i in phrases.matches(x)} for m in meanings[i]] for x in texts]

        df = A.with_computed(df, f"_hits_{k}", HITS, F.lower(text), find)
    names = [f"_hits_{k}" for k in range(len(listed))]
    return df.withColumn("lexicon_hits", F.sort_array(F.concat(*names))).drop(*names)


def labels_of(lexicon: DataFrame) -> list[tuple[int, str]]:
    """(ord, label) in order. Labels are few: a score is kept for each in every row."""
    return [(r.ord, r.label) for r in tidy(lexicon).select("ord", "label").distinct().orderBy("ord", "label").collect()]


def label_scores(hits: Column, labels: list[tuple[int, str]]) -> Column:
    """Structs (label, ord, score) for every label, zeros included."""
    listed = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(ord_).alias("ord")) for ord_, label in labels]) if labels else F.array().cast("array<struct<label:string,ord:int>>")
    return bind(
        hits,
        lambda found: F.transform(
            listed, lambda x: F.struct(x["label"].alias("label"), x["ord"].alias("ord"), F.size(F.filter(found, lambda h: h["label"].eqNullSafe(x["label"]))).alias("score"))
        ),
    )


def lexicon_scores(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """How many keywords of each label a report has, zeros included: report_id, label, ord, score."""
    return struct_rows(with_hits(df, lexicon), "report_id", label_scores(F.col("lexicon_hits"), labels_of(lexicon)))


def classify_by_lexicon(df: DataFrame, lexicon: DataFrame, out: str = "label", unknown: str = UNKNOWN_THREAT) -> DataFrame:
    """Add the label with the most keywords, the first by ord of equal ones; `unknown` where none is found."""
    best = F.array_max(F.transform(label_scores(F.col("lexicon_hits"), labels_of(lexicon)), lambda x: F.struct(x["score"].alias("score"), (-x["ord"]).alias("rank"), x["label"].alias("label"))))
    return with_hits(df, lexicon).withColumn(out, bind(best, lambda b: F.when(b["score"] > 0, b["label"]).otherwise(F.lit(unknown)))).drop("lexicon_hits")


def lexicon_tier(df: DataFrame, lexicon: DataFrame, lowest: str) -> DataFrame:
    """The first label by ord that has any keyword, as for severity tiers: report_id, label, reason. Where none has,
    the label is `lowest` and the reason null."""
    found = with_hits(df, lexicon).withColumn("_first", F.get("lexicon_hits", F.lit(0)))
    words = F.slice(F.transform(F.filter("lexicon_hits", lambda h: h["label"].eqNullSafe(F.col("_first.label"))), lambda h: h["keyword"]), 1, 4)
    return found.select(
        "report_id",
        F.when(F.col("_first").isNull(), F.lit(lowest)).otherwise(F.col("_first.label")).alias("label"),
        F.when(F.col("_first").isNotNull(), F.concat(F.lit("keywords: "), F.array_join(words, ", "))).alias("reason"),
    )


def lexicon_ranking(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The labels with any keyword, most keywords first, then by ord: report_id, pos, label, matched_keywords, hits."""
    by_label = lambda found: F.transform(
        F.array_distinct(F.transform(found, lambda h: F.struct(h["ord"].alias("ord"), h["label"].alias("label")))),
        lambda x: F.struct(x.alias("x"), F.transform(F.filter(found, lambda h: h["label"].eqNullSafe(x["label"])), lambda h: h["keyword"]).alias("words")),
    )
    ranked = F.sort_array(F.transform(bind(F.col("lexicon_hits"), by_label), lambda y: F.struct((-F.size(y["words"])).alias("n"), y["x"].alias("x"), y["words"].alias("words"))))
    listed = F.transform(ranked, lambda r: F.struct(r["x"]["label"].alias("label"), r["words"].alias("matched_keywords"), (-r["n"]).alias("hits")))
    return struct_rows(with_hits(df, lexicon), "report_id", listed, pos="pos")


def score_sentences_by(df: DataFrame, lexicon: DataFrame, most: int = A.MOST_PHRASES) -> DataFrame:
    """`score_sentences` with the keywords of the lexicon: report_id, score, sent_idx, hits, words, sentence."""
    df = with_sentences(df)
    listed = A.parts(tidy(lexicon).select("keyword").distinct(), ["keyword"], most)
    for k, rows in enumerate(listed):
        phrases = A.Phrases([r["keyword"] for r in rows])

        def count(texts: list, phrases=phrases) -> list:
            return [[len({i for _, i in phrases.matches(s)}) for s in sentences or []] for sentences in texts]

        df = A.with_computed(df, f"_hits_{k}", "array<int>", F.transform("sentences", F.lower), count)
    total = F.transform("sentences", lambda s, i: sum((F.get(F.col(f"_hits_{k}"), i) for k in range(1, len(listed))), F.get(F.col("_hits_0"), i)))
    df = df.withColumn("_total", total)
    measured = F.transform("sentences", lambda s, i: F.struct(F.get("_total", i).alias("hits"), F.greatest(space_words(s), F.lit(1)).alias("words"), i.alias("i"), s.alias("s")))
    return struct_rows(df, "report_id", S.scored_measures(F.col("sentences"), measured))
