"""Keyword presence: which lexicon terms occur in a text, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scans
from .core import bind, literal_array, sql_array, sql_text
from .lexicons import (
    SEVERITY_KEYWORDS,
    SEVERITY_LEVELS,
    TECHNIQUES,
    THREAT_KEYWORDS,
    UNKNOWN_THREAT,
    all_keywords,
)


def keywords_in(text: Column, keywords=None) -> Column:
    """The lexicon terms contained in `text`, each once, for every rule to read.

    A term that contains a shorter term is looked for only where the shorter one was found.
    """
    words = keywords or all_keywords()
    longer = [w for w in words if any(other in w for other in words if other != w)]
    if all(w and w.isascii() for w in words):
        return scans.contained(text, [w for w in words if w not in longer], longer)
    shortest = literal_array([w for w in words if w not in longer])

    def search(low: Column) -> Column:
        def extend(short: Column) -> Column:
            more = F.filter(
                literal_array(longer),
                lambda k: F.exists(short, lambda s: F.contains(k, s)) & F.contains(low, k),
            )
            return F.when(F.size(short) == 0, short).otherwise(F.concat(short, more))

        found = F.filter(shortest, lambda k: F.contains(low, k))
        return bind(found, extend) if longer else found

    return bind(F.lower(text), search)


def hits(found: Column, keywords) -> Column:
    """The members of `keywords` among the found terms, in declared order."""
    return F.array_intersect(literal_array(keywords), found)


def threat_type_scores(found: Column) -> Column:
    return F.map_from_arrays(
        literal_array(THREAT_KEYWORDS),
        F.array(*[F.size(hits(found, words)) for words in THREAT_KEYWORDS.values()]),
    )


def threat_type(scores: Column) -> Column:
    """Best scoring type, the first declared on ties; a fixed label when nothing scored."""
    ranked = F.array(
        *[
            F.struct(scores[label].alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label"))
            for i, label in enumerate(THREAT_KEYWORDS)
        ]
    )
    return bind(
        F.array_max(ranked),
        lambda best: F.when(best["score"] == 0, UNKNOWN_THREAT).otherwise(best["label"]),
    )


def severity_tier(found: Column) -> Column:
    """Struct (level, keywords) of the strongest tier with a hit; level 0 and no keywords if none."""
    tier = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("keywords"))
    for level in SEVERITY_LEVELS[1:]:
        words = hits(found, SEVERITY_KEYWORDS[level])
        tier = F.when(
            F.size(words) > 0,
            F.struct(F.lit(SEVERITY_LEVELS.index(level)).alias("level"), words.alias("keywords")),
        ).otherwise(tier)
    return tier


def tier_reason(tier: Column) -> Column:
    return F.when(
        tier["level"] > 0,
        F.concat(F.lit("keywords: "), F.array_join(F.slice(tier["keywords"], 1, 4), ", ")),
    )


def cve_reason(n_cves: Column) -> Column:
    return F.when(n_cves > 0, F.concat(n_cves.cast("string"), F.lit(" CVE(s) referenced")))


def ioc_reason(n_iocs: Column) -> Column:
    return F.when(
        n_iocs >= 5, F.concat(n_iocs.cast("string"), F.lit(" indicators of compromise found"))
    )


def severity_level(tier: Column, n_cves: Column, n_iocs: Column) -> Column:
    high = F.lit(SEVERITY_LEVELS.index("High"))
    return F.greatest(
        tier["level"], F.when(n_cves > 0, high), F.when(n_iocs >= 5, high)
    )


def severity_name(level: Column) -> Column:
    return F.get(literal_array(SEVERITY_LEVELS), level)


def severity_reasons(tier: Column, n_cves: Column, n_iocs: Column) -> Column:
    reasons = F.array_compact(F.array(tier_reason(tier), cve_reason(n_cves), ioc_reason(n_iocs)))
    return bind(
        reasons,
        lambda r: F.when(F.size(r) > 0, r).otherwise(
            F.array(F.lit("no high-impact keywords or indicators found"))
        ),
    )


def techniques(found: Column) -> Column:
    """Matched techniques as an array of structs, most keyword hits first, declared order on ties."""
    declared = F.expr(
        "array("
        + ", ".join(
            f"named_struct('ord', {i}, 'id', {sql_text(tid)}, 'name', {sql_text(name)},"
            f" 'tactic', {sql_text(tactic)}, 'keywords', {sql_array(words)})"
            for i, (tid, name, tactic, words) in enumerate(TECHNIQUES)
        )
        + ")"
    )
    matched = bind(
        found,
        lambda f: F.transform(
            declared, lambda t: F.struct(t.alias("t"), F.array_intersect(t["keywords"], f).alias("m"))
        ),
    )
    ranked = F.sort_array(
        F.transform(
            F.filter(matched, lambda x: F.size(x["m"]) > 0),
            lambda x: F.struct(
                (-F.size(x["m"])).alias("order_hits"), x["t"]["ord"].alias("ord"), x.alias("x")
            ),
        )
    )
    return F.transform(
        ranked,
        lambda r: F.struct(
            r["x"]["t"]["id"].alias("id"),
            r["x"]["t"]["name"].alias("name"),
            r["x"]["t"]["tactic"].alias("tactic"),
            r["x"]["t"]["keywords"].alias("keywords"),
            r["x"]["m"].alias("matched_keywords"),
            (-r["order_hits"]).alias("hits"),
        ),
    )
