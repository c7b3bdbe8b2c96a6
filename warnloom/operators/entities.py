"""Named entities by gazetteer. Input: report_id and normalised text."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.core import first_per_key
from . import automaton as A
from .rows import element_rows, struct_rows


def name_mentions(df: DataFrame) -> DataFrame:
    """Every built-in name as a whole token, the longest where several start together:
    report_id, pos, name, bucket. A name broken over a line does not match."""
    return element_rows(df, "report_id", N.names_in(F.col("text")), "name").withColumn(
        "bucket",
        F.when(F.lower("name").isin(N.MALWARE_NAMES), "malware").otherwise("products"),
    )


def with_names(df: DataFrame) -> DataFrame:
    return df.withColumn("_names", N.names_in(F.col("text")))


def extract_malware(df: DataFrame) -> DataFrame:
    return element_rows(with_names(df), "report_id", N.malware("_names"), "name")


def extract_products(df: DataFrame) -> DataFrame:
    return element_rows(with_names(df), "report_id", N.products("_names"), "name")


def _word_characters() -> np.ndarray:
    """By code point, whether a character belongs to words."""
    return np.fromiter((i == 95 or unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_WORDS: list[np.ndarray] = []


def _lowered(text: str) -> tuple[str, np.ndarray | None]:
    """The text in lower case, and where each of its characters stood before, if lowering changed the length."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    each = [c.lower() for c in text]
    return "".join(each), np.repeat(np.arange(len(text)), [len(c) for c in each])


def spans_in(text: str | None, names: A.Phrases, buckets: list[list[str]]) -> list[dict]:
    """Occurrences of names as whole tokens, words or single other characters: start and length in tokens, name as written, bucket."""
    if not text:
        return []
    low, origin = _lowered(text)
    found = [(end - len(names.phrases[i]) + 1, end + 1, i) for end, i in names.matches(low)]
    if not found:
        return []
    if not _WORDS:
        _WORDS.append(_word_characters())
    if origin is not None:
        edge = np.concatenate([np.diff(origin, prepend=-1) != 0, [True]])  # no name begins or ends inside what was one character
        origin = np.append(origin, len(text))
        found = [(int(origin[a]), int(origin[b]), i) for a, b, i in found if edge[a] and edge[b]]
    word = _WORDS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = np.concatenate([[True], ~(word[1:] & word[:-1]), [True]])
    token = np.cumsum(begins) - 1
    return [
        {"start": int(token[a]), "length": int(token[b] - token[a]), "name": text[a:b], "bucket": bucket}
        for a, b, i in found
        if begins[a] and begins[b]
        for bucket in buckets[i]
    ]


def without_overlap(spans: list[dict]) -> list[dict]:
    """The longest first, then the leftmost, of those that overlap none kept before; in text order."""
    taken: set[int] = set()
    kept = []
    for s in sorted(spans, key=lambda s: (-s["length"], s["start"], s["name"], s["bucket"])):
        places = range(s["start"], s["start"] + s["length"])
        if taken.isdisjoint(places):
            taken.update(places)
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


SPANS = "array<struct<start:int,length:int,name:string,bucket:string>>"


def with_spans(df: DataFrame, gaz: DataFrame, text: Column | str = "text", overlaps: bool = False, most: int = A.MOST_PHRASES) -> DataFrame:
    """Add `gazetteer_spans`, the names of `gaz` (name, bucket) that occur in the row's text, found in the row by an
    automaton; overlapping ones too, or resolved. Names that begin with a space are never found. A list of more than `most` names is
    taken in parts, one pass for each."""
    names = gaz.select(F.lower("name").alias("key"), "bucket").filter("key <> '' AND NOT startswith(key, ' ')").distinct()
    listed = A.parts(names, ["key"], most)
    df = df.withColumn("_text", F.col(text) if isinstance(text, str) else text)
    for k, rows in enumerate(listed):
        meanings: dict[str, list[str]] = {}
        for r in rows:
            meanings.setdefault(r["key"], []).append(r["bucket"])
        keys, buckets = A.Phrases(list(meanings)), list(meanings.values())

        def find(texts: list, keys=keys, buckets=buckets) -> list:
            found = [spans_in(x, keys, buckets) for x in texts]
            return found if overlaps or len(listed) > 1 else [without_overlap(x) for x in found]

        df = A.with_computed(df, f"_spans_{k}", SPANS, F.col("_text"), find)
    parts = [f"_spans_{k}" for k in range(len(listed))]
    df = df.withColumn("gazetteer_spans", F.concat(*parts)).drop("_text", *parts)
    if overlaps or len(listed) == 1:
        return df
    return A.with_computed(df, "gazetteer_spans", SPANS, F.col("gazetteer_spans"), lambda rows: [without_overlap(x) for x in rows])


def gazetteer_spans(df: DataFrame, gaz: DataFrame, overlaps: bool = True, most: int = A.MOST_PHRASES) -> DataFrame:
    """Occurrences of gazetteer names: report_id, start, length, name, bucket. Without `overlaps` the longest name wins, then the leftmost."""
    return struct_rows(with_spans(df, gaz, overlaps=overlaps, most=most), "report_id", "gazetteer_spans")


def names_of(bucket: str) -> Column:
    """The names of one bucket among the row's spans, once each without regard to case, in text order."""
    named = F.filter("gazetteer_spans", lambda s: (s["bucket"] == bucket) & ~N.is_noise(s["name"]))
    return first_per_key(F.transform(named, lambda s: s["name"]), F.lower)


def extract_gazetteer(df: DataFrame, gaz: DataFrame, most: int = A.MOST_PHRASES) -> DataFrame:
    """Names of a caller's gazetteer (name, bucket): report_id, bucket, pos, name, de-duplicated
    without regard to case, in text order. A report's names are found and sorted out in its row."""
    buckets = [r.bucket for r in gaz.select("bucket").filter("bucket IS NOT NULL").distinct().orderBy("bucket").collect()]
    if not buckets:
        return df.select("report_id", F.lit("").alias("bucket"), F.lit(0).alias("pos"), F.lit("").alias("name")).limit(0)
    found = with_spans(df, gaz, most=most)
    lists = F.array(*[F.struct(F.lit(b).alias("bucket"), names_of(b).alias("names")) for b in buckets])
    return element_rows(struct_rows(found, "report_id", lists), ["report_id", "bucket"], "names", "name")


def with_gazetteer(df: DataFrame, gaz: DataFrame, most: int = A.MOST_PHRASES) -> DataFrame:
    """`entities` with the organisations and locations of a gazetteer, in the row. Where a malware or product
    name overlaps a name of the gazetteer, only the former is found."""
    wanted = gaz.filter(F.col("bucket").isin("organizations", "locations"))
    found = with_spans(df, wanted, N.without_names(F.col("text")), most=most)
    filled = F.col("entities")
    for bucket in ("organizations", "locations"):
        filled = filled.withField(bucket, names_of(bucket))
    return found.withColumn("entities", filled).drop("gazetteer_spans")


def drop_ioc_noise(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Drop entities that are an address or a domain."""
    return df.filter(~N.is_noise(F.col(entity)))


def extract_entities(df: DataFrame, max_chars: int | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Add `entities`: malware, products, organizations, locations.

    The last two come from a gazetteer (name, bucket) and are empty without one. The
    whole text is scanned unless `max_chars` sets a bound for the first two.
    """
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    none = F.array().cast("array<string>")
    out = (
        df.withColumn("_names", N.drop_ioc_noise(N.names_in(text)))
        .withColumn(
            "entities",
            F.struct(
                N.malware("_names").alias("malware"),
                N.products("_names").alias("products"),
                none.alias("organizations"),
                none.alias("locations"),
            ),
        )
        .drop("_names")
    )
    return out if gazetteer is None else with_gazetteer(out, gazetteer)
