"""Scans of whole texts that take Python's string search, which is many times as fast as a pattern tried at every character. They
find keywords and sentences, and tell where a pattern can match at all; the pattern itself decides."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WHITESPACE

BREAK = "\ufdd0"
# As `text.sentences` cuts them; begins with a character, which is found faster than a look back.
_END = re.compile(rf"""([.!?](?<![.!?][.!?])[.!?]*+["')\]]*+)[{re.escape(WHITESPACE)}]++""")
_WORDS = re.compile(r"\w+")
_DOTTED = re.compile(r"\d\.\d")
# By byte, a letter for word characters and a blank for others.
_LATIN = bytes(120 if _WORDS.match(chr(i)) else 32 for i in range(256))
# Every date without a missing year holds four digits or a slash and two; begins with a set, which is found faster than alternatives.
_YEAR = re.compile(r"[\d/](?:(?<=/)|\d)\d\d")
# Where no odd character stands for a letter, it holds one of these or the name of a month.
_NUMBERS = re.compile(r"\d\d\d\d-\d\d-\d\d|/\d{1,2}/\d\d")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Characters that match an ASCII letter without regard to case, but do not become it in lower case.
_ODD_CASE = "\u017f\u0131\u0130"

# So few phrases are looked for one by one.
FEW_PHRASES = 6

@lru_cache(maxsize=1)
def lower(text: str) -> str:
    """In lower case; several scans of a row ask for it one after the other."""
    return text.lower()


@lru_cache(maxsize=1)
def split(text: str) -> list[str]:
    """The parts without white space; several scans of a row ask for them one after the other."""
    return text.split()


def _sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _END.sub(r"\1" + BREAK, text).split(BREAK)) if s]


def _may_date(sentence: str) -> bool:
    """Whether a sentence with a year can hold a date."""
    if _NUMBERS.search(sentence):
        return True
    low = sentence.lower()
    return any(m in low for m in _MONTHS) or not sentence.isascii() and any(c in sentence for c in _ODD_CASE)


@lru_cache(maxsize=1)
def _triples(low: str) -> np.ndarray:
    """Which triples of neighbouring bytes occur, told by the last five bits of each."""
    b = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16) & 31
    seen = np.zeros(1 << 15, bool)
    if len(b) > 2:
        seen[b[:-2] << 10 | b[1:-1] << 5 | b[2:]] = True
    return seen


def _candidates(phrases: list[str]) -> Callable[[str], list[str]]:
    """A function that gives, in order, the phrases all of whose triples a text in lower case has: the others are not in it."""
    if len(phrases) < FEW_PHRASES:
        return lambda low: phrases
    # A phrase of fewer than three bytes has none; it asks for a place of its own, which always holds.
    triples = [np.flatnonzero(_triples(k)).tolist() or [1 << 15] for k in phrases]
    flat = np.array([x for t in triples for x in t], np.int64)
    starts = np.cumsum([0, *map(len, triples)])[:-1]

    def find(low: str) -> list[str]:
        held = np.logical_and.reduceat(np.append(_triples(low), True)[flat], starts)
        return [phrases[i] for i in np.flatnonzero(held)]

    return find


def contained(text: Column, shortest: list[str], longer: list[str]) -> Column:
    """The ASCII terms contained in the text without regard to case: of `shortest`, then those of `longer` that hold one of them."""

    candidates = _candidates(shortest)

    def find(text):
        if not text:
            return []
        low = lower(text)
        found = [k for k in candidates(low) if k in low]
        return found + [k for k in longer if any(s in k for s in found) and k in low]

    return F.udf(find, "array<string>")(text)


def near(text: Column, phrases: list[str], after: int) -> Column:
    """What a pattern that begins with one of these ASCII phrases, without regard to case, can match in, with the character before and
    `after` behind the phrase: all such places in text order, those that meet as one, a line each; null for null."""
    candidates = _candidates(phrases)

    def find(text):
        if not text:
            return text
        if not text.isascii() and any(c in text for c in _ODD_CASE):
            return text
        low = lower(text)
        places = []
        for k in candidates(low):
            at = low.find(k)
            while at >= 0:
                places.append((max(at - 1, 0), at + len(k) + after))
                at = low.find(k, at + 1)
        parts = []
        for start, end in sorted(places):
            if parts and start <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], end)
            else:
                parts.append([start, end])
        return "\n".join([text[start:end] for start, end in parts])

    return F.udf(find, "string")(text)


def may_hold_address(text: Column) -> Column:
    """Whether digits stand on both sides of a dot. True for null."""
    return F.udf(lambda text: text is None or _DOTTED.search(text) is not None, "boolean")(text)


def runs(text: Column, holds: str, length: int = 0) -> Column:
    """The parts of the text without white space that hold a string and have so many characters or more, a line each: what a pattern
    can match in that has no white space and needs these; null for null."""

    def find(text):
        if not text or holds not in text:
            return text and ""
        return "\n".join([run for run in split(text) if holds in run and len(run) >= length])

    return F.udf(find, "string")(text)


def count_words(text: str) -> int:
    """Maximal runs of word characters. Latin-1 texts are cut as bytes, which is faster."""
    try:
        return len(text.encode("latin-1").translate(_LATIN).split())
    except UnicodeEncodeError:
        return len(_WORDS.findall(text))


def word_count(text: Column) -> Column:
    return F.udf(lambda text: None if text is None else count_words(text), "int")(text)


def dated(text: Column) -> Column:
    """Struct (text, at): the sentences that can hold a date, joined by BREAK, and which ones they are."""

    def find(text):
        if not text or not _YEAR.search(text):
            return "", []
        kept = [(i, s) for i, s in enumerate(_sentences(text)) if _YEAR.search(s) and _may_date(s)]
        return BREAK.join(s for _, s in kept), [i for i, _ in kept]

    return F.udf(find, "struct<text:string,at:array<int>>")(text)


def summary(text: Column, found: Column, n: int, least: int, most: int) -> Column:
    """`summary.summary` of the text's sentences: the n best by hits of the found terms, in text order."""

    def pick(text, found):
        if text is None:
            return None
        parts = _sentences(text)
        if len(parts) <= n:
            return " ".join(parts)
        scored = []
        for i, s in enumerate(parts if found else ()):
            low = s.lower()
            hits = sum([k in low for k in found])
            if hits and least <= (words := len(s.split())) <= most:
                scored.append((hits / words * 100 * (1.5 if i < 3 else 1.2 if i > len(parts) - 4 else 1.0), i))
        best = {i for _, i in heapq.nlargest(n, scored)}
        # Those without hits score 0, the later ones first.
        for i in reversed(range(len(parts))):
            if len(best) >= n:
                break
            if i not in best and least <= len(parts[i].split()) <= most:
                best.add(i)
        return " ".join(parts[i] for i in sorted(best))

    return F.udf(pick, "string")(text, found)
