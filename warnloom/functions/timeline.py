"""Dated events as column expressions over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scans
from .core import WS, bind, find_all, first_per_key
from .text import sentences

_MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
)
# What a date begins with, tried before the word boundary, which costs more: a digit, or three letters as months have them.
_BEGIN = r"(?=\d|[JFMASOND][AEPUCO][NBRYLGPTVC])"
# Fixed value: the date shapes that make a sentence an event.
DATE = (
    rf"(?iU){_BEGIN}\b(?:\d{{1,2}}[{WS}]+{_MONTH}[{WS}]+\d{{4}}"
    rf"|{_MONTH}[{WS}]+\d{{1,2}},?[{WS}]+\d{{4}}"
    r"|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
)
YEARLESS = rf"(?iU)\b{_MONTH}[{WS}]+\d{{1,2}}\b"
BARE_YEAR = r"(?U)\A\d{4}\z"
MAX_EVENTS = 8
EVENT_CHARS = 220
KEY_CHARS = 60


# Unicode noncharacters, reserved for use inside a program: they enclose a date for a moment.
_OPEN, _CLOSE = "\ufdd1", "\ufdd2"


def mark_dates(text: Column) -> Column:
    """Enclose every date. One pass over the whole text finds what a pass over each sentence would:
    a date holds no sentence end, and white space follows every sentence."""
    return F.regexp_replace(text, f"({DATE})", f"{_OPEN}$1{_CLOSE}")


def marked_dates(sentence: Column) -> Column:
    """Distinct dates of a marked sentence in text order."""
    parts = F.filter(F.split(sentence, _OPEN), lambda p: F.contains(p, F.lit(_CLOSE)))
    return F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, _CLOSE, 1)))


def unmark(sentence: Column) -> Column:
    return F.replace(F.replace(sentence, F.lit(_OPEN), F.lit("")), F.lit(_CLOSE), F.lit(""))


def truncate_event(sentence: Column, chars: int = EVENT_CHARS) -> Column:
    return F.when(
        F.length(sentence) > chars, F.concat(F.substring(sentence, 1, chars - 3), F.lit("..."))
    ).otherwise(sentence)


def is_bare_year(date: Column) -> Column:
    return date.rlike(BARE_YEAR)


def dated_sentences(text: Column, undated: bool = False) -> Column:
    """Structs (sent_idx, sentence, dates) of the sentences of a text that hold a date, or of all."""
    if undated:
        numbered = F.transform(
            sentences(mark_dates(text)), lambda s, i: F.struct(i.alias("i"), s.alias("s"))
        )
    else:
        # Only sentences that can hold a date are searched for one: none reaches over a sentence's end.
        can = scans.dated(text)
        numbered = F.zip_with(
            F.split(mark_dates(can["text"]), scans.BREAK), can["at"], lambda s, i: F.struct(i.alias("i"), s.alias("s"))
        )
        numbered = F.filter(numbered, lambda n: F.contains(n["s"], F.lit(_OPEN)))
    return F.transform(
        numbered,
        lambda n: F.struct(
            n["i"].alias("sent_idx"),
            unmark(n["s"]).alias("sentence"),
            marked_dates(n["s"]).alias("dates"),
        ),
    )


def mentions(text: Column, yearless: bool = False) -> Column:
    """Structs (sent_idx, pos, date, event, key) for each date of each sentence, in text order;
    optionally `Month D` where a sentence has no full date."""

    def dates(s: Column) -> Column:
        if not yearless:
            return s["dates"]
        short = F.array_distinct(find_all(s["sentence"], YEARLESS))
        return F.when(F.size(s["dates"]) > 0, s["dates"]).otherwise(short)

    per_sentence = F.transform(
        dated_sentences(text, undated=yearless),
        lambda s: F.transform(
            dates(s),
            lambda d, p: F.struct(
                s["sent_idx"].alias("sent_idx"),
                p.alias("pos"),
                d.alias("date"),
                truncate_event(s["sentence"]).alias("event"),
                F.struct(F.lower(d), F.lower(F.substring(s["sentence"], 1, KEY_CHARS))).alias("key"),
            ),
        ),
    )
    return F.filter(F.flatten(per_sentence), lambda e: ~is_bare_year(e["date"]))


def first_mentions(events: Column) -> Column:
    """One event per (date, start of the sentence) and report."""
    return bind(
        events,
        lambda ev: F.when(F.size(ev) < 2, ev).otherwise(first_per_key(ev, lambda e: e["key"])),
    )


def cap_events(events: Column, max_events: int = MAX_EVENTS) -> Column:
    """Stop after the sentence that reaches `max_events`; its own dates are all kept."""
    return bind(
        events,
        lambda ev: F.filter(
            ev,
            lambda e: F.coalesce(
                e["sent_idx"] <= F.get(ev, F.lit(max_events - 1))["sent_idx"], F.lit(True)
            ),
        ),
    )


def timeline_events(text: Column, max_events: int = MAX_EVENTS, yearless: bool = False) -> Column:
    return cap_events(first_mentions(mentions(text, yearless)), max_events)


def as_timeline(events: Column) -> Column:
    return F.transform(events, lambda e: F.struct(e["date"].alias("date"), e["event"].alias("event")))
