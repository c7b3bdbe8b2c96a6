"""Summary and timeline. Input: report_id and normalised text.

A report is one row, so its sentences are worked on as an array inside that row: nothing is
shuffled, and no text is exploded and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import summary as S
from ..functions import timeline as D
from ..functions.text import sentences
from .classify import _found
from .rows import struct_rows


def with_sentences(df: DataFrame) -> DataFrame:
    if "sentences" in df.columns:
        return df
    return df.withColumn("sentences", sentences(F.col("text")))


def score_sentences(df: DataFrame) -> DataFrame:
    """One row for each sentence of 5 to 60 words: report_id, score, sent_idx, hits, words, sentence."""
    return struct_rows(
        with_sentences(_found(df)), "report_id", S.scored(F.col("sentences"), F.col("found_keywords"))
    )


def summarize(df: DataFrame, n: int = S.SUMMARY_SENTENCES) -> DataFrame:
    """Add `summary`, of the text's own sentences or those that the rows have."""
    if "sentences" not in df.columns:
        found = _found(df)
        return found.withColumn("summary", scans.summary(F.col("text"), F.col("found_keywords"), n, S.MIN_WORDS, S.MAX_WORDS))
    return with_sentences(_found(df)).withColumn(
        "summary", S.summary(F.col("sentences"), F.col("found_keywords"), n)
    )


def date_mentions(df: DataFrame, yearless: bool = False) -> DataFrame:
    """Distinct dates of each sentence: report_id, sent_idx, pos, date, event.

    `yearless` adds dates such as `March 13` for sentences without a full date.
    """
    return struct_rows(df, "report_id", D.mentions(F.col("text"), yearless)).drop("key")


def drop_bare_years(df: DataFrame, date: str = "date") -> DataFrame:
    return df.filter(~D.is_bare_year(F.col(date)))


def truncate_event(df: DataFrame, sentence: str, chars: int = D.EVENT_CHARS) -> DataFrame:
    return df.withColumn(sentence, D.truncate_event(F.col(sentence), chars))


def dedupe_events(df: DataFrame, yearless: bool = False) -> DataFrame:
    """`date_mentions`, one per date and sentence start in a report."""
    firsts = D.first_mentions(D.mentions(F.col("text"), yearless))
    return struct_rows(df, "report_id", firsts).drop("key")


def extract_timeline(
    df: DataFrame, max_events: int = D.MAX_EVENTS, yearless: bool = False
) -> DataFrame:
    """Add `timeline`, an array of (date, event) in order of appearance."""
    events = D.timeline_events(F.col("text"), max_events, yearless)
    return df.withColumn("timeline", D.as_timeline(events))
