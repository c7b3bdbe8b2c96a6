"""Text normalisation operators. Input: report_id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.core import strip
from .rows import element_rows


def clean_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", T.clean_text(F.col("text")))


def refang(df: DataFrame) -> DataFrame:
    return df.withColumn("text", T.refang(F.col("text")))


def normalise(df: DataFrame) -> DataFrame:
    """`clean_text`, then `refang`: the form every other operator expects."""
    return df.withColumn("text", T.normalise(F.col("text")))


def filter_min_length(df: DataFrame, min_chars: int = T.MIN_CHARS) -> DataFrame:
    """Keep reports whose stripped text has at least `min_chars` characters."""
    return df.filter(F.length(strip(F.col("text"))) >= min_chars)


def split_min_length(df: DataFrame, min_chars: int = T.MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the same rule; a null text is rejected. Rejected rows say why in `reason`."""
    long = F.coalesce(F.length(strip(F.col("text"))) >= min_chars, F.lit(False))
    reason = F.lit(f"fewer than {min_chars} characters")
    return df.filter(long), df.filter(~long).withColumn("reason", reason)


def split_sentences(df: DataFrame) -> DataFrame:
    """One row for each sentence: report_id, sent_idx, sentence."""
    return element_rows(df, "report_id", T.sentences(F.col("text")), "sentence", pos="sent_idx")


def word_count(df: DataFrame) -> DataFrame:
    return df.select("report_id", T.word_count(F.col("text")).alias("word_count"))


def text_excerpt(df: DataFrame, chars: int = T.EXCERPT_CHARS) -> DataFrame:
    return df.select("report_id", T.text_excerpt(F.col("text"), chars).alias("text_excerpt"))
