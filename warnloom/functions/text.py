"""Text normalisation as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scans
from .core import ODD_BLANKS, WHITESPACE, WS, bind, strip

# Defanged dots.
DEFANGED_DOTS = ["[.]", "(.)", "{.}"]
# Fixed value: characters of a report kept as its excerpt.
EXCERPT_CHARS = 6000
# Fixed value: shortest report worth analysing, in characters.
MIN_CHARS = 50

# Unicode noncharacters, reserved for use inside a program: they mark places in a text for a moment.
_BREAK = scans.BREAK


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, Latin-1 otherwise."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))


def clean_text(text: Column) -> Column:
    """LF line ends, single blanks, at most one empty line in a row, stripped.

    The blank rule matches only runs it would change; a lone space is never rewritten.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blanks = lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, r"\t[ \t]*+| [ \t]++", " ")).otherwise(t)
    lines = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}+", "\n\n")).otherwise(t)
    return strip(bind(bind(text, blanks), lines))


def refang(text: Column) -> Column:
    """Undo the usual defanging of dots and of http(s). The letter is tried before the word boundary, and the
    two x before lower case, which cost more."""
    for dot in DEFANGED_DOTS:
        text = F.replace(text, F.lit(dot), F.lit("."))
    return bind(
        text,
        lambda t: F.when(
            reduce(or_, [F.contains(t, F.lit(xx)) for xx in ("xx", "xX", "Xx", "XX")]) & F.contains(F.lower(t), F.lit("hxxp")),
            F.regexp_replace(
                F.regexp_replace(t, r"(?iU)(?=[hH])\bhxxps\b", "https"), r"(?iU)(?=[hH])\bhxxp\b", "http"
            ),
        ).otherwise(t),
    )


def normalise(text: Column) -> Column:
    return refang(clean_text(text))


def word_count(text: Column) -> Column:
    return scans.word_count(text)


def text_excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def sentences(text: Column) -> Column:
    """Array of sentences: split after . ! ? (and closing quotes or brackets) before white space."""
    marked = F.regexp_replace(
        text, rf"""(?<![.!?])([.!?]++["')\]]*+)[{WS}]++""", "$1" + _BREAK
    )
    return F.filter(F.transform(F.split(marked, _BREAK), strip), lambda s: s != "")


def space_words(text: Column) -> Column:
    """Number of white-space separated words. Spark compiles a pattern again for each element of an
    array, so this one goes without."""
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.filter(F.split(blanks, " "), lambda w: w != ""))


def has_odd_blanks(texts: Column) -> Column:
    """Whether any text of an array holds white space other than blanks and line ends."""
    return F.array_join(texts, "").rlike(ODD_BLANKS)


def plain_words(text: Column) -> Column:
    """`space_words` of a text without odd blanks: it is not translated character by character."""
    return F.size(F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != ""))
