"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str methods and regexes see it, as a trim list and as a regex class body.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same without the blank and the line end.
ODD_BLANKS = "[" + WS.replace(r"\x09-\x0d", r"\x09\x0b-\x0d").replace(r"\x1c-\x20", r"\x1c-\x1f") + "]"
# One word character, Unicode-aware whatever the JDK's own \w and \b cover.
WORD = r"[\p{L}\p{N}_]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once per row however often `body` mentions it.

    Inside a higher-order function an outer expression would be recomputed for every element;
    passing it through a one-element `transform` turns it into a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(words) -> str:
    return "array(" + ", ".join(sql_text(word) for word in words) + ")"


def literal_array(words) -> Column:
    return F.expr(sql_array(words))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_per_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element for each key, in the original order.

    Sort by (key, position), keep elements whose key differs from their left neighbour's, sort
    back: n log n, so an array with very many elements stays affordable.
    """
    keyed = F.sort_array(
        F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    )
    firsts = bind(
        keyed,
        lambda s: F.filter(
            s, lambda e, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["k"] != e["k"])
        ),
    )
    in_order = F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"], e["x"])))
    return F.transform(in_order, lambda e: e["x"])


_DEDUPE_CI = """
get(transform(array(array_distinct({values})), v ->
  CASE WHEN size(array_distinct(transform(v, x -> lower(x)))) = size(v) THEN v
  ELSE get(transform(
    array(sort_array(transform(v, (x, i) -> struct(lower(x) AS k, i AS i, x AS x)))), s ->
      transform(
        sort_array(transform(
          filter(s, (e, i) -> i = 0 OR get(s, greatest(i - 1, 0)).k <> e.k),
          e -> struct(e.i, e.x))),
        e -> e.x)), 0)
  END), 0)
"""


def dedupe_ci(values: str) -> Column:
    """Drop case-insensitive repeats from a string array (a column or SQL expression), keeping first
    casing and order. Only arrays where casing varies are sorted, as in `first_per_key`."""
    return F.expr(_DEDUPE_CI.format(values=values))
