"""Joins of a large table with a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000
SALTS = 16


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether `df` has at most `max_rows` rows. A whole count: one number from each partition. A limit
    would count less but bring the rows themselves to one task."""
    return df.count() <= max_rows


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: list[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join `big` to `lookup` (few rows per key) without moving or piling up `big` rows.

    A lookup table counted to be small is broadcast. A larger one is shuffled, with every lookup
    row repeated for each salt and big rows spread over the salts by a hash of `spread_by`, so a
    key that a third of all rows share still lands in `salts` partitions. The hash depends on row
    values only: a recomputed task sends its rows to the same place. A merge join is asked for, as the
    optimizer takes the repeated rows to be as small as the lookup table's file and would broadcast them.
    """
    if is_small(lookup, broadcast_rows):
        return big.join(F.broadcast(lookup), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
