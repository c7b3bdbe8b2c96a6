"""Arrays to rows.

`explode` lets the optimizer filter on the array's size ahead of it. Where the array is computed in
the same query that filter recomputes it, text scans included, all the way down at the source. The
outer variant is left alone; rows for empty arrays are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_rows(df: DataFrame, keep, array: Column | str, value: str, pos: str | None = "pos") -> DataFrame:
    """One row for each element: the kept columns, its position, its value."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).filter("_pos IS NOT NULL")
    if pos is None:
        return rows.drop("_pos")
    return rows.select(*keep, F.col("_pos").alias(pos), value)


def struct_rows(df: DataFrame, keep, array: Column | str, pos: str | None = None) -> DataFrame:
    """One row for each struct of an array: the kept columns, optionally its position, its fields."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    rows = element_rows(df, keep, array, "_x", pos)
    return rows.select(*keep, *([pos] if pos else []), "_x.*")


def newest_first(reports: DataFrame) -> list[Column]:
    """The order of reports by time, then id. Ids alone say nothing of time: those of files are hashes.
    Reports that were never saved have no time and go by id."""
    return [F.desc(c) for c in ("created_at", "report_id") if c in reports.columns]


def row_slices(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, at most so many at a time: what a task makes of them then takes little memory at once, however full the
    batches are that Spark sends."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
