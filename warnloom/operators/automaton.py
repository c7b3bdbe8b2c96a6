"""Many phrases searched for at once: an Aho-Corasick automaton run over the texts of Arrow batches.

A list of phrases is counted first. It is sent to the tasks in parts of bounded size, each a pass of its own over
the rows it adds to, so a list of any length takes bounded memory. A worker compiles a part once and keeps it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from .rows import row_slices

MOST_PHRASES = 50_000


_MADE: dict[str, ahocorasick.Automaton] = {}


class Phrases:
    """A list of phrases, sent to the tasks as it is; a worker compiles it when it first searches and keeps the last few."""

    def __init__(self, phrases: list[str]):
        self.phrases, self.key = phrases, uuid.uuid4().hex

    def matches(self, text: str | None) -> Iterator[tuple[int, int]]:
        """(last character, place in the list) of every occurrence, overlapping ones too."""
        if not text or not self.phrases:
            return iter(())
        if self.key not in _MADE:
            while len(_MADE) >= 4:
                _MADE.pop(next(iter(_MADE)))
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, phrase in enumerate(self.phrases):
                made.add_word(phrase, i)
            made.make_automaton()
            _MADE[self.key] = made
        return _MADE[self.key].iter(text)


def parts(phrases: DataFrame, keys: list[str], most: int = MOST_PHRASES) -> list[list]:
    """The rows of `phrases` in lists of about `most`: rows of equal keys are in one."""
    n = max(1, -(-phrases.count() // most))
    return [phrases.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == k).collect() for k in range(n)]


def with_computed(df: DataFrame, out: str, kind: str, by: Column, compute: Callable[[list], list]) -> DataFrame:
    """`df` with the column `out` of type `kind`: what `compute` makes of the values of `by` in some rows. Other columns pass
    through; one of that name is replaced."""
    read = df.withColumn("_by", by).drop(out)
    made: DataType = _parse_datatype_string(kind)
    arrow = to_arrow_type(made, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            found = pa.array(compute(batch.column(batch.num_columns - 1).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], out])

    return read.mapInArrow(run, read.drop("_by").schema.add(out, made))
