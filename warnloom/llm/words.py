"""Words, hashes and Arrow plumbing shared by the operators of this package.

A word is a run of characters other than the ASCII white space `[\\x20\\x09-\\x0D]`. On UTF-8 bytes
that is exactly what `bytes.split()` gives, and `bytes.lower()` lowers A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda word: word != "")


def crc_part(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of about `most` bytes of text or one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all `width`-word windows, in order; of the whole sequence where it has fewer words."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(hashes))):
        out = mix(out * np.uint64(3) + hashes[k : k + n] + np.uint64(k + 1))
    return out


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
