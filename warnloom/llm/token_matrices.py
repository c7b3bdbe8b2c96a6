"""Token ids packed into matrices, best fit decreasing.

Each task tokenises its documents in blocks of bounded size, splits overlong ones without losing a token,
and packs the pieces from long to short into rows of one length. A segment tree over the space left finds
the row that a piece fills best. Nothing is shuffled: a block's matrices come from the task that read
it, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

# Fixed value: how the byte-level vocabularies cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class CapacityTree:
    """Which amounts of space are left, from 0 to `most`: the least that is enough is found by one way up and
    one down a binary tree of flags."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, space: int, there: bool) -> None:
        at = self.leaves + space
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least(self, size: int) -> int | None:
        """The least space of at least `size`."""
        at = self.leaves + size
        while not self.any[at]:
            while at & 1:  # a right child: what follows lies further up
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def pack_rows(sizes: list[int], length: int) -> list[list[int]]:
    """Pieces by row, best fit decreasing."""
    tree, rows, by_space = CapacityTree(length), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        space = tree.least(sizes[i])
        if space is None:
            row, space = len(rows), length
            rows.append([])
        else:
            row = by_space[space].pop()
            if not by_space[space]:
                tree.set(space, False)
        rows[row].append(i)
        left = space - sizes[i]
        by_space.setdefault(left, []).append(row)
        tree.set(left, True)
    return rows


SCHEMA = "matrix_id bigint, n_rows int, row_length int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<int>"


def matrices(doc_ids: list, tokens: list[np.ndarray], length: int, rows_each: int, pad: int) -> Iterator[dict]:
    """Pack documents into matrices of at most `rows_each` rows. Segments (a piece, or the padding that ends
    a row) follow one another through the flattened matrix; `cu_seqlens` has where they begin and end, doc_ids
    and starts the document and first token of each, -1 as start for padding."""
    cut = [(d, s, min(length, len(t) - s)) for d, t in enumerate(tokens) for s in range(0, max(len(t), 1), length)]
    rows = pack_rows([n for _, _, n in cut], length)
    for at in range(0, len(rows), rows_each):
        some = rows[at : at + rows_each]
        ids = np.full((len(some), length), pad, np.uint16)
        positions = np.zeros((len(some), length), np.uint16)
        ends, docs, starts = [0], [], []
        for r, row in enumerate(some):
            column = 0
            for i in row:
                d, s, n = cut[i]
                ids[r, column : column + n] = tokens[d][s : s + n]
                positions[r, column : column + n] = np.arange(n)
                column += n
                ends.append(r * length + column)
                docs.append(doc_ids[d])
                starts.append(s)
            if column < length:
                positions[r, column:] = np.arange(length - column)
                ends.append((r + 1) * length)
                docs.append(None)
                starts.append(-1)
        yield {"n_rows": len(some), "row_length": length, "ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": ends, "doc_ids": docs, "starts": starts}


def packed_matrices(docs: DataFrame, ranks: str, length: int = 2048, rows_each: int = 64, block_bytes: int = 4 << 20, pad: int = 65_535, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Matrices of token ids (little-endian uint16, row by row), of their positions within segments, which start
    anew at each, cumulative segment lengths, and each segment's document and first token.

    `ranks` is the path of a byte-level vocabulary in rank form, with fewer than 65,535 ids, that all workers
    can read. A null or empty text is a segment of no length, so that every document has one; repeated
    rows are packed as often as they come. Texts with a lone surrogate can't occur in Spark strings."""
    if length > 65_535:
        raise ValueError("positions are 16-bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        encode = encoder(ranks).encode_ordinary
        for batch in pieces(batches, "_text", block_bytes):
            tokens = [np.array(encode(t), np.uint16) for t in batch.column("_text").to_pylist()]
            for matrix in matrices(batch.column("_id").to_pylist(), tokens, length, rows_each, pad):
                yield pa.RecordBatch.from_pylist([{"matrix_id": number, **matrix}], schema)
                number += 1

    schema = pa.schema(
        [("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("row_length", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
         ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32()))]
    )
    read = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return read.mapInArrow(run, SCHEMA)


def unpack(row) -> list[tuple[int | None, int, np.ndarray]]:
    """(document, first token, ids) of each segment of a matrix but the padding."""
    flat = np.frombuffer(bytes(row["ids"]), np.uint16)
    ends = row["cu_seqlens"]
    return [(d, s, flat[a:b]) for d, s, a, b in zip(row["doc_ids"], row["starts"], ends[:-1], ends[1:], strict=True) if s >= 0]
