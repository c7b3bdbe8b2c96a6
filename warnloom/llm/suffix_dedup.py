"""Removal of repeated byte strings by a column-wise suffix array of many short strings.

Every string of `length` bytes (a window) belongs to the segment of neighbouring windows that share their anchor: the
least hash in the window of a string of about half as many bytes. Equal windows have equal anchors, so segments are sent to shards
by their anchor, and no two equal windows end up apart. Two exchanges do it:

1. Blocks of documents send the anchors' hashes, once each, and learn which of them occur in another document. This
   only leaves out segments that can't repeat anything; a chance equality costs some work, no more. They also learn which
   anchors are very frequent: windows of those go by a hash of their own, each a segment, as there is no end to the
   different surroundings of a passage that a third of all documents hold.
2. Of the others a block sends each different segment once, with its first document. A shard takes the segments of its
   anchors in collections, and builds the Burrows-Wheeler transform and the common prefixes of each column by column: every
   round inserts one symbol of each string, from its end, as one sequential pass over the arrays so far. Where
   `length` bytes are common to neighbours, the least document of the run is the first to hold the window. A segment that
   is alone with its anchor shares no window with another, and needs no place in a collection.

A block then marks the windows that begin in a document before. A passage that a third of all documents hold is sent
once for each block, not for each document; a shard holds about SHARD_SEGMENTS segments. Messages are sorted by hash
and cut at the shards' edges; there are never more of them than segments, however many blocks and shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .ngram_lm import deltas, pack, planes, undeltas, unpack, unplanes
from .words import mix, pieces, utf8

LENGTH = 50
BLOCK_BYTES = 4 << 20
SLICE = 1 << 20
# Segments of periodic texts would never end; so many windows are enough for one.
SEGMENT_WINDOWS = 64
CODE_BITS = 48
SHARD_CODES = 4_000_000
SHARD_SEGMENTS = 200_000
# Segments of an anchor beyond which its windows go one by one.
FREQUENT = 20_000
# Strings of a collection, few enough for its arrays to stay in a processor's cache.
COLLECTION = 5_000
LAST = (1 << 63) - 1


def anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes, put together from those of powers of two."""
    power = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power ^= power >> np.uint64(29)
    out, done, step = None, 0, 1
    while True:
        if size & step:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(0xBF58476D1CE4E5B9) + power[done:]
                out ^= out >> np.uint64(31)
            done += step
        if done == size:
            return out
        power = power[:-step] * np.uint64(0x94D049BB133111EB) + power[step:]
        power ^= power >> np.uint64(30)
        step *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values if step == width else np.minimum(values[: step - width], values[width - step :])


def segments(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows, code (CODE_BITS of the anchor) and document of each segment of texts that lie one
    after another, as far as `ends`. Windows don't cross texts."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = np.concatenate([sliding_least(anchor_hashes(data[s : s + SLICE + length - 1], anchor), length - anchor + 1) for s in range(0, n, SLICE)])
    new = np.append(True, least[1:] != least[:-1])
    for edge in (ends[:-1], ends - length + 1):
        new[edge[(edge >= 0) & (edge < n)]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    doc = np.searchsorted(ends, start, "right")
    inside = start + length <= ends[doc]
    start, size, doc = start[inside], size[inside], doc[inside]
    parts = -(-size // SEGMENT_WINDOWS)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(size, parts)
        start, doc = np.repeat(start, parts) + nth * SEGMENT_WINDOWS, np.repeat(doc, parts)
        size = np.minimum(SEGMENT_WINDOWS, whole - nth * SEGMENT_WINDOWS)
    return start, size, mix(least[start]) >> np.uint64(64 - CODE_BITS), doc


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of codes."""
    return ((codes >> np.uint64(CODE_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def ranges(codes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted codes, each with where its codes stand."""
    some, first = np.unique(shard_of(codes, shards), return_index=True)
    for shard, a, b in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(codes)]):
        yield shard, slice(a, b)


class Collection:
    """The sorted suffixes of strings of at most 255 bytes, over at most 255 different ones. A suffix is a row of eight bytes,
    so that a round moves all of it at once: `string` (which one's suffix), `size` (how long), `lcp` (bytes in common with the
    suffix before, `most` at most) and `bwt` (the symbol before it, by its place in `alphabet` from 1; 0 before whole
    strings). Equal suffixes are ordered by string."""

    def __init__(self, strings: list[bytes], most: int):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.alphabet = np.unique(data)
        if len(self.alphabet) > 255 or len(strings) and self.sizes.max() > 255:
            raise ValueError("more than 255 different bytes, or a string that is longer")
        code = np.zeros(256, np.uint8)
        code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.data, self.ends = code[data], np.cumsum(self.sizes)
        n = len(strings)
        every = np.arange(n)
        self.rows = self.packed(every, 0, np.zeros(n, np.uint8), self.before(every, 0))
        newest = every
        for length in range(1, int(self.sizes.max(initial=0)) + 1):
            newest = self.insert(length, newest, most)

    @staticmethod
    def packed(string: np.ndarray, size: int, lcp: np.ndarray, bwt: np.ndarray) -> np.ndarray:
        rows = string.astype("<u8")
        low = rows.view(np.uint8).reshape(-1, 8)
        low[:, 4], low[:, 5], low[:, 6] = size, lcp, bwt
        return rows

    @property
    def string(self) -> np.ndarray:
        return self.rows.view("<u4")[::2]

    def column(self, k: int) -> np.ndarray:
        return self.rows.view(np.uint8)[k::8]

    size = property(lambda self: self.column(4))
    lcp = property(lambda self: self.column(5))
    bwt = property(lambda self: self.column(6))

    def before(self, string: np.ndarray, size: int) -> np.ndarray:
        """The symbol before the suffix of that size, 0 where it is the whole string."""
        at = self.ends[string] - size - 1
        return np.where(self.sizes[string] > size, self.data[np.maximum(at, 0)] if len(self.data) else 0, 0).astype(np.uint8)

    def insert(self, length: int, newest: np.ndarray, most: int) -> np.ndarray:
        """One round: the suffixes of `length` symbols; `newest` and the result are where those of a round stand. In order of
        the symbol before them, and then of place, the suffixes so far are the nonempty ones after the round without
        their first symbol: that gives the new ones' places."""
        bwt, lcp = np.ascontiguousarray(self.bwt), np.append(self.lcp, np.uint8(0))
        order = np.argsort(bwt, kind="stable")
        whole = np.count_nonzero(bwt == 0)
        longer = np.zeros(len(bwt), bool)
        longer[newest] = bwt[newest] != 0
        at = np.flatnonzero(longer[order])
        source = order[at]
        symbol = bwt[source]
        # A new suffix has one symbol more in common with its neighbour than the two have without it, if that begins with the same one.
        last, following = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        left = common(lcp, last, source, (at > 0) & (bwt[last] == symbol), most)
        right = common(lcp, source, following, (at + 1 < len(order)) & (bwt[following] == symbol), most)
        place = len(self.sizes) + at - whole
        string = self.string[source].astype(np.int64)
        old = np.ones(len(bwt) + len(at) + 1, bool)
        old[place] = False
        next_old = old[place + 1] & (place + 1 < len(old) - 1)
        merged = np.empty(len(old) - 1, self.rows.dtype)
        merged[old[:-1]], merged[place] = self.rows, self.packed(string, length, left, self.before(string, length))
        self.rows = merged
        self.lcp[place[next_old] + 1] = right[next_old]  # where the next one is new too, its own value stands
        return place

    def first_of(self, owner: np.ndarray, length: int) -> np.ndarray:
        """For every window of `length` of all strings in order the least owner of a string that holds it."""
        windows = np.maximum(self.sizes - length + 1, 0)
        base = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), owner.dtype)
        some = np.flatnonzero(self.size >= length)
        if len(some):
            string, size = self.string[some].astype(np.int64), self.size[some].astype(np.int64)
            # A suffix that shares `length` symbols with the one before is of that length, and so is that.
            begins = self.lcp[some] < length
            run = np.cumsum(begins) - 1
            least = np.minimum.reduceat(owner[string], np.flatnonzero(begins))
            out[base[string] + self.sizes[string] - size] = least[run]
        return out


def common(lcp: np.ndarray, a: np.ndarray, b: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """One more than the least common prefix between places a < b, `most` at most; 0 where not wanted. `lcp` ends in one value more."""
    out = np.zeros(len(a), np.uint8)
    pick = np.flatnonzero(wanted)[::-1]  # backwards, so that reduceat sees little between the ranges
    if len(pick):
        edges = np.column_stack([a[pick] + 1, b[pick] + 1]).reshape(-1)
        out[pick] = np.minimum(np.minimum.reduceat(lcp, edges)[::2], most - 1) + np.uint8(1)
    return out


def text_blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """block, ids (nulls last: the greatest number), sizes, data: some MB of texts in a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "_text", BLOCK_BYTES):
            texts = utf8(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([batch.column("_id").to_pylist()], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
                 pa.array([pack(np.frombuffer(b"".join(texts), np.uint8))], pa.binary())],
                ["block", "ids", "sizes", "data"],
            )
            block += 1

    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.col(text).alias("_text"))
    return stage(read.mapInArrow(cut, "block bigint, ids array<bigint>, sizes array<bigint>, data binary"), "text-blocks")


class Block:
    """A row of `text_blocks` with its segments."""

    def __init__(self, row: dict, length: int, anchor: int):
        self.block, self.ids, self.sizes = row["block"], np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.length = length
        self.data = unpack(row["data"], int(self.sizes.sum()), np.uint8)
        self.start, self.windows, code, self.doc = segments(self.data, self.ends, length, anchor)
        self.codes, self.code = np.unique(code, return_inverse=True)

    def counts(self) -> np.ndarray:
        """How many segments have each code; 1 where all are of one text."""
        low = np.full(len(self.codes), len(self.sizes))
        np.minimum.at(low, self.code, self.doc)
        several = np.zeros(len(self.codes), bool)
        several[self.code[self.doc != low[self.code]]] = True
        return np.where(several, np.bincount(self.code, minlength=len(self.codes)), 1)

    def keep(self, kinds: np.ndarray) -> None:
        """Go on with the segments of some codes (kind 1; of kind 2: window by window), and number their different strings,
        in order of the codes."""
        kind = kinds[self.code]
        start, windows, doc, code = (x[kind == 1] for x in (self.start, self.windows, self.doc, self.codes[self.code]))
        if (kind == 2).any():
            size, many = self.windows[kind == 2], np.flatnonzero(kind == 2)
            each = np.repeat(self.start[many], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            own = np.concatenate([mix(anchor_hashes(self.data[np.add.outer(each[s : s + SLICE // 64], np.arange(self.length))].reshape(-1), self.length)[:: self.length]) for s in range(0, len(each), SLICE // 64)])
            start, windows, doc, code = (
                np.concatenate(x) for x in ((start, each), (windows, np.ones(len(each), np.int64)), (doc, np.repeat(self.doc[many], size)), (code, own >> np.uint64(64 - CODE_BITS)))
            )
        order = np.argsort(code, kind="stable")
        self.start, self.windows, self.doc, code = start[order], windows[order], doc[order], code[order]
        whole, number = self.data.tobytes(), {}
        tail = self.length - 1
        self.number = np.fromiter((number.setdefault(whole[a : a + n + tail], len(number)) for a, n in zip(self.start.tolist(), self.windows.tolist())), np.int64, len(code))
        self.strings = list(number)
        first = np.unique(self.number, return_index=True)[1]
        self.string_codes, self.string_windows = code[first], self.windows[first]
        self.owner = np.full(len(self.strings), LAST)
        np.minimum.at(self.owner, self.number, self.ids[self.doc])

    def spans(self, first: np.ndarray) -> tuple[list[list[dict]], list[bytes]]:
        """By text, the runs of bytes covered by windows that begin in a text of a lesser id, and what is left. `first`: the
        least id for every window of the strings in order."""
        base = np.cumsum(self.string_windows) - self.string_windows
        nth = np.arange(self.windows.sum()) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        repeat = first[np.repeat(base[self.number], self.windows) + nth] < np.repeat(self.ids[self.doc], self.windows)
        at = (np.repeat(self.start, self.windows) + nth)[repeat]
        cover = np.bincount(at, minlength=len(self.data) + 1)[: len(self.data) + 1] - np.bincount(at + self.length, minlength=len(self.data) + 1)[: len(self.data) + 1]
        gone = np.cumsum(cover)[:-1] > 0
        begins = self.ends - self.sizes
        edge = np.zeros(len(self.data) + 1, bool)
        edge[begins] = True
        before = np.concatenate([[False], gone[:-1]])
        starts = np.flatnonzero(gone & (~before | edge[:-1]))
        after = np.append(gone[1:], False)
        stops = np.flatnonzero(gone & (~after | edge[1:])) + 1
        doc = np.searchsorted(self.ends, starts, "right")
        spans: list[list[dict]] = [[] for _ in self.sizes]
        for d, a, b in zip(doc.tolist(), (starts - begins[doc]).tolist(), (stops - begins[doc]).tolist()):
            spans[d].append({"start": a, "end": b})
        left = self.data[~gone].tobytes()
        stop = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([begins, self.ends[-1:]])].tolist()
        return spans, [left[a:b] for a, b in zip(stop, stop[1:])]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def shared_codes(blocks: DataFrame, length: int, anchor: int, n_bytes: int) -> DataFrame:
    """block, shared (by shard, for each code of the block's in order: 1 if another text has it, 2 if very many do, else 0)."""
    shards = max(1, -(-2 * n_bytes // (length - anchor + 2) // SHARD_CODES))
    names = ["shard", "block", "n", "codes", "counts"]
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row, length, anchor)
            counts = block.counts()
            for shard, at in ranges(block.codes, shards):
                values = shard, block.block, at.stop - at.start, deltas(block.codes[at]), planes(counts[at].astype(np.uint32))
                yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        codes = [undeltas(r["codes"], r["n"]) for r in rows]
        every = np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        total = np.add.reduceat(np.concatenate([unplanes(r["counts"], r["n"], np.uint32) for r in rows])[order].astype(np.int64), first)
        every, kinds = every[first], (total >= 2).astype(np.uint8) + (total > FREQUENT)
        told = [planes(kinds[np.searchsorted(every, c)]) for c in codes]
        shared = [int(np.count_nonzero(unplanes(t, len(c), np.uint8))) for t, c in zip(told, codes)]
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "shard": group.column("shard"), "n": group.column("n"), "n_shared": pa.array(shared, pa.int64()), "kinds": pa.array(told, pa.binary())})

    asked = blocks.mapInArrow(request, "shard bigint, block bigint, n bigint, codes binary, counts binary")
    told = asked.groupBy("shard").applyInArrow(answer, "block bigint, shard bigint, n bigint, n_shared bigint, kinds binary")
    return stage(told, "shared-codes").groupBy("block").agg(F.sum("n_shared").alias("n_shared"), F.sort_array(F.collect_list(F.struct("shard", "n", "kinds"))).alias("shared"))


def with_shared(row: dict, length: int, anchor: int) -> Block:
    block = Block(row, length, anchor)
    block.keep(np.concatenate([np.zeros(0, np.uint8), *[unplanes(x["kinds"], x["n"], np.uint8) for x in row["shared"] or []]]))
    return block


def first_windows(strings: list[bytes], codes: np.ndarray, owner: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the strings the least owner of a string that holds it; with where each string's begin, and their number.
    Strings of different codes hold no window in common."""
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    base = np.cumsum(windows) - windows
    first = np.repeat(owner, windows)
    order = np.argsort(codes, kind="stable")
    begins = np.flatnonzero(np.diff(codes[order], prepend=~codes[order][:1]))
    sizes = np.diff(np.append(begins, len(order)))
    part = np.flatnonzero(sizes > 1)
    if len(part):
        # Codes with several strings, cut into collections at a code's edge.
        cut = np.flatnonzero(np.diff(np.cumsum(sizes[part]) // most, prepend=-1))
        for some in np.split(part, cut[1:]):
            held = order[np.concatenate([np.arange(begins[k], begins[k] + sizes[k]) for k in some])]
            found = Collection([strings[i] for i in held.tolist()], length).first_of(owner[held], length)
            size = windows[held]
            first[np.repeat(base[held] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = found
    return first, base, windows


def first_holders(blocks: DataFrame, length: int, anchor: int, shards: int) -> DataFrame:
    """block, firsts (by shard: the least id for every window of the block's strings, in order)."""
    names = ["shard", "block", "n", "codes", "sizes", "owners", "bytes", "strings"]
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()), ("bytes", pa.int64()), ("strings", pa.binary())])

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = with_shared(row, length, anchor)
            for shard, at in ranges(block.string_codes, shards):
                strings = b"".join(block.strings[at])
                sizes = planes((block.string_windows[at] + length - 1).astype(np.uint8))
                values = shard, block.block, at.stop - at.start, deltas(block.string_codes[at]), sizes, planes(block.owner[at]), len(strings), pack(np.frombuffer(strings, np.uint8))
                yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema)

    def answer(group: pa.Table) -> pa.Table:
        rows, number, numbers = group.to_pylist(), {}, []
        owner, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for r in rows:
            sizes, data = unplanes(r["sizes"], r["n"], np.uint8).astype(np.int64), unpack(r["strings"], r["bytes"], np.uint8).tobytes()
            ends = np.cumsum(sizes)
            at = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist())), np.int64, r["n"])
            new = np.flatnonzero(at >= len(owner))  # each once, in order: a row's strings differ
            owner, codes = np.append(owner, np.full(len(new), LAST)), np.append(codes, undeltas(r["codes"], r["n"])[new])
            np.minimum.at(owner, at, unplanes(r["owners"], r["n"], np.int64))
            numbers.append(at)
        first, base, windows = first_windows(list(number), codes, owner, length, COLLECTION)
        told, counts = [], []
        for at in numbers:
            size = windows[at]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            told.append(planes(first[np.repeat(base[at], size) + nth]))
            counts.append(int(size.sum()))
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "n": pa.array(counts, pa.int64()), "first": pa.array(told, pa.binary())})

    asked = blocks.mapInArrow(request, "shard bigint, block bigint, n bigint, codes binary, sizes binary, owners binary, bytes bigint, strings binary")
    told = asked.groupBy("shard").applyInArrow(answer, "block bigint, shard bigint, n bigint, first binary")
    return stage(told, "first-holders").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "first"))).alias("firsts"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of `docs` its id (as a long), n_bytes (UTF-8), spans (start, end: the maximal runs of bytes covered by a
    string of `length` bytes that also begins in a row of a lesser id) and kept, the other bytes.

    A null or empty text has no bytes and no spans; texts shorter than `length` repeat nothing. Null ids come after all
    others. Rows of one id don't repeat each other. Strings are those of the input, whatever is removed of it."""
    if not 2 <= length <= 255 - SEGMENT_WINDOWS:
        raise ValueError(f"length {length}")
    anchor = max(1, length // 2 - 1)
    blocks = text_blocks(docs, id_col, text)
    add = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    n_bytes = blocks.agg(F.sum(add(F.col("sizes")))).first()[0] or 0
    shared = shared_codes(blocks, length, anchor, n_bytes)
    told = stage(shared, "block-codes")
    codes = told.agg(F.sum("n_shared")).first()[0] or 0
    told = told.drop("n_shared")
    known = blocks.join(told, "block", "left")
    firsts = first_holders(known, length, anchor, max(1, -(-codes // SHARD_SEGMENTS)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = with_shared(row, length, anchor)
            first = np.concatenate([np.zeros(0, np.int64), *[unplanes(x["first"], x["n"], np.int64) for x in row["firsts"] or []]])
            spans, kept = block.spans(first)
            ids = [None if x == LAST else x for x in row["ids"]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])

    out = blocks.join(told.join(firsts, "block", "left"), "block", "left").mapInArrow(mark, "_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def dedupe_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of `docs`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeated_spans(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def dedupe_sql(length: int = LENGTH) -> str:
    """The same in SQL, on hex digits: two for each byte. Texts are cut into pieces first, as finding a place in a long one takes time."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k * 512 AS o, substr(h, (k * 1024 + 1)::BIGINT, {1024 + 2 * length - 2}) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1024 + 1)) AS k FROM t)),
w AS (SELECT doc_id, o + j AS i, substr(p, (2 * j + 1)::BIGINT, {2 * length}) AS s FROM (SELECT doc_id, o, p, unnest(range(0, length(p) // 2 - {length - 1})) AS j FROM c)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i, i > lag(i, 1, -{length + 1}) OVER (PARTITION BY doc_id ORDER BY i) + {length} AS new FROM w JOIN m USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x),
s AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM s),
r AS (SELECT t.doc_id, any_value(h) AS h, coalesce(sum(b - a), 0)::BIGINT AS n, count(a) AS spans, max(b) AS last,
      coalesce(string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a), '') AS kept FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n AS n_removed, spans::BIGINT AS n_spans,
       sha256(unhex(kept || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM r"""
