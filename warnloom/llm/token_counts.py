"""Token counts by a tokenizer compiled into two deterministic transducers.

* A boundary transducer over character classes finds where a byte-level BPE tokenizer cuts a text
  before merging. Each transition is annotated with the cuts it makes. Texts are read in chunks; a
  chunk is first turned into a state map (for every entry state, the state it leaves in), the maps
  are composed by a parallel prefix scan, and with all entry states known every chunk is run once more
  for its cuts.
* Added tokens of the vocabulary file stand outside of both, as in the library: a text is split at them first,
  each is one token, and nothing is cut or merged across one.
* A counting transducer over bytes: a state is a prefix, annotated with its last token and the number of
  tokens of its encoding. The last token of a longer prefix is the one suffix token that can follow
  the encoding of what stands before it, so a transition adds one to the count of an earlier state.

Nulls and empty texts have no tokens. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

# The Unicode white space characters.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that are tokens of their own after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

# Classes of characters, and the state in which each opens a new piece.
CLASSES = ("letter", "number", "other", "space", "white", "apostrophe", "short", "r", "v", "l", "e", "end")
CHUNK = 64
CACHE = 300_000


class Boundaries:
    """The boundary transducer: `next` and `cuts` by state and class. A cut of 1 stands before the
    character just read, of 2 before the one ahead of it, of 3 before both."""

    STATES = ("new", "letters", "numbers", "others", "space", "white", "spaces", "whites", "apostrophe", "r", "v", "l")

    def __init__(self):
        state = {name: i for i, name in enumerate(self.STATES)}
        opens = {"number": "numbers", "other": "others", "space": "space", "white": "white", "apostrophe": "apostrophe"}
        joins = {"number": "numbers", "other": "others", "apostrophe": "others"}
        gaps = {"space": "spaces", "white": "whites"}

        def step(at: str, kind: str) -> tuple[str, int]:
            if kind == "end":
                return "new", 3 if at in "rvl" else 1
            if at == "new":
                return opens.get(kind, "letters"), 1
            if at in ("letters", "numbers", "others"):
                same = joins.get(kind, "letters" if kind not in gaps else "") == at
                if at == "letters" and kind == "apostrophe":
                    same = False
                return (at, 0) if same else (opens.get(kind, "letters"), 1)
            if at in ("space", "white", "spaces", "whites"):
                if kind in gaps:
                    return gaps[kind], 0
                before = 2 if at in ("spaces", "whites") else 0
                if at in ("space", "spaces"):
                    return joins.get(kind, "letters"), before
                return opens.get(kind, "letters"), before | 1
            if at == "apostrophe":
                if kind == "short":
                    return "new", 0
                if kind in "rvl":
                    return kind, 0
                return ("others", 0) if kind in ("other", "apostrophe") else (opens.get(kind, "letters"), 1)
            if kind == {"r": "e", "v": "e", "l": "l"}[at]:
                return "new", 0
            then, cut = step("letters", kind)
            return then, cut | 2

        steps = [[step(at, kind) for kind in CLASSES] for at in self.STATES]
        self.next = np.array([[state[s] for s, _ in row] for row in steps], np.uint8)
        self.cuts = np.array([[c for _, c in row] for row in steps], np.uint8)
        self.number_maps()

    def number_maps(self) -> None:
        """All state maps that texts can have, numbered from that of the empty text, with tables for
        one more character and for one map after another."""
        maps = [tuple(range(len(self.STATES)))]
        number = {maps[0]: 0}
        extend = []
        for at in maps:  # grows
            for kind in range(len(CLASSES)):
                then = tuple(int(self.next[s, kind]) for s in at)
                if then not in number:
                    number[then] = len(maps)
                    maps.append(then)
                extend.append(number[then])
        self.maps = np.array(maps, np.uint8)
        self.extend = np.array(extend, np.intp)
        self.compose = np.array([number[tuple(map(b.__getitem__, a))] for a in maps for b in maps], np.intp)

    @staticmethod
    @lru_cache(1)
    def classes() -> np.ndarray:
        kind = {name: i for i, name in enumerate(CLASSES)}
        by_category = {"L": kind["letter"], "N": kind["number"]}
        out = np.fromiter((by_category.get(unicodedata.category(chr(c))[0], kind["other"]) for c in range(sys.maxunicode + 1)), np.uint8)
        out[WHITE] = kind["white"]
        out[ord(" ")], out[ord("'")], out[ord("e")] = kind["space"], kind["apostrophe"], kind["e"]
        for ending in ENDINGS:
            out[ord(ending[0])] = kind["short" if len(ending) == 1 else ending[0]]
        return out

    def chunk_maps(self, rows: np.ndarray) -> np.ndarray:
        """The state map of each chunk, by its number."""
        at = np.zeros(len(rows), np.intp)
        for column in rows.T:
            at = self.extend.take(at * len(CLASSES) + column)
        return at

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """Prefix compositions of the maps, by doubling."""
        maps, reach = maps.copy(), 1
        while reach < len(maps):
            maps[reach:] = self.compose.take(maps[:-reach] * len(self.maps) + maps[reach:])
            reach *= 2
        return maps

    def cut_before(self, codes: np.ndarray) -> np.ndarray:
        """The positions before which a text is cut; `codes` are classes, starting in state "new"."""
        n = len(codes)
        pad = -n % CHUNK
        rows = np.concatenate([codes, np.full(pad, CLASSES.index("end"), np.uint8)]).reshape(-1, CHUNK)
        through = self.scan(self.chunk_maps(rows))
        at = np.concatenate([np.zeros(1, np.intp), self.maps[through[:-1], 0]]).astype(np.intp)
        cuts = np.empty((CHUNK, len(rows)), np.uint8)
        nexts, marks = self.next.reshape(-1).astype(np.intp), self.cuts.reshape(-1)
        for j, column in enumerate(rows.T):
            key = at * len(CLASSES) + column
            cuts[j] = marks.take(key)
            at = nexts.take(key)
        flat = cuts.T.reshape(-1)
        before = (flat & 1).astype(bool)
        before[:-1] |= (flat[1:] & 2).astype(bool)
        return np.flatnonzero(before[:n])


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTransducer(dict):
    """Tokens of a piece of text, for a byte-level BPE vocabulary. As a dict it remembers the counts of
    short pieces, up to a bound; states of the transducer are dropped with them."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, self.added = whole["model"], whole.get("added_tokens") or []
        names = byte_names()
        read = lambda token: bytes(names[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(read(a), read(b)): i for i, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}
        self.ids = {read(a + b): model["vocab"][a + b] for a, b in merges}
        self.ids |= {bytes([b]): model["vocab"][c] for c, b in names.items()}
        self.endings = {token[i:] for token in self.ids for i in range(len(token))}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.moves: dict[int, int] = {}
        self.last: list[bytes] = [b""]
        self.count: list[int] = [0]

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by repeated merging, to see that a token is reached at all."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of a token at its first (0) or last (1) byte, each with the ranks of the merges
        that make it and take it up."""
        known = self.spines.get((token, side))
        if known is None:
            known, until = [], 1 << 60
            while token:
                pair = self.parts.get(token)
                made = self.rank[pair] if pair else -1
                known.append((token, made, until))
                token, until = pair[side] if pair else b"", made
            self.spines[known[0][0], side] = known
        return known

    def joined(self, left: bytes, right: bytes) -> bool:
        """Whether merging would join two neighbouring tokens at a time when both sides stand ready;
        of equal pairs the one to the left goes first."""
        for a, a_made, a_until in self.spine(left, 1):
            for b, b_made, b_until in self.spine(right, 0):
                rank = self.rank.get((a, b), -1)
                if rank > a_made and rank > b_made and rank < a_until and rank <= b_until:
                    return True
        return False

    def may_follow(self, left: bytes, right: bytes) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            known = not self.joined(left, right) if left else self.merged(right) == [right]
            if len(self.follows) > CACHE:
                self.follows.clear()
            self.follows[left, right] = known
        return known

    def last_token(self, data: bytes, end: int, last_at) -> bytes:
        """The last token of the encoding of data[:end]; `last_at(i)` is that of data[:i]."""
        start, ids, endings = end - 1, self.ids, self.endings
        while start and data[start - 1 : end] in endings:
            start -= 1
        follows = self.follows
        while True:
            token = data[start:end]
            if token in ids:
                pair = (last_at(start), token)
                known = follows.get(pair)
                if known if known is not None else self.may_follow(*pair):
                    return token
            start += 1

    def run(self, data: bytes) -> int:
        """Count through remembered states."""
        if len(self.last) > 3 * CACHE:
            self.reset()
        path, state, moves = [0], 0, self.moves
        for end, byte in enumerate(data, 1):
            key = state << 8 | byte
            state = moves.get(key)
            if state is None:
                token = self.last_token(data, end, lambda i: self.last[path[i]])
                state = moves[key] = len(self.last)
                self.last.append(token)
                self.count.append(self.count[path[end - len(token)]] + 1)
            path.append(state)
        return self.count[state]

    def lasts(self, data: bytes) -> list[bytes]:
        """The last token of every prefix, without remembering states."""
        last = [b""]
        for end in range(1, len(data) + 1):
            last.append(self.last_token(data, end, last.__getitem__))
        return last

    def encode(self, piece: str) -> list[int]:
        """The ids of a piece's tokens."""
        data = piece.encode("utf-8", "replace")
        last, out, end = self.lasts(data), [], len(data)
        while end:
            out.append(self.ids[last[end]])
            end -= len(last[end])
        return out[::-1]

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8", "replace")
        if len(data) > 40:
            last, n, end = self.lasts(data), 0, len(data)
            while end:
                n, end = n + 1, end - len(last[end])
            return n
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = self.run(data)
        return n


@lru_cache(2)
def compiled(path: str) -> tuple[Boundaries, CountingTransducer]:
    return Boundaries(), CountingTransducer(path)


def cut_pieces(boundaries: Boundaries, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and where each text's pieces end."""
    codes, ends = [], []
    for text in texts:
        codes.append(Boundaries.classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
        codes.append(np.array([CLASSES.index("end")], np.uint8))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
    starts = boundaries.cut_before(flat)
    joined = "\0".join(texts) + "\0"
    cuts = starts.tolist()
    found = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
    marks = np.flatnonzero(flat[starts] == CLASSES.index("end")) if len(starts) else np.zeros(0, np.int64)
    ends = marks - np.arange(len(marks))
    keep = np.ones(len(found), bool)
    keep[marks] = False
    return [piece for piece, kept in zip(found, keep.tolist(), strict=True) if kept], ends


@lru_cache(4)
def splitter(path: str, encode_special_tokens: bool) -> re.Pattern | None:
    """Where texts are split at added tokens, of several that begin at one place the longest; None if at none.
    Special ones are left out where they are to be encoded like other text."""
    added = [t for t in compiled(path)[1].added if t["content"] and not (encode_special_tokens and t.get("special"))]
    odd = [t["content"] for t in added if any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"added tokens with conditions are not supported: {odd}")
    return re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True))) if added else None


def counts_of(path: str, texts: list[str], encode_special_tokens: bool = True) -> np.ndarray:
    """Tokens of each text. `encode_special_tokens` is the library's switch: whether special tokens' strings are
    encoded like other text instead of being one token each."""
    boundaries, transducer = compiled(path)
    split = splitter(path, encode_special_tokens)
    parts = [split.split(text) for text in texts] if split else [[text] for text in texts]
    found, ends = cut_pieces(boundaries, [part for some in parts for part in some])
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(transducer.__getitem__, found), np.int64, len(found)))])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    upto = total[np.concatenate([[0], ends]).astype(np.int64)][np.concatenate([[0], np.cumsum(sizes)])]
    return np.diff(upto) + sizes - 1


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: its id, UTF-8 bytes, tokens and whether they exceed `limit`.

    `tokenizer` is the path of a byte-level BPE vocabulary (.json) that every worker can read.
    Counts are those of the library without post-processing: strings of added tokens, special ones too, are one
    token each. A null text counts as empty (0 bytes, 0 tokens). No shuffle; memory is bounded by a few MB of text
    or one document, and by the bounded caches."""

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 2 << 20):
            texts = batch.column("_text")
            n = pa.array(counts_of(tokenizer, texts.to_pylist(), encode_special_tokens=False), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pc.binary_length(texts).cast(pa.int64()), n], ["_id", "n_bytes", "n_tokens"])

    counted = read.mapInArrow(count, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
