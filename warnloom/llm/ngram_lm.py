"""A bigram language model in Elias-Fano tries, learned from and asked by whole corpora.

Texts are cut into blocks of some MB, each a row with its own word list and word numbers. Words and bigrams of
a block are sent, once each, to shards by a hash. A shard merges the training counts and answers what each
block asked: exact counts of words, and those of bigrams from a trie: contexts in an Elias-Fano level,
pointers to their successors in another, and the successors of each context, numbered relative to it, in a
third, with counts quantised to two bytes. A block then has all that its texts' probabilities need:

    P(w | c) = (N(c, w) + m P(w)) / (N(c) + m),   P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),   m = N(c) ** b

where b = log V / log N: by Heaps' law m is about the number of different successors, as in Witten-Bell
smoothing. Words and contexts are known by 64-bit hashes, successors of one context by WORD_BITS bits of theirs: an
unseen bigram whose context has s successors in its shard, of about SHARD_TOKENS bigrams at most, is taken for one
of them with a probability of s / 2 ** WORD_BITS, whatever the size of the corpus. A shard's task writes its trie to files of its own, maps them
into memory, lets go of what the trie was made from, answers from the mapped levels and drops the files.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .words import WordHashes, crc_part, mix, pieces, utf8

# A shard's contexts are numbered by the other 24 bits: twice as many as the bigrams it has at most, on average.
WORD_BITS = 40
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 2_000_000
# Quantised counts: exact to 4,095, then in steps of 0.058 % up to more than 64 bits can count.
LEVELS = np.concatenate([np.arange(4096.0), 4096 * 1.00058 ** np.arange(61440)])


class EliasFano:
    """A sorted list of unsigned integers: low bits as whole bytes, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, shift: int):
        self.low, self.high, self.n, self.shift = low, high, n, shift

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        shift = 8 * max(0, round(math.log2((int(values[-1]) + 1) / n) / 8)) if n else 0
        high = (values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(n, np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : shift // 8].copy()
        return cls(low, np.packbits(bits), n, shift)

    def starts(self) -> np.ndarray:
        """For every high part, where its values begin; one more for the end."""
        zeros = np.flatnonzero(np.unpackbits(self.high) == 0)
        return np.concatenate([[0], np.minimum(zeros - np.arange(len(zeros)), self.n)])

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.shift // 8] = self.low[at]
        return out.view("<u8").reshape(-1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high)[: self.n + len(self.high) * 8])[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.shift)) | self.lows(np.arange(self.n))

    def search(self, wanted: np.ndarray, begin: np.ndarray | int = 0, until: np.ndarray | int = 1 << 62) -> np.ndarray:
        """Where each wanted value stands from `begin` on and before `until`, -1 if it doesn't: its high part gives a
        short range, halved by low parts."""
        if not self.n:
            return np.full(len(wanted), -1, np.int64)
        starts = self.starts()
        high = (wanted >> np.uint64(self.shift)).astype(np.int64)
        there = high < len(starts) - 1
        high = np.where(there, high, 0)
        a, b = np.maximum(starts[high], begin), np.minimum(np.where(there, starts[high + 1], starts[high]), until)
        end, key = b, wanted & np.uint64((1 << self.shift) - 1)
        while (open_ := a < b).any():
            middle = np.where(open_, (a + b) // 2, 0)
            below = open_ & (self.lows(middle) < key)
            a, b = np.where(below, middle + 1, a), np.where(open_ & ~below, middle, b)
        found = a < end
        at = np.where(found, a, 0)
        return np.where(found & (self.lows(at) == key), at, -1)


class NgramTrie:
    """Bigram counts by context and successor, from sorted codes: context bits above `bits` word bits."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, counts: np.ndarray, bits: int):
        self.contexts, self.pointers, self.successors, self.counts, self.bits = contexts, pointers, successors, counts, bits

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, bits: int = 36) -> NgramTrie:
        contexts, rank = np.unique(codes >> np.uint64(bits), return_inverse=True)
        return cls.of_ranked(contexts, (rank.astype(np.uint64) << np.uint64(bits)) | (codes & np.uint64((1 << bits) - 1)), counts, bits)

    @classmethod
    def of_ranked(cls, contexts: np.ndarray, relative: np.ndarray, counts: np.ndarray, bits: int) -> NgramTrie:
        """From contexts, sorted, and sorted codes: places of contexts above word bits."""
        if len(contexts) > 1 << (64 - bits):
            raise ValueError(f"{len(contexts)} contexts in one shard")
        first = np.searchsorted(relative >> np.uint64(bits), np.arange(len(contexts), dtype=np.uint64))
        pointers = EliasFano.of(np.append(first, len(relative)).astype(np.uint64))
        level = np.clip(np.searchsorted(LEVELS, counts, "right") - 1, 0, len(LEVELS) - 1).astype(np.uint16)
        return cls(EliasFano.of(contexts), pointers, EliasFano.of(relative), level, bits)

    def ask(self, codes: np.ndarray) -> np.ndarray:
        """Quantised counts of bigrams; 0 for those not stored."""
        contexts, at = np.unique(codes >> np.uint64(self.bits), return_inverse=True)
        return self.ask_words(contexts, at, codes & np.uint64((1 << self.bits) - 1))

    def ask_words(self, contexts: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The same for bigrams of contexts[at] and words. A context is found first; its pointer
        and the next one bound the search for the successor relative to it."""
        if not self.contexts.n:
            return np.zeros(len(words), np.uint16)
        found = self.contexts.search(contexts)
        rank, first = np.maximum(found, 0), self.pointers.values().astype(np.int64)
        begin, until = first[rank], np.where(found >= 0, first[rank + 1], first[rank])
        at = self.successors.search((rank.astype(np.uint64) << np.uint64(self.bits))[at] | words, begin[at], until[at])
        return np.where(at >= 0, self.counts[np.maximum(at, 0)], 0).astype(np.uint16)

    def save(self, folder: str) -> None:
        for name in ("contexts", "pointers", "successors"):
            level = getattr(self, name)
            np.save(Path(folder) / f"{name}-low.npy", level.low)
            np.save(Path(folder) / f"{name}-high.npy", level.high)
            np.save(Path(folder) / f"{name}-size.npy", np.array([level.n, level.shift]))
        np.save(Path(folder) / "counts.npy", self.counts)
        np.save(Path(folder) / "bits.npy", np.array([self.bits]))

    @classmethod
    def open(cls, folder: str) -> NgramTrie:
        load = lambda name: np.load(Path(folder) / f"{name}.npy", mmap_mode="r")
        levels = [EliasFano(load(f"{n}-low"), load(f"{n}-high"), *map(int, load(f"{n}-size"))) for n in ("contexts", "pointers", "successors")]
        return cls(*levels, load("counts"), int(load("bits")[0]))


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True) if values.nbytes else b""


def unpack(data: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes, the upper ones of which pack well."""
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T))


def unplanes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpack(data, size * n, np.uint8).reshape(size, n).T).view(kind).reshape(-1) if n else np.zeros(0, kind)


def deltas(codes: np.ndarray) -> bytes:
    """Sorted codes as differences."""
    return planes(np.diff(codes, prepend=np.zeros(1, np.uint64)))


def undeltas(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(data, n, np.uint64), dtype=np.uint64)


class Pairs:
    """Bigrams sorted by context hash and then word bits, in columns: contexts once each, how many bigrams each has,
    and the word bits of all."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray):
        self.contexts, self.sizes, self.words = contexts, sizes, words
        self.at = np.repeat(np.arange(len(contexts)), sizes)

    @classmethod
    def of(cls, contexts: np.ndarray, words: np.ndarray) -> Pairs:
        first = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
        return cls(contexts[first], np.diff(np.append(first, len(contexts))), words)

    @classmethod
    def read(cls, contexts: bytes, sizes: bytes, words: bytes, k: int, n: int) -> Pairs:
        sizes, steps = unplanes(sizes, k, np.uint32).astype(np.int64), unplanes(words, n, np.uint64)
        total, first = np.cumsum(steps, dtype=np.uint64), np.cumsum(sizes) - sizes
        return cls(undeltas(contexts, k), sizes, total - np.repeat(total[first] - steps[first], sizes))

    def columns(self) -> tuple[bytes, bytes, bytes]:
        """As bytes; words as differences within a context."""
        steps, first = np.diff(self.words, prepend=np.zeros(1, np.uint64)), np.cumsum(self.sizes) - self.sizes
        steps[first] = self.words[first]
        return deltas(self.contexts), planes(self.sizes.astype(np.uint32)), planes(steps)


def merged_trie(asked: list[tuple[Pairs, np.ndarray]]) -> NgramTrie:
    """A shard's trie of the counts that its blocks send."""
    trained = [np.unique(p.at[k > 0]) for p, k in asked]
    contexts = np.unique(np.concatenate([p.contexts[t] for (p, _), t in zip(asked, trained, strict=True)]))
    codes = [np.searchsorted(contexts, p.contexts)[p.at[k > 0]].astype(np.uint64) << np.uint64(WORD_BITS) | p.words[k > 0] for p, k in asked]
    return NgramTrie.of_ranked(contexts, *summed(np.concatenate(codes), np.concatenate([k[k > 0] for _, k in asked])), WORD_BITS)


def mapped_answers(asked: list[tuple[Pairs, np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """For each block its bigrams' counts over all blocks, quantised, from a trie in memory-mapped files; and how many bigrams that has."""
    with tempfile.TemporaryDirectory(prefix="trie-") as folder:
        merged_trie(asked).save(folder)
        trie = NgramTrie.open(folder)
        return [trie.ask_words(p.contexts, p.at, p.words) for p, _ in asked], len(trie.counts)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes sorted and once each, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=~codes[:1]) != 0) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else counts.astype(np.int64)


def blocks(docs: DataFrame, train: Column, id_col: str, text: str) -> DataFrame:
    """A row for each block of texts: block, ids, held (not trained on), sizes (words by text), words, seen (their
    training counts), tokens (numbers of words)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "_text", BLOCK_BYTES):
            number: dict[bytes, int] = {}
            tokens, sizes = [], []
            for doc in utf8(batch.column("_text")):
                words = doc.lower().split()
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                sizes.append(len(words))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(number), np.uint32)
            rank[order] = np.arange(len(number))
            flat, words = rank[flat], np.array(list(number), object)[order].tolist()
            train = np.array(batch.column("_train").to_pylist(), bool)
            seen = np.bincount(flat[np.repeat(train, sizes)], minlength=len(number))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([batch.column("_id").to_pylist()], pa.list_(batch.column("_id").type)), pa.array([(~train).tolist()], pa.list_(pa.bool_())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([seen], pa.list_(pa.int64())), pa.array([planes(flat)], pa.binary())],
                ["block", "ids", "held", "sizes", "words", "seen", "tokens"],
            )
            block += 1

    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), train.alias("_train"))
    return read.mapInArrow(cut, f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, words array<string>, seen array<bigint>, tokens binary")


class Bigrams:
    """The words of a block and the bigrams of its texts in order: numbers of context and word (one more than the last word's number stands
    for the begin, and for the end), and hashes of words, and of contexts with word bits, sorted and once each."""

    def __init__(self, row: dict, shards: int):
        sizes = np.array(row["sizes"], np.int64)
        n, words = int(sizes.sum()), row["words"]
        flat = unplanes(row["tokens"], n, np.uint32)
        edge = len(words)
        last = np.cumsum(sizes + 1) - 1  # where each text's end stands
        self.word = np.full(n + len(sizes), edge, np.int32)
        inner = np.ones(n + len(sizes), bool)
        inner[last] = False
        self.word[inner] = flat
        self.context = np.concatenate([np.array([edge], np.int32), self.word[:-1]])
        self.first = last - sizes
        hashes = WordHashes()
        h = mix(np.append(hashes.of([w.encode() for w in words]), np.uint64(0x5EED)))
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        pairs, inverse = np.unique(rank[self.context] * len(h) + rank[self.word], return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        context, word = h[order[pairs // len(h)]], h[order[pairs % len(h)]]
        single, self.place = np.unique(h[:-1], return_inverse=True)
        self.single, self.contexts, self.words = single, context, word >> np.uint64(64 - WORD_BITS)
        self.sizes = (len(single), len(pairs))  # by kind: words, bigrams
        # Bigrams of one context are spread over the shards.
        self.members = [self.by_shard(single, shards), self.by_shard(mix(context) + word, shards)]

    @staticmethod
    def by_shard(codes: np.ndarray, shards: int) -> list[np.ndarray]:
        shard = (mix(codes) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, held_out (not trained on), n_tokens (words and the end), n_known,
    train_tokens, base_score (unigram) and score (bigram), both log10. `train` says which rows to learn from.

    A null text counts as empty and has just its end. Repeated rows count as often as they come. With no
    training rows all counts are 0 and both scores are those of the smoothing alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = stage(blocks(docs, train, id_col, text), "blocks")
    held = F.transform(F.arrays_zip("sizes", "held"), lambda x: F.when(~x["held"], x["sizes"] + 1).otherwise(0))
    add = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = cut.agg(F.sum(add(held)), F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum(add(F.col("sizes")))).first()
    n_train, ends, n_all = (int(x or 0) for x in sums)
    shards = max(1, -(-n_all // SHARD_TOKENS))

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Bigrams(row, shards)
                trained = ~np.repeat(np.array(row["held"], bool), np.array(row["sizes"], np.int64) + 1)
                words = np.zeros(grams.sizes[0], np.int64)
                words[grams.place] = row["seen"]
                for kind, counts in enumerate((words, np.bincount(grams.inverse[trained], minlength=grams.sizes[1]))):
                    for s, at in enumerate(grams.members[kind]):
                        if len(at):
                            out = {"kind": kind, "shard": s, "block": row["block"], "n": len(at), "counts": planes(counts[at].astype(np.uint32))}
                            if kind:
                                pairs = Pairs.of(grams.contexts[at], grams.words[at])
                                out["contexts"], out["sizes"], out["codes"] = pairs.columns()
                                out["k"] = len(pairs.contexts)
                            else:
                                out["codes"] = deltas(grams.single[at])
                            yield pa.RecordBatch.from_pylist([out], asked)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        kind = int(group["kind"].iloc[0])
        counted = [unplanes(r.counts, r.n, np.uint32) for r in group.itertuples()]
        if kind:
            read = [Pairs.read(r.contexts, r.sizes, r.codes, int(r.k), r.n) for r in group.itertuples()]
            told, n = mapped_answers(list(zip(read, counted, strict=True)))
            told = [planes(x) for x in told]
        else:
            read = [undeltas(r.codes, r.n) for r in group.itertuples()]
            codes, counts = summed(np.concatenate([c[k > 0] for c, k in zip(read, counted, strict=True)]), np.concatenate([k[k > 0] for k in counted]))
            listed = EliasFano.of(codes)
            at = [listed.search(c) for c in read]
            told, n = [planes(np.where(x >= 0, counts[np.maximum(x, 0)] if len(counts) else 0, 0).astype(np.int64)) for x in at], len(codes)
        distinct = [n, *[0] * (len(group) - 1)]
        return pd.DataFrame({"block": group["block"], "kind": kind, "shard": group["shard"], "distinct": distinct, "answer": told})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = n_train + 0.5 * (n_words + 1)
        heaps = math.log(n_words) / math.log(n_train) if n_words > 1 and n_train > 1 else 0.5
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Bigrams(row, shards)
                single, level = np.zeros(grams.sizes[0], np.int64), np.zeros(grams.sizes[1], np.uint16)
                for part in row["answers"]:
                    at = grams.members[part["kind"]][part["shard"]]
                    if part["kind"]:
                        level[at] = unplanes(part["answer"], len(at), np.uint16)
                    else:
                        single[at] = unplanes(part["answer"], len(at), np.int64)
                count = np.append(single[grams.place], ends).astype(np.float64)  # of words; of the end, as of the begin
                base = (count + 0.5) / floor
                context = count[grams.context]
                weight = np.maximum(context, 1.0) ** heaps
                p = (np.minimum(LEVELS[level[grams.inverse]], context) + weight * base[grams.word]) / (context + weight)
                total = lambda x: np.add.reduceat(x, grams.first)
                out = [np.array(row["sizes"], np.int64) + 1, total((count > 0)[grams.word].astype(np.int64)), total(np.log10(base)[grams.word]), total(np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(row["held"], pa.bool_()), *map(pa.array, out)], ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    asked = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()), ("k", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary())])
    asks = cut.mapInArrow(request, "kind int, shard bigint, block bigint, n bigint, codes binary, counts binary, k bigint, contexts binary, sizes binary")
    told = stage(asks.groupBy("kind", "shard").applyInPandas(answer, "block bigint, kind int, shard bigint, distinct bigint, answer binary"), "answers")
    n_words = int(told.filter("kind = 0").agg(F.sum("distinct")).first()[0] or 0) + (ends > 0)
    answers = told.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "answer")).alias("answers"))
    whole = cut.drop("seen").join(answers, "block")
    scored = whole.mapInArrow(score, f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 5 is not 1."""
    return lm_scores(docs, crc_part(F.col("doc_id")) != 1)
