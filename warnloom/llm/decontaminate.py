"""Benchmark decontamination by SimHash over item-sized windows.

A text is cut into lower-case words of letters and digits, and compared with an item in windows of as many words as the
item has. Windows are laid where a 5-word shingle of the text is one of an item's, aligned on it: a window
that shares none with any item can't be similar to one. Each window is a candidate for the item it was laid for, and
for those its fingerprint finds: fingerprints are looked up in an index of all items' radius + 1 blocks, whatever the item, so that all
within the radius agree in one block at least. Every candidate is verified by the exact weighted similarity of the shingles,
weights being their counts; no bound on fingerprints drops one, as a run of one repeated word weighs as much in a fingerprint as
many different ones. All of it is DataFrame expressions; the benchmark is broadcast only when counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind
from ..operators.joins import lookup_join
from ..sources.staging import stage

WIDTH = 5
BITS = 64


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the `width`-word shingles in order; of all words where there are fewer, of nothing where none."""
    whole = F.array().cast("array<bigint>")
    for n in range(1, width):
        whole = F.when(F.size(words) == n, F.array(gram(words, F.lit(0), n))).otherwise(whole)
    return F.when(F.size(words) >= width, full_shingles(words, width)).otherwise(whole)


def gram(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def full_shingles(words: Column, width: int) -> Column:
    """Hashes of the shingles of just `width` words; none where there are fewer."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: gram(words, i, width)))


def simhash(hashes: Column) -> Column:
    """64 bits: each the majority of the shingles' bits, with repetition as weight."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(
            F.when(
                2 * F.size(F.filter(hashes, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")) == 1)) > F.size(hashes),
                F.call_function("shiftleft", F.lit(1).cast("long"), b),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks of bits, each with its number."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("bits"),
            )
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, weights being counts."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return bind(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def row_key(id_col: str, text: str) -> Column:
    """Tells rows apart well enough to bring candidates back to their texts; equal rows share one."""
    return F.xxhash64(F.col(id_col), F.col(text))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, id, item_id, start (word), hamming, similarity: for each text and item, its most similar window,
    where that reaches the threshold. Null and empty texts or items match nothing; repeated items are one."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("_w")).filter("size(_w) > 0").dropDuplicates()
    items = items.select("item_id", F.size("_w").alias("item_words"), shingles(F.col("_w")).alias("item_shingles"))
    items = stage(items.withColumn("item_print", simhash(F.col("item_shingles"))), "benchmark")
    index = items.select("item_id", "item_words", F.posexplode("item_shingles").alias("offset", "shingle")).groupBy("shingle", "item_id", "item_words").agg(F.collect_list("offset").alias("offsets"))

    read = docs.select(row_key(id_col, text).alias("_key"), plain_words(F.col(text)).alias("_w"))
    # Items of fewer words than a shingle are one shingle of that width; such widths are looked for too.
    widths = [r[0] for r in items.select(F.least("item_words", F.lit(WIDTH))).distinct().collect()]
    seen = None
    for width in sorted(widths) or [WIDTH]:
        some = read.select("_key", F.posexplode_outer(full_shingles(F.col("_w"), width)).alias("pos", "shingle")).filter("pos IS NOT NULL")
        seen = some if seen is None else seen.unionAll(some)
    hits = lookup_join(seen, index, ["shingle"], "inner", spread_by=["_key", "pos"])
    laid = hits.select("_key", "item_id", F.explode("offsets").alias("o"), "pos").select("_key", "item_id", F.greatest(F.col("pos") - F.col("o"), F.lit(0)).alias("start"))
    windows = stage(laid.distinct(), "windows")

    # Texts are cut into words after the join, so only those with a window.
    texts = docs.select(row_key(id_col, text).alias("_key"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = lookup_join(texts, windows, ["_key"], "inner", spread_by=["_key"]).withColumn("_w", plain_words(F.col("_text"))).drop("_text")
    found = lookup_join(found, items.select("item_id", "item_words"), ["item_id"], "inner", spread_by=["_key", "start"])
    # Bound: left to itself, the optimizer cuts the window again for every shingle.
    window = bind(F.slice("_w", F.col("start") + 1, F.col("item_words")), lambda w: shingles(w))
    laid = stage(found.select(F.monotonically_increasing_id().alias("w"), "_key", "_id", "start", "item_id", window.alias("window")), "laid")
    laid = laid.withColumn("print", bind(F.col("window"), lambda w: simhash(w)))
    # The index: fingerprints that agree in a block are compared in full.
    probes = laid.select("w", "print", F.explode(blocks(F.col("print"), radius)).alias("p")).select("w", "print", "p.*")
    indexed = items.select(F.col("item_id").alias("found_id"), "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("p")).select("found_id", "item_print", "p.*")
    near = lookup_join(probes, indexed, ["block", "bits"], "inner", spread_by=["w"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = stage(near.select("w", "found_id").distinct(), "near-prints")
    by_print = laid.drop("item_id").join(near, "w").withColumnRenamed("found_id", "item_id")
    pairs = laid.unionByName(by_print).drop("w")
    near = lookup_join(pairs, items, ["item_id"], "inner", spread_by=["_key", "start"])
    near = near.withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    sure = near.withColumn("similarity", similarity(F.col("window"), F.col("item_shingles"))).filter(F.col("similarity") >= threshold)
    best = sure.groupBy("_key", "_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h"))).alias("m"))
    return best.select("_key", F.col("_id").alias(id_col), "item_id", (-F.col("m.s")).alias("start"), (-F.col("m.h")).alias("hamming"), F.col("m.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, unchanged."""
    leaky = find_leaks(docs.select("doc_id", "text"), benchmark).select("_key").distinct().withColumn("_leak", F.lit(True))
    read = docs.select(row_key("doc_id", "text").alias("_key"), F.struct(*docs.columns).alias("row"))
    return lookup_join(read, stage(leaky, "leaks"), ["_key"], "left", spread_by=["_key"]).filter("_leak IS NULL").select("row.*")
