"""Removal of repeated and nearly repeated lines: a segment-partition edit join.

Lines within `most` edits of each other share a segment: cut the shorter into most + 1 segments, and the
longer one contains one of them unchanged, at about the same place. Each line is indexed by its
segments, and probed by its substrings at the places where a segment of a line of its length or of up to `most`
less can lie. Pairs that meet are verified by a banded bit-parallel edit distance.

A line goes if an equal line or one within `most` edits occurs earlier; the order is by document id (null
ids last), then position. Lines of fewer than `shortest` characters always stay, as chance repeats them.
All of it is DataFrame expressions. Keys that only one line has are dropped by an aggregate first; equal
lines count once; nothing is collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind
from ..operators.joins import lookup_join
from ..sources.staging import stage

MOST = 2
SHORTEST = 20
LAST = (1 << 63) - 1


def segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line: equal parts, the later ones longer by the rest."""
    size = F.floor(length / (most + 1)).cast("int")
    plain = most + 1 - (length - size * (most + 1))  # so many have the smaller size
    return size * i + F.greatest(i - plain, F.lit(0)), size + (i >= plain).cast("int")


def line_keys(lines: DataFrame, most: int = MOST) -> DataFrame:
    """hash, key, less (how much shorter the other line is), index: the segments of each line (index), and all substrings to probe for, segments included.

    A substring stands at most i edits from where segment i starts, counted from the left, and at most
    most - i counted from the right; both hold at once for one segment of any near pair. Lines are crossed
    with the short list of places as rows: one small expression instead of many, which compiles well."""
    places = []
    for i in range(most + 1):
        for less in range(most + 1):
            for shift in range(max(-i, less - (most - i)), min(i, less + (most - i)) + 1):
                places.append(f"named_struct('i', {i}, 'less', {less}, 'shift', {shift})")
    rows = lines.select("hash", "line", F.length("line").alias("n"), F.explode(F.expr(f"array({', '.join(places)})")).alias("p"))
    i, less, shift = F.col("p.i"), F.col("p.less"), F.col("p.shift")
    start, size = segment(F.col("n") - less, i, most)
    rows = rows.select("hash", "line", "n", i.alias("i"), less.alias("less"), shift.alias("shift"), (start + shift).alias("start"), size.alias("size"))
    rows = rows.filter("start >= 0 AND start + size <= n")
    key = F.xxhash64("i", F.col("n") - F.col("less"), F.substring(F.col("line"), F.col("start") + 1, F.col("size")))
    return rows.select("hash", key.alias("key"), "less", ((F.col("less") == 0) & (F.col("shift") == 0)).alias("index"))


def shared_start(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by halving."""
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    longer = lambda n, step: F.when((n + step <= least) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), longer)


def within(a: Column, b: Column, most: int = MOST) -> Column:
    """Whether the edit distance is at most `most`. What both begin or end with is cut off first: that
    leaves the distance as it is, and little to compare."""

    def cut(x: Column, y: Column, then) -> Column:
        """`then` of both without their common prefix."""
        return bind(
            F.struct(x.alias("x"), y.alias("y")),
            lambda p: bind(
                shared_start(p["x"], p["y"]),
                lambda n: bind(F.struct(F.substring(p["x"], n + 1, F.length(p["x"])).alias("x"), F.substring(p["y"], n + 1, F.length(p["y"])).alias("y")), lambda q: then(q["x"], q["y"])),
            ),
        )

    apart = F.abs(F.length(a) - F.length(b)) > most
    return F.when(apart, False).otherwise(cut(a, b, lambda x, y: cut(F.reverse(x), F.reverse(y), lambda u, v: banded(u, v, most))))


def banded(a: Column, b: Column, most: int) -> Column:
    """Whether the edit distance is at most `most`, for strings whose lengths differ by no more.

    One bit for each diagonal of the band, one word for each number of edits: bit k of word d says that the
    characters of b read so far match a prefix of a that is k - most longer, with d edits. A step keeps the bits
    whose characters agree and takes edits from the word below."""
    wide, one = 2 * most + 1, F.lit(1).cast("long")

    def closed(words: list[Column]) -> Column:
        """Words as an array, with deletions (one diagonal up, one edit more) carried through."""
        out = [words[0]]
        for d in range(1, most + 1):
            out.append(words[d].bitwiseOR(F.shiftleft(out[d - 1], 1).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))))
        return F.array(*out)

    def step(words: Column, letter: Column, j: Column, letters: Column) -> Column:
        same = F.lit(0).cast("long")
        for k in range(wide):
            same = same.bitwiseOR(F.when(F.get(letters, j + (k - most)) == letter, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        new = []
        for d in range(most + 1):
            word = F.get(words, F.lit(d)).bitwiseAND(same)
            if d:
                below = F.get(words, F.lit(d - 1))
                word = word.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1))
            new.append(word)
        return bind(F.array(*new), lambda w: closed([F.get(w, F.lit(d)) for d in range(most + 1)]))

    begin = closed([F.shiftleft(one, most)] + [F.shiftleft(one, most)] * most)
    letters_of = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    words = bind(
        letters_of(a),
        lambda la: F.aggregate(
            F.transform(letters_of(b), lambda x, j: F.struct(x.alias("x"), j.alias("j"))), begin, lambda acc, s: step(acc, s["x"], s["j"], la)
        ),
    )
    end = F.call_function("shiftright", F.get(words, F.lit(most)), F.length(a) - F.length(b) + most)
    return end.bitwiseAND(one) == 1


def lines_of(docs: DataFrame, shortest: int) -> DataFrame:
    """doc (its place in the order), key, pos, hash, line: lines that take part."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")
    )
    return rows.filter(F.length("line") >= shortest).select("doc", "key", "pos", F.xxhash64("line").alias("hash"), "line")


def parities(line: Column) -> Column:
    """64 bits: of each class of characters, whether their number is odd. An edit changes two bits at most, so
    lines within n edits differ in 2 n bits at most: a bound that rules out most pairs of a group of near
    copies before they are made."""
    flip = lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(64))))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), flip)


def near_lines(lines: DataFrame, most: int) -> DataFrame:
    """hash of each line that has an earlier line, not equal to it, within `most` edits."""
    keyed = line_keys(lines, most)
    shared = keyed.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.max("index").alias("index"))
    shared = stage(shared.filter("low < high AND index").select("key"), "line-keys")
    members = stage(lookup_join(keyed, shared, ["key"], "inner", spread_by=["hash"]).distinct(), "line-members")
    wanted = stage(members.select("hash").distinct(), "line-hashes")
    texts = lookup_join(lines, wanted, ["hash"], "inner", spread_by=["key", "pos"]).groupBy("hash").agg(F.min(F.struct("doc", "key", "pos")).alias("first"), F.min("line").alias("line"))
    texts = stage(texts.withColumn("sketch", parities(F.col("line"))), "line-texts")
    known = members.join(texts.select("hash", "sketch"), "hash")
    indexed = known.filter("index").select("key", "hash", "sketch").distinct()
    probes = known.select("key", F.col("hash").alias("probe"), F.col("sketch").alias("probe_sketch"), "less").distinct()
    # Of lines of one length, each pair is found from both sides; one is enough.
    may_be = F.expr(f"hash <> probe AND (less > 0 OR hash < probe) AND bit_count(sketch ^ probe_sketch) <= {2 * most}")
    pairs = indexed.join(probes, (indexed["key"] == probes["key"]) & may_be).select("hash", "probe").distinct()
    a, b = (texts.select(F.col("hash").alias(h), F.col("first").alias(f"{h}_first"), F.col("line").alias(f"{h}_line")) for h in ("hash", "probe"))
    near = pairs.join(a, "hash").join(b, "probe").filter(within(F.col("hash_line"), F.col("probe_line"), most))
    return near.select(F.when(F.col("hash_first") < F.col("probe_first"), F.col("probe")).otherwise(F.col("hash")).alias("hash")).distinct()


def dedupe_lines(docs: DataFrame, most: int = MOST, shortest: int = SHORTEST) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with repeated lines taken out of the texts, and with
    `n_lines`, lines before, and `lines_removed`. Other columns of these two names are replaced.

    A null text stays null, with no lines. Rows of equal id and text count as one document and keep the
    same lines."""
    lines = lines_of(docs, shortest)
    repeated = lines.groupBy("hash").agg(F.min(F.struct("doc", "key", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    near = near_lines(lines, most).withColumn("near", F.lit(True))
    gone = stage(repeated.select("hash", "first").join(near, "hash", "full"), "lines-gone")
    hit = lookup_join(lines.drop("line"), gone, ["hash"], "inner", spread_by=["key", "pos"])
    out = hit.filter((F.col("near")) | (F.struct("doc", "key", "pos") != F.col("first"))).groupBy(F.col("key").alias("_key")).agg(F.collect_set("pos").alias("_gone"))
    # The caller's columns stay in one of their own, so that no name of theirs meets one of ours.
    read = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    read = lookup_join(read, stage(out, "line-places"), ["_key"], "left", spread_by=["_key"]).withColumn("_lines", F.split("_text", "\n"))
    kept = F.array_join(F.filter("_lines", lambda line, i: ~F.array_contains("_gone", i)), "\n")
    made = {
        "text": F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept),
        "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")),
        "lines_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")),
    }
    names = [*docs.columns, *[c for c in ("n_lines", "lines_removed") if c not in docs.columns]]
    return read.select(*[made[c].alias(c) if c in made else F.col(f"_row.{c}").alias(c) for c in names])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the texts that are left, n_chars to match; documents of which nothing is left go. Other columns stay as they are."""
    read = dedupe_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole")))
    left = (F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return read.filter(left).select(*[made[c].alias(c) if c in made else F.col(f"whole.{c}").alias(c) for c in docs.columns])
