"""The entries of large JSON objects, cut in parallel.

A file that is one JSON object may be one endless line. It is read as segments that end at closing braces, which Spark splits like
lines, and a segment alone does not show whether it begins inside a string, nor how deep. So each is
summed up for both cases: whether it changes from inside to outside, and by how much it nests. These sums are added up within
each block of the file, then over the blocks of a file (a row for each), which gives every segment its true
state; where the object's own level is reached outside a string, an entry ends. Nothing but the
block sums of one file is brought together in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .staging import stage

# White space as JSON has it.
BLANK = r"[ \t\r\n]*"


def _nesting(parts: Column, odd: int) -> Column:
    """Opening less closing brackets in the parts between quotes that stand outside of strings."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    return F.length(F.regexp_replace(outside, r"[^\{\[]", "")) - F.length(F.regexp_replace(outside, r"[^\}\]]", ""))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, text, and for a begin outside (0) and inside (1) a string: flips, deeper_0, deeper_1."""
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"),
        F.concat("value", F.lit("}")).alias("text"),
    )
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"')
    rows = rows.withColumn("_parts", parts)
    rows = rows.withColumns({"flips": (F.size("_parts") - 1) % 2, "deeper_0": _nesting(F.col("_parts"), 0), "deeper_1": _nesting(F.col("_parts"), 1)})
    return stage(rows.drop("_parts"), "json-segments")


def _by_block(rows: DataFrame, sums: dict[str, Column], earlier: dict[str, Column]) -> DataFrame:
    """`rows` with, for each block, what the blocks before it in the file amount to. `sums`: by block; `earlier`: over those sums."""
    blocks = rows.groupBy("file", "block").agg(*[c.alias(name) for name, c in sums.items()])
    known = stage(blocks.select("file", "block", *[c.alias(name) for name, c in earlier.items()]), "json-blocks")
    return lookup_join(rows, known, ["file", "block"], "inner", spread_by=["place"])


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, body: the entries of the JSON objects at `path`, one object in each file below it; a body may hold several entries, as
    `"key": {...}, "key": null` without the object's braces. A file that isn't one well-formed object at that level, or is cut short, gives no rows."""
    segments = _segments(spark, path)
    in_block = Window.partitionBy("file", "block").orderBy("place")
    before, with_own = in_block.rowsBetween(Window.unboundedPreceding, -1), in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.withColumn("_inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    for case in (0, 1):
        rows = rows.withColumn(f"_case_{case}", F.when(F.col("_inside") == case, F.col("deeper_0")).otherwise(F.col("deeper_1")))
        rows = rows.withColumn(f"_run_{case}", F.sum(f"_case_{case}").over(with_own))
    rows = stage(rows, "json-runs")

    blocks = Window.partitionBy("file").orderBy("block")
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    rows = _by_block(
        rows,
        {"flips": F.sum("flips"), "_sum_0": F.sum("_case_0"), "_sum_1": F.sum("_case_1")},
        {"_begins": begins("flips") % 2, "_sum_0": F.col("_sum_0"), "_sum_1": F.col("_sum_1")},
    )
    # How deep a block begins depends on whether those before it begin inside a string, which is known only now.
    depth = rows.select("file", "block", "_begins", "_sum_0", "_sum_1").distinct()
    depth = depth.withColumn("_own", F.when(F.col("_begins") == 0, F.col("_sum_0")).otherwise(F.col("_sum_1"))).select("file", "block", begins("_own").alias("_depth"))
    rows = lookup_join(rows.drop("_sum_0", "_sum_1"), stage(depth, "json-depths"), ["file", "block"], "inner", spread_by=["place"])
    inside = (F.col("_begins") + F.col("_inside") + F.col("flips")) % 2 == 1
    deep = F.col("_depth") + F.when(F.col("_begins") == 0, F.col("_run_0")).otherwise(F.col("_run_1"))
    rows = rows.withColumn("_deep", deep).withColumn("_ends", (~inside & (deep <= 1)).cast("int"))
    rows = stage(rows.withColumn("_nth", F.sum("_ends").over(with_own) - F.col("_ends")).select("file", "size", "block", "place", "text", "_deep", "_ends", "_nth"), "json-ends")
    rows = _by_block(rows, {"_ends": F.sum("_ends")}, {"_offset": begins("_ends")})
    rows = rows.withColumn("entry", F.col("_offset") + F.col("_nth"))

    pieces = rows.groupBy("file", "entry").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("_pieces"),
        F.min("_deep").alias("_deep"), F.max("_ends").alias("_ended"), F.sum(F.octet_length("text")).alias("_bytes"), F.max("size").alias("size"),
    )
    whole = stage(pieces.select("file", "entry", F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"), "_deep", "_ended", "_bytes", "size"), "json-entries")
    # What follows the object's last brace has one added that is not there.
    closes = F.when(F.col("_deep") == 0, F.col("entry"))
    facts = whole.groupBy("file").agg(F.min(closes).alias("last"), F.max("entry").alias("end"), F.sum("_bytes").alias("bytes"), F.max("size").alias("size"), F.min("_deep").alias("low"))
    whole = whole.join(facts.drop("size"), "file")
    tail = F.regexp_replace("text", r"\}\z", "")
    start = F.when(F.col("entry") == 0, F.col("text").rlike(rf"\A{BLANK}\{{")).otherwise(F.col("text").rlike(rf"\A{BLANK}(,|\}}{BLANK}\z)"))
    after = F.col("entry") > F.col("last")
    fine = F.when(after, tail.rlike(rf"\A{BLANK}\z") & (F.col("bytes") == F.col("size") + 1)).otherwise(start & (F.col("_ended") == 1))
    body = F.regexp_replace(F.col("text"), rf"\A{BLANK}[,\{{]", "")
    body = F.when(F.col("entry") == F.col("last"), F.regexp_replace(body, rf"\}}{BLANK}\z", "")).otherwise(body)
    checked = whole.withColumn("_fine", fine & F.col("last").isNotNull())
    good = checked.groupBy("file").agg(F.bool_and("_fine").alias("_good"), F.max("last").alias("_last"), F.max("end").alias("_end"), F.max("bytes").alias("_all"), F.max("size").alias("_size"))
    good = good.filter("_good AND (_end > _last OR _all = _size)").select("file")
    kept = checked.filter("entry <= last").select("file", body.alias("body")).filter(~F.col("body").rlike(rf"\A{BLANK}\z"))
    return kept.join(good, "file", "left_semi")
