"""Packing of documents into sequences of several permitted lengths.

`pack_lengths` is best fit with a choice of capacities: pieces go in from long to short, each into the
open bin that it fills best, or into a new bin of the size that costs least for it. Several ways of
opening bins are tried together, every bin is cut down at the end to the smallest permitted length that
holds its contents, and the cheapest plan stays. The work is dealt out by a hash into groups of some
thousand pieces that are packed apart, so no group grows with the data and none is hot.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)
GROUP = 4096


def cost(capacity: int) -> float:
    """What a sequence costs: linear in its length, with attention's share on top."""
    return capacity * (1 + capacity / 16384)


def best_fit(sizes: list[int], opens: Callable[[int], int]) -> list[list[int]]:
    """Pieces by bin, best fit in the given order; `opens` gives the capacity of a new bin for a piece."""
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = opens(size), len(bins)
            bins.append([])
        bins[number].append(i)
        if left > size:
            bisect.insort(room, (left - size, number))
    return bins


def pack_lengths(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, list[int]]]:
    """(capacity, pieces) of each bin of the cheapest plan. No piece may exceed the greatest capacity;
    pieces of no length share bins like others."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    down = lambda size: next(c for c in capacities if c >= size)
    # A new bin of the least price per token that the piece leaves usable, or of a size no less than one given.
    plans = [lambda size: min((c for c in capacities if c >= size), key=lambda c: cost(c) / (size + (c - size) / 2 or 1))]
    plans += [lambda size, least=c: max(down(size), least) for c in capacities]
    best, price = [], float("inf")
    for opens in plans:
        bins = best_fit([sizes[i] for i in order], opens)
        cut = [(down(sum(sizes[order[k]] for k in bin)), [order[k] for k in bin]) for bin in bins]
        total = sum(cost(c) for c, _ in cut)
        if total < price:
            best, price = cut, total
    return best


def best_fit_packing(lengths: DataFrame, id_col: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, tag: str | None = None) -> DataFrame:
    """A row for each piece of a document: id, piece, start and n_tokens of the piece, bin_id, capacity of its bin,
    bin_start (where it stands in the bin).

    A document longer than the greatest capacity is split into pieces of that capacity and a rest; one
    without tokens (a null length counts as 0) is a piece of length 0. Repeated rows are packed as often
    as they occur, and null ids like others. `tag` names a column that tells documents of one id apart."""
    most = max(capacities)
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    rows = lengths.select(F.col(id_col).alias("_id"), size.alias("_n"), (F.col(tag) if tag else F.lit(0)).alias("_tag"))
    # Equal rows are counted first and numbered after, so a hash deals out even rows that are all equal.
    rows = rows.groupBy("_id", "_n", "_tag").agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / most), F.lit(0).cast("long")))))
    rows = rows.withColumn("_size", F.least(F.col("_n") - F.col("_piece") * most, F.lit(most).cast("long")))
    total = lengths.select(F.coalesce(F.sum(F.greatest(F.ceil(size / most), F.lit(1))), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // GROUP))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_id", "_n", "_tag", "_copy", "_piece"), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "_tag", "_copy", "_piece", "_size"], na_position="last").reset_index(drop=True)
        sizes = group["_size"].tolist()
        number, capacity, start = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for k, (c, members) in enumerate(pack_lengths(sizes, capacities)):
            at = 0
            for i in members:
                number[i], capacity[i], start[i] = k, c, at
                at += sizes[i]
        first = group["_group"].iloc[0] * 2 * GROUP
        return group.assign(_bin=[first + k for k in number], _capacity=capacity, _at=start)[["_id", "_piece", "_size", "_bin", "_capacity", "_at"]]

    kind = lengths.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _piece bigint, _size bigint, _bin bigint, _capacity bigint, _at bigint"
    packed = rows.select("_id", "_n", "_tag", "_copy", "_piece", "_size", "_group").groupBy("_group").applyInPandas(pack, schema)
    return packed.select(
        F.col("_id").alias(id_col),
        F.col("_piece").alias("piece"),
        (F.col("_piece") * most).alias("start"),
        F.col("_size").alias("n_tokens"),
        F.col("_bin").alias("bin_id"),
        F.col("_capacity").alias("capacity"),
        F.col("_at").alias("bin_start"),
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pack whole documents, counted in words."""
    from .words import word_array

    counted = docs.select("doc_id", F.size(word_array(F.col("text"))).alias("n_tokens"), F.xxhash64("text").alias("_h"))
    return best_fit_packing(counted, tag="_h")
