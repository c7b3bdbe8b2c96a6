"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents are grouped into strata of equal m; within one, the
impact of a term depends on its count tf alone. The index has a row for each stratum, or for each block of one
with many postings: its documents, and for every term its postings in runs of equal tf, highest first. Impacts are
computed once for each tf of a stratum, and the first run of each term bounds what any document of it can score.

A search computes those bounds from the runs' heads. The strata with the greatest bounds of each item are
visited first; the tenth best score found there is a floor, and of all others only those are visited whose bound
reaches it. Every document's terms take part, the index holds those that the asked items use. Items are
asked in rounds of bounded size, so what the tasks are sent never grows with the corpus, nor beyond ROUND_BYTES with the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..sources.staging import stage
from .words import UPPER, pieces, utf8

ROUND_BYTES = 8 << 20
BLOCK_POSTINGS = 1 << 20
FIRST_VISITS = 4
# Letters, digits and all characters beyond ASCII are kept, A-Z lowered; any other byte ends a term.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = (
    "m bigint, block int, docs array<bigint>, terms array<int>, most array<int>, run_terms array<int>, run_tfs array<int>, run_ends array<int>, postings array<int>"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """Items as arrays: the numbers of their distinct terms, one item after the other, and where each begins."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        found = [sorted({self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of((x or "").encode())}) for x in texts]
        self.terms = np.array([t for item in found for t in item], np.int64)
        self.ends = np.cumsum([len(item) for item in found]).astype(np.int64)
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def sums(self, by_term: np.ndarray) -> np.ndarray:
        """For every item the weighted sum of its terms' values."""
        total = np.concatenate([[0], np.cumsum(self.weights[self.terms] * by_term[self.terms])])
        return np.diff(total[np.concatenate([[0], self.ends])])

    def of(self, item: int) -> np.ndarray:
        return self.terms[self.ends[item - 1] if item else 0 : self.ends[item]]


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """_id, n (terms with repeats), terms, tfs (those of the vocabulary, by number) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in pieces(batches, "_text"):
            lengths, terms, tfs = [], [], []
            for doc in utf8(batch.column("_text")):
                words = terms_of(doc)
                found, tf = np.unique(np.fromiter((k for w in words if (k := vocabulary.get(w)) is not None), np.int32), return_counts=True)
                lengths.append(len(words))
                terms.append(found)
                tfs.append(tf.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(lengths, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)], ["_id", "n", "terms", "tfs"])

    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    return read.mapInArrow(count, "_id bigint, n bigint, terms array<int>, tfs array<int>")


def build_index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index (see INDEX): documents of equal m together, in blocks of about BLOCK_POSTINGS postings."""
    held = counted.filter("size(terms) > 0").withColumn("m", F.expr(f"100 - 90 + (90 * n * {n_docs}L) DIV {n_terms}L"))
    strata = held.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS).cast("int").alias("blocks"))
    # The place where a row is read tells even repeated rows apart.
    placed = lookup_join(held.withColumn("_read", F.monotonically_increasing_id()), stage(strata, "strata"), ["m"], "inner", spread_by=["_read"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("_read"), F.col("blocks")).cast("int")).select("m", "block", "_id", "terms", "tfs")

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("_id", "ascending")])  # nulls last
        lists = [group.column(c).combine_chunks() for c in ("terms", "tfs")]
        doc = np.repeat(np.arange(group.num_rows, dtype=np.int32), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        order = np.lexsort((doc, -tf, term))
        term, tf = term[order], tf[order]
        first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tf) != 0)))
        head = first[np.append(True, np.diff(term[first]) != 0)]
        row = {
            "m": group.column("m")[0].as_py(), "block": group.column("block")[0].as_py(), "docs": group.column("_id").to_pylist(),
            "terms": term[head], "most": tf[head], "run_terms": term[first], "run_tfs": tf[first], "run_ends": np.append(first[1:], len(term)), "postings": doc[order],
        }
        kinds = {"m": pa.int64(), "block": pa.int32(), "docs": pa.list_(pa.int64())}
        return pa.table({c: pa.array([v], kinds.get(c, pa.list_(pa.int32()))) for c, v in row.items()})

    return stage(placed.groupBy("m", "block").applyInArrow(build, INDEX), "lexical-index")


def numbers(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)


def bounds(queries: Queries, batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The most that a document of the stratum in row i can score, for every item."""
    tops = np.zeros(len(queries.weights), np.int64)
    tops[numbers(batch, "terms", i)] = impact(numbers(batch, "most", i), batch.column("m")[i].as_py())
    return queries.sums(tops)


class Stratum:
    """A row of the index, ready to be asked."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.terms, tfs, self.ends, self.postings = (numbers(batch, c, i) for c in ("run_terms", "run_tfs", "run_ends", "postings"))
        m = batch.column("m")[i].as_py()
        some, at = np.unique(tfs, return_inverse=True)
        self.impacts = impact(some, m)[at]  # once for each tf of the stratum
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.docs = batch.column("docs")[i].values

    def best(self, queries: Queries, item: int, top: int, floor: int) -> tuple[pa.Array, np.ndarray]:
        """The ids and scores of the documents that score best, `floor` and 1 at least; equal scores by id."""
        asked = queries.of(item)
        low, high = np.searchsorted(self.terms, asked), np.searchsorted(self.terms, asked, "right")
        runs = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        sizes = self.ends[runs] - self.starts[runs]
        at = np.repeat(self.starts[runs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        scores = np.zeros(len(self.docs), np.int64)
        np.add.at(scores, self.postings[at], np.repeat(queries.weights[self.terms[runs]] * self.impacts[runs], sizes))
        found = np.flatnonzero(scores >= max(floor, 1))
        if len(found) > top:
            least = np.partition(scores[found], -top)[-top]
            found = found[scores[found] >= least]
        found = found[np.lexsort((found, -scores[found]))][:top]  # documents are in order of their ids
        return self.docs.take(pa.array(found)), scores[found]


HITS = "item int, doc_id bigint, score bigint"


def hits(item: int, docs: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item), pa.int32()), docs, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def best_rows(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def first_floors(index: DataFrame, queries: Queries, top: int) -> np.ndarray:
    """For every item the score of the `top`-th best document among the strata of the greatest bounds; 0 where there are fewer."""

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in queries.ends]
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column("m")[i].as_py(), batch.column("block")[i].as_py()
                for item, bound in enumerate(bounds(queries, batch, i).tolist()):
                    if bound and (len(kept[item]) < FIRST_VISITS or bound > kept[item][-1][0]):
                        kept[item] = sorted([*kept[item], (bound, *place)], key=lambda x: (-x[0], *x[1:]))[:FIRST_VISITS]
        rows = [(item, *x) for item, found in enumerate(kept) for x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["item", "bound", "m", "block"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stratum = Stratum(batch, i)
                for item in batch.column("items")[i].as_py():
                    yield hits(item, *stratum.best(queries, item, top, 1))

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "block")
    chosen = index.select("m", "block", "terms", "most").mapInArrow(promising, "item int, bound bigint, m bigint, block int")
    chosen = chosen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FIRST_VISITS)
    visits = stage(chosen.groupBy("m", "block").agg(F.collect_list("item").alias("items")), "first-visits")
    found = index.join(visits, ["m", "block"]).drop("terms", "most").mapInArrow(visit, HITS)
    floors = np.zeros(len(queries.ends), np.int64)
    for row in best_rows(found, top).filter(F.col("rank") == top).select("item", "score").collect():  # a row for each item asked at most
        floors[row.item] = row.score
    return floors


def search_index(index: DataFrame, queries: Queries, top: int) -> DataFrame:
    """item, doc_id, score, rank: the best documents of every item by number."""
    floors = first_floors(index, queries, top)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of what a task finds, the best of each item are enough; they also raise its floors.
        floor, scores, docs = floors.copy(), [np.zeros(0, np.int64) for _ in floors], [pa.array([], pa.int64()) for _ in floors]
        for batch in batches:
            for i in range(batch.num_rows):
                bound = bounds(queries, batch, i)
                wanted = np.flatnonzero((bound > 0) & (bound >= floor))
                stratum = Stratum(batch, i) if len(wanted) else None
                for item in wanted.tolist():
                    ids, found = stratum.best(queries, item, top, int(floor[item]))
                    if len(found):
                        ids, found = pa.concat_arrays([docs[item], ids]), np.concatenate([scores[item], found])
                        order = np.lexsort((ids.fill_null((1 << 63) - 1).to_numpy(), -found))[:top]
                        docs[item], scores[item] = ids.take(pa.array(order)), found[order]
                        if len(order) == top:
                            floor[item] = max(floor[item], found[order][-1])
        for item, found in enumerate(scores):
            if len(found):
                yield hits(item, docs[item], found)

    return best_rows(index.mapInArrow(visit, HITS), top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The item's id, rank (from 1), doc_id (the document's id as a long) and score of the `top` best documents of each item, of those that
    score above 0; equal scores by ascending id, null ids last.

    Null and empty texts and items have no terms and no rows. Repeated rows of `items` are one item, and rows of one id with
    different texts separate ones; repeated rows of `docs` are documents of their own, each counted."""
    spark = docs.sparkSession
    asked = stage(items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).dropDuplicates(), "items")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 16)).first()[0] or 0
    rounds = max(1, -(-size // ROUND_BYTES))
    found = None
    for k in range(rounds):
        part = asked.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(rounds)) == k)
        rows = part.collect()  # about ROUND_BYTES
        queries = Queries([r["_text"] for r in rows])
        counted = stage(count_terms(docs, queries.vocabulary, id_col, text), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # the asked terms at most
        for row in held:
            queries.weights[row["term"]] = weight(n_docs, row["count"])
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], f"item int, _item {part.schema['_item'].dataType.simpleString()}")
        best = search_index(build_index(counted, n_docs, max(n_terms or 0, 1)), queries, top) if len(queries.terms) else spark.createDataFrame([], HITS + ", rank int")
        best = best.join(F.broadcast(names), "item").select(F.col("_item").alias(item_col), "rank", "doc_id", "score")
        found = best if found is None else found.unionAll(best)
    return found


def search_sql(top: int = 10) -> str:
    lower = lambda c: f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{UPPER.lower()}')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{PATTERN}') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower('text')}, '{PATTERN}')) AS term FROM benchmark),
w AS (SELECT q.item_id, q.term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term) CROSS JOIN s),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM w JOIN tf USING (term) CROSS JOIN s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""
