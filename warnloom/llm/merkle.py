"""A Merkle manifest of a table, built by sibling-shift self-joins.

Rows are leaves; each tree (here: each language) holds its leaves in order, and every `fan` neighbours have one
parent. A level is one equijoin: a node is sent to the computed indices of its siblings (its run's start plus
each slot), where it meets the node that stands there, which so gets the digests before and after its own.
The node in slot zero of each run then emits the parent. What remains of the trees are the leaves of a last
tree over all of them, built the same way. Proofs are joined from the top down, so that the joins shrink by
`fan` with every level, and only the leaves' own level moves as many rows as there are.

Digests are kept as 32 bytes and hashed as lower-case hex text. No group is larger than a run of `fan`; the places
of the leaves come from a range partitioning by (tree, order), whose partitions are numbered in one small table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..sources.staging import stage
from .words import ascii_lower

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
EMPTY = b""


def digest(data: Column) -> Column:
    """sha256 of a text or binary value, as 32 bytes."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def node_digest(*digests: Column) -> Column:
    """The digest of a node from joined digests below it."""
    return digest(hex_text(F.concat(*digests)))


def field(value: Column) -> Column:
    """A value as it enters a leaf: its size in UTF-8 bytes, a colon and itself; `-` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def tree_name(value: Column) -> Column:
    """Names of trees that sort as the values do, nulls first, and are never null."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` (tree and any columns) with `idx`, the place in the tree by `order`, and `size`, the leaves of the tree.

    Rows are dealt by range and sorted in each partition; the one small table has a row for each partition and
    tree in it. Repeated rows are told apart by where they were read, so even those of one id spread."""
    keys = ["tree", *order, "_read"]
    sorted_ = leaves.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    placed = stage(sorted_.withColumn("_place", F.monotonically_increasing_id()), "leaves-placed").withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy("tree", "_part").agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"), F.sum("n").over(whole).alias("size"))
    found = lookup_join(placed, stage(runs, "leaf-runs"), ["tree", "_part"], "inner", spread_by=["_place"])
    return found.withColumn("idx", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def joined(items: Column) -> Column:
    return F.aggregate(items, F.lit(EMPTY), lambda whole, x: F.concat(whole, x["digest"]))


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """`nodes` (tree, idx, size, digest) with the joined digests `before` and `after` theirs in the run."""
    shifted = nodes.select("tree", "digest", "size", F.col("idx").alias("from"), F.explode(F.array(*[F.lit(k) for k in range(fan)])).alias("slot"))
    shifted = shifted.withColumn("idx", F.col("from") - F.col("from") % fan + F.col("slot")).filter("idx <> from AND idx < size")
    others = shifted.groupBy("tree", "idx").agg(F.sort_array(F.collect_list(F.struct((F.col("from") % fan).alias("slot"), "digest"))).alias("_others"))
    met = nodes.join(others, ["tree", "idx"], "left").withColumn("_others", F.coalesce("_others", F.array().cast("array<struct<slot:bigint,digest:binary>>")))
    own = F.col("idx") % fan
    sides = {"before": joined(F.filter("_others", lambda x: x["slot"] < own)), "after": joined(F.filter("_others", lambda x: x["slot"] > own))}
    return met.withColumns(sides).drop("_others")


def parents(linked: DataFrame, fan: int) -> DataFrame:
    """The parents, emitted by the nodes in slot zero."""
    return linked.filter(F.col("idx") % fan == 0).select(
        "tree", F.expr(f"idx DIV {fan}").alias("idx"), F.expr(f"(size + {fan - 1}) DIV {fan}").alias("size"), node_digest(F.col("digest"), F.col("after")).alias("digest")
    )


def climb(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels with siblings, leaves first, and tree, digest, level: what remains of each tree and where.
    The last level in the list has lone nodes only; a level keeps the columns of `nodes` if it is the first."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, tops = [], []
    while True:
        # Lone nodes have no siblings and take no part in the join.
        linked = with_siblings(nodes.filter("size > 1"), fan)
        alone = nodes.filter("size = 1")
        linked = stage(linked.unionByName(alone.withColumns({"before": F.lit(EMPTY), "after": F.lit(EMPTY)})), f"level-{len(levels)}")
        tops.append(linked.filter("size = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        levels.append(linked)
        if most <= 1:
            return levels, reduce(DataFrame.unionAll, tops)
        nodes, most = parents(linked.filter("size > 1"), fan), -(-most // fan)


PATH = "array<struct<before:binary,after:binary>>"


def descend(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The leaves with `path`: the siblings of every level up to the root, lowest first, and with the columns of
    `tops` (tree, level, path: that of the tree's last node), which are the same for all leaves of a tree."""
    paths, carried = None, [c for c in tops.columns if c not in ("tree", "level")]
    for level in range(len(levels) - 1, -1, -1):
        here = levels[level].join(tops.filter(F.col("level") == level).drop("level"), "tree").filter("size = 1").drop("before", "after")
        if paths is not None:
            above = paths.select("tree", F.col("idx").alias("_up"), *carried)
            linked = levels[level].filter("size > 1").withColumn("_up", F.expr(f"idx DIV {fan}")).join(above, ["tree", "_up"]).drop("_up")
            step = F.array(F.struct("before", "after")).cast(PATH)
            here = here.unionByName(linked.withColumn("path", F.concat(step, F.col("path"))).drop("before", "after"))
        paths = here
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: node_digest(x["before"], node, x["after"]))


def proof_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, level by level, left to right."""
    every = F.aggregate(path, F.lit(EMPTY), lambda whole, x: F.concat(whole, x["before"], x["after"]))
    return hex_text(digest(hex_text(every)))


def manifest(leaves: DataFrame, order: list[str], fan: int = FAN) -> DataFrame:
    """`leaves` (tree, digest and other columns) with subroot, root and path, all digests binary. Trees are the
    leaves of the last one by name. Equal leaves of equal order stand side by side; which comes first makes no difference.
    No rows give no rows."""
    levels, remains = climb(numbered(leaves, order), fan)
    top = numbered(stage(remains.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "level"), "subroots"), ["name"])
    over, root = climb(top, fan)
    root = root.select("tree", "level", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(over, root, fan).select(F.col("name").alias("tree"), "level", F.col("digest").alias("subroot"), "root", "path")
    return descend(levels, tops, fan).drop("idx", "size", "tree")


def document_leaves(docs: DataFrame, changed_text: Column | None = None, where: Column | None = None) -> DataFrame:
    """tree, doc_id, digest of each row of `documents`, and `changed`: its digest with `changed_text` instead, where asked."""
    values = [F.col(c) for c in COLUMNS]
    changed = F.lit(None).cast("binary") if where is None else F.when(where, leaf_digest([*values[:-1], changed_text]))
    return stage(docs.select(tree_name(F.col("lang")).alias("tree"), "doc_id", leaf_digest(values).alias("digest"), changed.alias("changed")), "leaves")


def verify_documents(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `docs` (doc_id, source, lang, n_chars,
    text; other columns are not read).

    Leaves are ordered by doc_id in each language, null ids and languages first. Where 3 divides crc32 of the id as text
    (empty for a null), the row is folded with its text's A-Z lowered; a text without any stays verified, as
    does a null one. A lone leaf is its tree's root, and a proof without siblings is that of no bytes."""
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    rows = manifest(document_leaves(docs, ascii_lower(F.col("text")), tampered), ["doc_id", "digest"], fan)
    rows = rows.withColumn("folded", folded(F.coalesce("changed", "digest"), F.col("path")))
    return rows.select(
        "doc_id",
        hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def verify_sql(levels: int = 8, top_levels: int = 3, fan: int = FAN) -> str:
    """The same in SQL, with a fixed number of levels: enough for fan ** levels documents a language."""
    crc = (
        "xor(4294967295, list_reduce([4294967295::BIGINT] || flatten([[ascii(substr(s, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]"
        " for i in range(1, length(s) + 1)]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    )
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, COLUMNS[:-1]), value(text)]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"read AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS s, coalesce('1' || lang, '0') AS tree FROM documents)",
        f"leaves AS (SELECT doc_id, tree, {leaf('text')} AS h, {crc} % 3 = 0 AS hit, {leaf(lowered)} AS changed,"
        " row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM read)",
        "a0 AS (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS size FROM leaves)",
    ]

    def level(name: str, k: int) -> None:
        parts.append(
            f"{name}s{k} AS (SELECT a.tree, a.idx, any_value(a.h) AS h, any_value(a.size) AS size,"
            " coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r"
            f" FROM {name}{k} a LEFT JOIN {name}{k} b ON a.tree = b.tree AND a.idx // {fan} = b.idx // {fan} AND a.idx <> b.idx GROUP BY a.tree, a.idx)"
        )
        parts.append(
            f"{name}{k + 1} AS (SELECT tree, idx // {fan} AS idx, CASE WHEN size = 1 THEN h ELSE sha256(h || r) END AS h,"
            f" (size + {fan - 1}) // {fan} AS size FROM {name}s{k} WHERE idx % {fan} = 0)"
        )

    for k in range(levels):
        level("a", k)
    parts.append(f"b0 AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM a{levels})")
    for k in range(top_levels):
        level("b", k)
    joins = [("a", k, "d.tree", "d.idx") for k in range(levels)] + [("b", k, "''", "t.idx") for k in range(top_levels)]
    before = "(SELECT d.doc_id, d.h AS leaf, CASE WHEN hit THEN changed ELSE d.h END AS f, t.h AS subroot, w.h AS root"
    for i, (name, k, _, _) in enumerate(joins):
        before += f", {name}s{k}.l AS l{i}, {name}s{k}.r AS r{i}, {name}s{k}.size AS z{i}"
    before += f" FROM leaves d JOIN b0 t ON t.name = d.tree CROSS JOIN b{top_levels} w"
    for name, k, tree, idx in joins:
        before += f" JOIN {name}s{k} ON {name}s{k}.tree = {tree} AND {name}s{k}.idx = {idx} // {fan**k}"
    parts.append(f"f0 AS {before})")
    for i in range(len(joins)):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN z{i} > 1 THEN sha256(l{i} || f || r{i}) ELSE f END AS f) FROM f{i})")
    every = " || ".join(f"l{i} || r{i}" for i in range(len(joins)))
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({every}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(joins)}"
    )
