"""Secrets in texts, with multipart credentials linked.

Strong finds are reported as they are. Weak candidates (identifiers, random-looking strings, endpoints)
are parts of a credential: a secret is reported only where an identifier or an endpoint lies within its scope, a
number of code points on either side, and those two only where a secret does; an identifier beside an endpoint is none. That
interval join is made inside the row on the parts sorted by start: for each role the greatest end so far and the least
start to come tell whether a part is near. The secrets with the nearest parts of both other roles are the credentials found.
All of it is DataFrame expressions, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bind

# The base patterns. The two simple ones ask for the least length at once; their runs are
# as long as they can be, so this drops the same matches as a later test.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak candidates.
WEAK_ID = r"""(?<![A-Za-z0-9])(?:(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+|(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])(?!AKIA)[A-Z0-9]{16,}+(?![A-Za-z0-9]))"""
# The look-aheads begin where a run begins, and stop at the first character that decides: linear, however long the run.
WEAK_SECRET = r"(?<![A-Za-z0-9+/.:?=&%-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{20,}+={0,2}(?![A-Za-z0-9+/])"
ENDPOINT = r"(?:https?|ftps?|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+"

IDENTIFIER, SECRET, PLACE = "identifier", "secret", "place"
KINDS = (  # kind, pattern, role, weak; in the order in which kinds are listed
    ("assign", ASSIGN, SECRET, False),
    ("access", ACCESS, IDENTIFIER, False),
    ("hex", HEX, SECRET, False),
    ("weak_id", WEAK_ID, IDENTIFIER, True),
    ("weak_secret", WEAK_SECRET, SECRET, True),
    ("endpoint", ENDPOINT, PLACE, True),
)
SCOPE = 200
BLOCK = 256


def running(values: Column, op, start: Column) -> Column:
    """Running totals of an array under `op`, in blocks, so that the growing arrays stay short."""

    def scan(items: Column, first: Column) -> Column:
        return F.slice(
            F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))), 2, F.greatest(F.size(items), F.lit(0))
        )

    def body(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start)
        )
        return bind(
            blocks,
            lambda bs: bind(
                F.concat(F.array(start), scan(F.transform(bs, lambda b: F.element_at(b, -1)), start)),
                lambda before: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: op(F.get(before, i), x)))),
            ),
        )

    return F.when(F.size(values) > 0, bind(values, body)).otherwise(F.slice(F.array(start), 1, 0))


def spans(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, hit): the matches in code points. Positions are the running lengths of
    matches and of what a split by the same pattern leaves between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(h: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = bind(gaps, lambda g: running(F.transform(h, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("long")), lambda a, b: a + b, F.lit(0).cast("long")))
        return bind(ends, lambda e: F.transform(h, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("hit"))))

    empty = F.expr("slice(array(named_struct('start', 0L, 'end', 0L, 'hit', '')), 1, 0)")
    return bind(hits, lambda h: F.when(F.size(h) > 0, place(h)).otherwise(empty))


def parts(text: Column, kind: int) -> Column:
    name, pattern, role, weak = KINDS[kind]
    found = spans(text, pattern)
    if name == "assign":  # the value needs six characters
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["hit"], pattern, 2)) >= 6)
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind"), F.lit(role).alias("role"), F.lit(weak).alias("weak")),
    )


def linked(found: Column, scope: int) -> Column:
    """The strong parts, and the weak ones near what makes them a credential: for a secret any other role, else a secret."""
    far = 1 << 60

    def body(p: Column) -> Column:
        def ends(role: str) -> Column:
            return running(F.transform(p, lambda x: F.when(x["role"] == role, x["end"]).otherwise(-far)), F.greatest, F.lit(-far))

        def starts(role: str) -> Column:
            return F.reverse(running(F.reverse(F.transform(p, lambda x: F.when(x["role"] == role, x["start"]).otherwise(far))), F.least, F.lit(far)))

        near = F.array(*[F.struct(F.lit(r).alias("role"), ends(r).alias("ends"), starts(r).alias("starts")) for r in (IDENTIFIER, SECRET, PLACE)])
        return bind(
            near,
            lambda by_role: F.filter(
                p,
                lambda x, i: ~x["weak"]
                | F.exists(by_role, lambda r: ((r["role"] == SECRET) != (x["role"] == SECRET)) & ((F.get(r["ends"], i) >= x["start"] - scope) | (F.get(r["starts"], i) <= x["end"] + scope))),
            ),
        )

    return bind(found, body)


def nearest(p: Column, role: str) -> tuple[Column, Column]:
    """For every part the place of the last part of a role before it, -1 if none, and of the next one, the size if none."""
    at = F.transform(p, lambda x, i: F.when(x["role"] == role, i))
    last = running(F.transform(at, lambda i: F.coalesce(i, F.lit(-1))), F.greatest, F.lit(-1))
    following = F.reverse(running(F.reverse(F.transform(at, lambda i: F.coalesce(i, F.size(p)))), F.least, F.size(p)))
    return last, following


def credentials(found: Column, scope: int) -> Column:
    """Structs (secret, identifier, place) of the secrets with a part of another role in scope: of each role the one
    that begins last before, if it is at least as near as the next one after."""
    empty = F.array().cast("array<struct<secret:struct<start:bigint,rank:int,end:bigint,kind:string,role:string,weak:boolean>,identifier:struct<start:bigint,rank:int,end:bigint,kind:string,role:string,weak:boolean>,place:struct<start:bigint,rank:int,end:bigint,kind:string,role:string,weak:boolean>>>")

    def body(p: Column) -> Column:
        near = F.array(*[F.struct(last.alias("last"), following.alias("next")) for last, following in (nearest(p, IDENTIFIER), nearest(p, PLACE))])

        def part(x: Column, i: Column, by_role: Column, k: int) -> Column:
            last, following = F.get(p, F.get(F.get(by_role, F.lit(k))["last"], i)), F.get(p, F.get(F.get(by_role, F.lit(k))["next"], i))
            before = F.when(last.isNotNull(), F.greatest(x["start"] - last["end"], F.lit(0)))
            after = F.when(following.isNotNull(), F.greatest(following["start"] - x["end"], F.lit(0)))
            return F.when((before <= scope) & (after.isNull() | (before <= after)), last).when(after <= scope, following)

        return bind(
            near,
            lambda by_role: F.filter(
                F.transform(p, lambda x, i: F.struct(F.when(x["role"] == SECRET, x).alias("secret"), part(x, i, by_role, 0).alias("identifier"), part(x, i, by_role, 1).alias("place"))),
                lambda c: c["secret"].isNotNull() & (c["identifier"].isNotNull() | c["place"].isNotNull()),
            ),
        )

    return F.when(F.size(found) > 1, bind(found, body)).otherwise(empty)


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`docs` with `base` and `secrets`: sorted arrays of struct(start, rank, end, kind, role, weak), the finds of
    the base patterns and those with linked weak parts; and `credentials`, see there. A null text counts as empty and has none."""
    read = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for k in range(len(KINDS)):
        read = read.withColumn(f"_p{k}", parts(F.col("_text"), k))
    base = [F.col(f"_p{k}") for k, kind in enumerate(KINDS) if not kind[3]]
    weak = [F.col(f"_p{k}") for k, kind in enumerate(KINDS) if kind[3]]
    read = read.withColumn("base", F.sort_array(F.concat(*base))).withColumn("_weak", F.concat(*weak))
    secrets = F.when(F.size("_weak") == 0, F.col("base")).otherwise(linked(F.sort_array(F.concat("base", "_weak")), scope))
    read = read.withColumn("secrets", secrets).withColumn("credentials", credentials(F.col("secrets"), scope))
    return read.drop("_text", "_weak", *[f"_p{k}" for k in range(len(KINDS))])


def label(part: Column) -> Column:
    return F.concat_ws(":", part["kind"], part["start"].cast("string"), part["end"].cast("string"))


def joined(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(found, label), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, all spans as a string, and the credentials: a secret and
    the parts linked with it, joined by +."""
    found = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.array_join(F.transform("credentials", lambda c: F.concat_ws("+", *[F.when(c[r].isNotNull(), label(c[r])) for r in (SECRET, IDENTIFIER, PLACE)])), ",").alias("credentials"),
    )
