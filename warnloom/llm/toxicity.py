"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults and threats by weighted stems that are learned from labels, and targets,
negations and reported speech by short word lists. Small machines over these symbols (is a negation
near, is the speech reported, is someone addressed) are composed into one deterministic machine that
reads a text once. It scores matched clauses: an insult counts by the context that its clause puts it
in. A logistic model, fitted on labels too, weighs the contexts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import crc_part, pieces

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

TARGETS = "you your yours youre u he she him her they them their these those people du dich dir ihr euch sie er tu toi te vous votre il elle ils tú ti usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never nor neither isnt arent dont doesnt wasnt without nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás tampoco sin".split()
REPORTS = "said says say called calls wrote writes claimed claims quoted quote alleged reported sagte sagt nannte schrieb behauptete dit disait écrit appelle affirme dijo dice llamó escribió afirma".split()
THREATS = "kill murder hurt destroy burn shoot stab beat töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar".split()

TOKEN = re.compile(r"[^\W_]+|[.!?;:\n\"“”«»„]")
ENDS = frozenset(".!?;\n")
QUOTES = frozenset('"“”«»„')


@dataclass
class Machine:
    """A deterministic transducer: by state and symbol the next state; by state the mark it gives."""

    step: list[list[int]]
    mark: list[int]


def negation_machine(reach: int = 3) -> Machine:
    """Marks the words up to `reach` after a negation."""
    step = [[reach if s == NEGATION else 0 if s == END else max(k - 1, 0) for s in range(7)] for k in range(reach + 1)]
    return Machine(step, [int(k > 0) for k in range(reach + 1)])


def flag_machine(symbol: int) -> Machine:
    """Marks the rest of a clause once `symbol` has come."""
    return Machine([[1 if s == symbol else 0 if s == END else at for s in range(7)] for at in range(2)], [0, 1])


def compose(*machines: Machine) -> Machine:
    """The product: all machines read the same symbols; the marks become the bits of one mark."""
    states = list(itertools.product(*(range(len(m.mark)) for m in machines)))
    number = {state: i for i, state in enumerate(states)}
    step = [[number[tuple(m.step[at][s] for m, at in zip(machines, state, strict=True))] for s in range(7)] for state in states]
    mark = [sum(m.mark[at] << i for i, (m, at) in enumerate(zip(machines, state, strict=True))) for state in states]
    return Machine(step, mark)


CLAUSE = compose(negation_machine(), flag_machine(REPORT), flag_machine(TARGET))
NEGATED, REPORTED, TARGETED = 1, 2, 4
# Features: number and greatest weight of insults by context (plain, negated, reported; targeted or not), threats, length.
CONTEXTS = 6
FEATURES = 2 * CONTEXTS + 2


@dataclass
class Grammar:
    """Stem weights and what has been looked up: word to symbol and weight."""

    stems: dict[str, float]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        self.sizes = sorted({len(stem.rstrip("$")) for stem in self.stems})
        self.fixed = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a word and its weight, by its own entry or the longest stem it starts with."""
        found = self.known.get(word)
        if found is None:
            weight = self.stems.get(word + "$", 0.0)
            if not weight:
                for size in reversed(self.sizes):
                    if size <= len(word) and word[:size] in self.stems:
                        weight = self.stems[word[:size]]
                        break
            if weight > 0:
                found = (INSULT, weight)
            elif word in ENDS:
                found = (END, 0.0)
            elif word in QUOTES:
                found = (REPORT, 0.0)
            else:
                found = (self.fixed.get(word, OTHER), 0.0)
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        out = [0.0] * FEATURES
        read = [self.symbol(word) for word in TOKEN.findall(text.lower())]
        out[-1] = math.log1p(len(read))
        if not any(symbol in (INSULT, THREAT) for symbol, _ in read):
            return out
        state, hits = 0, []
        for symbol, weight in itertools.chain(read, [(END, 0.0)]):
            if symbol == END:
                aim = 3 if CLAUSE.mark[state] & TARGETED else 0
                for mark, kind, w in hits:
                    if kind == THREAT:
                        out[2 * CONTEXTS] += 1.0 if aim and not mark & NEGATED else 0.0
                        continue
                    context = aim + (2 if mark & REPORTED else 1 if mark & NEGATED else 0)
                    out[context] += 1.0
                    out[CONTEXTS + context] = max(out[CONTEXTS + context], w)
                hits = []
            elif symbol in (INSULT, THREAT):
                hits.append((CLAUSE.mark[state], symbol, weight))
            state = CLAUSE.step[state][symbol]
        for i in [*range(CONTEXTS), 2 * CONTEXTS]:
            out[i] = math.log1p(out[i])
        return out


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray  # of the features, then the constant

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.grammar.features(text) for text in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_frequencies(sample: DataFrame) -> DataFrame:
    """word, toxic, n: documents of the sample with the word, and toxic ones; summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(text.lower()) if w[0].isalnum()}
                every.update(words)
                if label:
                    toxic.update(words)
            words = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array(list(every.values()), pa.int64())], ["word", "toxic", "n"]
            )

    counted = sample.select("_text", "_y").mapInArrow(count, "word string, toxic bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def learn_stems(sample: DataFrame, docs: int, toxic_docs: int, most: int = 20_000, error: float = 0.01) -> dict[str, float]:
    """Stems of 4 to 8 characters, and whole words (ending in $), that mark toxic texts: by a likelihood
    ratio test against the share of toxic texts, corrected for the number of stems tried. Weights are
    log odds. A longer stem is left out where a shorter one says the same. At most `most` stems, the
    strongest."""
    if not toxic_docs or toxic_docs == docs:
        return {}
    base = toxic_docs / docs
    stems = F.array_distinct(
        F.concat(
            F.array(F.concat("word", F.lit("$"))),
            F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.when(F.length("word") >= k, F.substring(F.col("word"), F.lit(1), k))),
        )
    )
    counted = (
        word_frequencies(sample)
        .select(F.explode(stems).alias("stem"), "toxic", "n")
        .filter("stem IS NOT NULL")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.max("n").alias("word_n"))
    )
    share = F.col("toxic") / F.col("n")
    clean = F.col("n") - F.col("toxic")
    gain = F.col("toxic") * F.log(share / base) + F.when(clean > 0, clean * F.log(clean / F.col("n") / (1 - base))).otherwise(0.0)
    found = (
        counted.filter(share > max(0.5, min(0.9, 3 * base)))
        .select("stem", "toxic", "n", gain.alias("gain"))
        .filter(F.col("gain") > math.log(1e6 / error) / 2)
        .orderBy(F.desc("gain"), "stem")
        .limit(most)
        .collect()
    )
    odds = math.log(base / (1 - base))
    weight = {r.stem: math.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5)) - odds for r in found}
    kept: dict[str, float] = {}
    for stem in sorted(weight, key=lambda s: (len(s.rstrip("$")), s.endswith("$"), s)):
        bare = stem.rstrip("$")
        shorter = [kept[bare[:k]] for k in range(4, len(bare) + stem.endswith("$")) if bare[:k] in kept]
        if not shorter or weight[stem] > max(shorter) + 1:
            kept[stem] = weight[stem]
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, id_col: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most `rows` labelled texts (of those with the smallest hashes of their ids), a bounded
    sample. `labels` has the id and `toxic`, 0 or 1; of repeated labels the greater counts, null ones are
    left out."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_y")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    grammar = Grammar(learn_stems(sample, total, toxic))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            x = [grammar.features(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("_y")], ["x", "y"])

    found = sample.mapInArrow(read, "x array<double>, y int").limit(2 * rows).collect()
    y = np.array([r.y for r in found], float)
    if not len(y) or y.min() == y.max():
        constant = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0
        return Model(grammar, np.append(np.zeros(FEATURES), constant))
    return Model(grammar, fit_logistic(np.array([r.x for r in found]), y))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score: how likely each text is toxic, 0 to 1. Only the text is read; a null text counts as
    empty. One row for each row; no shuffle, and memory is bounded by some MB of text or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            score = model.score(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(score, pa.float64())], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return read.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that learns from those whose crc32(doc_id) mod 5 is not 0:
    doc_id, held_out, score, predicted."""
    model = fit(docs.filter(crc_part(F.col("doc_id")) != 0), labels.filter(crc_part(F.col("doc_id")) != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_part(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
