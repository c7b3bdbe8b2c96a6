"""Quality numbers and verdicts against a plain version, and the binomial bound."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from warnloom.llm.quality_rules import RULES, binomial_at_most, keep_good, quality_metrics, quality_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def texts(n=300):
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "a b a b a b", "x y z x y z", "é ü 漢 #*|", "w\n\nw\nw \n"]
    for _ in range(n):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 10, 400]))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", " # "]) for _ in range(rng.randint(0, 200))))
    return out


def test_numbers_equal_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = quality_metrics(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).orderBy("doc_id").select("quality.*").collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(r[n] for n in names) for r in got] == [plain(t) for _, t in rows]


def test_binomial_is_exact(spark):
    cases = [(k, n) for n in (0, 1, 50, 400, 5000) for k in (0, 1, 3, 20) if k <= n]
    got = [r.p for r in spark.createDataFrame(cases, "k BIGINT, n BIGINT").coalesce(1).select(binomial_at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        want = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k <= n * 0.01 else 1.0
        assert math.isclose(p, want, rel_tol=1e-6)


def test_cutoffs_spare_labelled_good_texts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        words = [f"w{rng.randint(0, 5000)}" + ("###" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en", "src"))
        labels.append((i, 0 if bad else 1))
    rows += [(None, None, None, None), (1, " ".join(f"v{k}" for k in range(60)), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, cutoffs STRING")
    marked = spark.createDataFrame(labels, "doc_id BIGINT, quality INT")
    got = quality_rules(docs, marked).collect()
    assert len(got) == 6002
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id % 10 == 0)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id % 10)
    kept = keep_good(docs, marked)
    assert kept.columns == docs.columns and kept.count() == 5401
    assert quality_rules(docs.limit(0), marked.limit(0)).count() == 0


def test_no_labels_reject_nothing_more(spark):
    docs = spark.createDataFrame([(1, " ".join(f"#v{k}" for k in range(60)), "en")], "doc_id BIGINT, text STRING, lang STRING")
    assert quality_rules(docs, spark.createDataFrame([], "doc_id BIGINT, quality INT")).first().kept


def values(text):
    n, chars, symbols, dup, repeats, _ = plain(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    capitals, marks = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text or "")), len(re.findall(r"[!?]", text or ""))
    part = lambda a, b: a / b if b else 0.0
    return {"symbols": part(symbols, n), "repeats": part(repeats, n), "dup_lines": part(dup, lines), "capitals": capitals / max(chars, 1), "marks": part(marks, n), "long_words": part(chars, n)}


def plain_verdicts(rows, labels, allowed=0.03, error=0.05):
    """Of each row whether it is kept: cutoffs are tried from lax to strict up to the first that isn't shown to be safe."""
    good = {d for d, q in labels if q == 1}
    held = {}
    for d, text, lang in rows:
        if d in good and not plain(text)[-1]:
            held.setdefault(lang or "", []).append(values(text))
    cutoffs = {}
    for lang, seen in held.items():
        for rule, (_, grid) in RULES.items():
            p, n = allowed / len(RULES), len(seen)
            for cutoff in grid:
                k = sum(v[rule] > cutoff for v in seen)
                tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
                if tail > error / (len(RULES) * len(held)):
                    break
                cutoffs[lang, rule] = cutoff
    return [not plain(t)[-1] and not any(v > cutoffs.get((lang or "", rule), math.inf) for rule, v in values(t).items()) for _, t, lang in rows], cutoffs


def test_cutoffs_and_verdicts_equal_the_plain_version(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(4200):
        lang = rng.choices(["en", "de", "fr", None], [60, 35, 2, 3])[0]
        words = [rng.choice(["", "A", "AB"]) + f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(50, 70))]
        odd = rng.random()
        if odd < 0.01:
            words = [w + rng.choice(["#", "!", "?!", "X" * 9, "\n"]) for w in words]
        elif odd < 0.012:
            words = [w + "##" for w in words]
        elif odd < 0.1:
            words = ["ab"] * rng.randint(10, 25) + words
        rows.append((i, " ".join(words), lang))
        if rng.random() < 0.9:
            labels.append((i, int(rng.random() < 0.97)))
    rows.append((5000, "long " * 40_000, "en"))
    want, cutoffs = plain_verdicts(rows, labels)
    got = quality_rules(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), spark.createDataFrame(labels, "doc_id BIGINT, quality INT"))
    assert [r.kept for r in got.orderBy("doc_id").collect()] == want
    assert {lang for lang, _ in cutoffs} == {"en", "de"} and len(set(cutoffs.values())) > 5 and 0 < want.count(False) < len(want)
