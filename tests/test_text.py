import random
import re

from pyspark.sql import functions as F

from warnloom.functions import text as T
from warnloom.functions.core import WHITESPACE
from warnloom.operators import text
from warnloom.sources import files


def evaluate(df, column):
    return [row[0] for row in df.orderBy("report_id").select(column).collect()]


def random_texts(alphabet, count, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(length))) for _ in range(count)]


def test_whitespace_list_is_pythons():
    assert sorted(WHITESPACE) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_clean_text_keeps_lines_and_collapses_blanks(spark, report):
    df = report("  a\t\t b\r\nc\rd\n\n\n\n e  ", " x\xa0\x1f", "", None)
    assert evaluate(df, T.clean_text(F.col("text"))) == ["a b\nc\nd\n\n e", "x", "", ""]


def test_clean_text_on_random_texts(spark, report):
    texts = random_texts("ab \t\n\r\xa0", 400, 40, 1)
    blanks, lines = re.compile("[ \t]+"), re.compile("\n{3,}")
    want = [
        lines.sub("\n\n", blanks.sub(" ", t.replace("\r\n", "\n").replace("\r", "\n"))).strip()
        for t in texts
    ]
    assert evaluate(report(*texts), T.clean_text(F.col("text"))) == want


def test_refang(spark, report):
    df = report("hXXp://a[.]b(.)c{.}d HXXPS://x hxxpsy éhxxp a[:]b [at]", "hxxp")
    assert evaluate(df, T.refang(F.col("text"))) == [
        "http://a.b.c.d https://x hxxpsy éhxxp a[:]b [at]", "http",
    ]


def test_word_count_is_unicode(spark, report):
    texts = ["Ünïcode wörds_1 and ٣٤ — 中文 x²", "", "...", "éa"]
    assert evaluate(report(*texts), T.word_count(F.col("text"))) == [
        len(re.findall(r"\w+", t)) for t in texts
    ]


def test_space_words_counts_like_split(spark, report):
    texts = random_texts("ab .\n\xa0 \x1f\x85", 300, 30, 2)
    assert evaluate(report(*texts), T.space_words(F.col("text"))) == [len(t.split()) for t in texts]


def test_sentences(spark, report):
    df = report('One. Two!  "Three?" Four... five v1.2 end', "", "no end\nsame sentence", "...\n\n.")
    assert evaluate(df, T.sentences(F.col("text"))) == [
        ["One.", "Two!", '"Three?"', "Four...", "five v1.2 end"], [], ["no end\nsame sentence"],
        ["...", "."],
    ]


def test_min_length_counts_stripped_characters(spark, report):
    df = report("x" * 49, "x" * 50, "  " + "x" * 49 + "\n\n", "\xa0" + "y" * 50)
    assert [r.report_id for r in text.filter_min_length(df).orderBy("report_id").collect()] == [2, 4]


def test_excerpt(spark, report):
    assert evaluate(report("é" * 6001), F.length(T.text_excerpt(F.col("text")))) == [6000]


def test_files_are_decoded_and_sorted_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.TXT").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(b"no")
    read = files.read_text_reports(spark, str(tmp_path))
    assert {(r.filename, r.text) for r in read.collect()} == {("a.txt", "naïve"), ("b.TXT", "naïve")}
    assert len({r.report_id for r in read.collect()}) == 2
    named = spark.createDataFrame([("x.TXT",), ("y.pdf",), ("z.exe",), ("txt",)], "filename STRING")
    accepted, rejected = files.split_supported(named)
    assert [r.filename for r in accepted.collect()] == ["x.TXT"]
    assert {(r.filename, r.reason.split()[0]) for r in rejected.collect()} == {
        ("y.pdf", "pdf"), ("z.exe", "unsupported"), ("txt", "unsupported"),
    }


def test_words_are_counted_without_translation_where_blanks_are_plain(report):
    plain, odd = ["a b\n c  d", " \n", "é\n\nx"], ["a\tb", "x y z", "a b\x1cc", "a\rb"]
    assert evaluate(report(*plain, *odd), T.has_odd_blanks(F.array("text"))) == [False] * 3 + [True] * 4
    assert evaluate(report(*plain), T.plain_words(F.col("text"))) == [len(t.split()) for t in plain]


def test_scans_look_at_the_first_characters_and_find_the_same(report):
    from warnloom.functions import indicators as I, names as N, timeline as D
    from warnloom.functions.core import find_all

    texts = [
        "WannaCry, xwannacry Zeuſ CİSCO cısco K linux_ Windows Server windows serve fancy bear ios. apt28x APT29",
        "on 3 May 2021, ٣ june 2020 ſeptember 1, 2021 xmay 1 2020 March 12 2026 2026-01-02 12/1/20 ١/٢/٣٤ a1/2/20",
        "10.0.0.1 x10.0.0.1 ١.٢.٣.٤ 1.2.3 999.1.1.1",
    ]
    for pattern in (N.NAMES, D.DATE, I.IPV4):
        begin = pattern.index("(?=")
        assert begin == pattern.index(")") + 1
        plain = pattern[:begin] + pattern[pattern.index(r"\b") :]
        assert evaluate(report(*texts), find_all(F.col("text"), pattern)) == evaluate(report(*texts), find_all(F.col("text"), plain))
