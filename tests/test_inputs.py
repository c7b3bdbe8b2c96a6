"""Tables that come as folders of parts, documents as files, and the rows that tasks hold at once."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warnloom.catalog import corpus, queries
from warnloom.operators import automaton, similarity
from warnloom.operators.rows import row_slices
from warnloom.sources import files


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables; each is a folder of two parts, as Spark writes it."""
    texts = ["one two three. " * 10, None, "", "late\nlines\n", "same id", "again"]
    ids = [1, 2, 3, None, 7, 7]
    documents = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id BIGINT, text STRING")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    documents.filter("doc_id = 1").select(F.lit(99).cast("long").alias("doc_id"), "text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    turns = [(0, 0, "a"), (7, 0, "b"), (100, 1, "c"), (None, 0, "d")]
    spark.createDataFrame(turns, "conv_id BIGINT, turn INT, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_a_stream_reads_a_table_of_several_parts(spark, tables):
    got = {r.report_id for r in queries.stream(spark, tables).collect()}
    assert got >= {1, 99}


def test_documents_become_files_in_few_folders(spark, tables, tmp_path):
    path = tmp_path / "files"
    corpus.write_text_files(spark, tables, str(path))
    files = [p for p in path.rglob("*") if p.is_file()]
    assert len(files) == 6 and all(p.parent.parent == path for p in files)
    assert {p.name: p.read_text() for p in files}["report-7.txt"] == "same id\nagain\n"
    assert {int(p.parent.name) for p in files} <= set(range(corpus.FOLDERS))


def test_files_are_read_as_their_documents(spark, tables):
    got = sorted(r.text for r in queries.read_text_files(spark, tables).collect())
    assert got == sorted(["one two three. " * 10, "one two three. " * 10, "", "", "late\nlines\n", "same id\nagain"])


def test_turns_of_every_conversation_are_asked(spark, tables):
    assert {r.query_id for r in queries.conversation_turns(spark, tables).collect()} == {"0-0", "7-0", "100-1", None}


def test_phrases_are_searched_for_in_a_few_rows_at_once(spark):
    texts = spark.range(1000).select(F.col("id").cast("string").alias("text")).coalesce(1)
    sizes = automaton.with_computed(texts, "n", "int", F.col("text"), lambda rows: [len(rows)] * len(rows))
    assert sizes.agg(F.max("n"), F.count("*")).first()[:] == (256, 1000)


def test_row_slices_keep_rows_and_lists():
    batch = pa.RecordBatch.from_pydict({"x": list(range(600)), "y": [[i, i] for i in range(600)]})
    cut = list(row_slices(iter([batch])))
    assert [b.num_rows for b in cut] == [256, 256, 88]
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()


def test_weights_of_many_reports_are_those_of_each(spark):
    texts = spark.range(600).select(F.col("id").alias("report_id"), F.concat(F.lit("alpha beta "), F.when(F.col("id") % 3 > 0, F.concat(F.lit("word"), F.col("id") % 5))).alias("text")).coalesce(1)
    vectors = similarity.term_vectors(texts.withColumn("text", F.coalesce("text", F.lit(""))))
    vocabulary = similarity.top_vocabulary(vectors)
    squares = similarity.tfidf_weights(vectors, vocabulary, 600).groupBy("report_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert squares.count() == 400 and squares.filter("abs(n - 1) > 1e-9").count() == 0


def test_the_folder_of_files_is_plain(spark, tables, tmp_path):
    corpus.write_text_files(spark, tables, str(tmp_path / "again"))
    assert not [p for p in Path(tmp_path / "again").rglob("*") if p.name.startswith((".", "_"))]


def test_files_are_listed_as_by_the_binary_source(spark, tmp_path):
    root = tmp_path / "in"
    names = ["a.txt", "B.TXT", "c.pdf", "none", ".h.txt", "_h.txt", "_k=1.txt", "x y%20.txt", "é.txt", "d/e.txt", "d/f/g.TxT", ".d/h.txt", "_d/h.txt", "_k=2/i.txt", "z.txt/j.txt", "w.txt._COPYING_"]
    for n, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"caf\xe9 " * n)
    (root / "empty").mkdir()
    (root / "l.txt").symlink_to(root / "B.TXT")
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").option("recursiveFileLookup", "true").load(str(root))
    want = sorted(map(tuple, files.decode_report_files(source).collect()))
    for path in (str(root), f"file://{root}/"):
        assert sorted(map(tuple, files.read_text_reports(spark, path).collect())) == want
    assert {r[1] for r in want} >= {"l.txt", "B.TXT", "x y%20.txt", "g.TxT", "i.txt", "j.txt"} and len(want) == 9
    assert sorted(map(tuple, files.read_text_reports(spark, f"{root}/d*").collect())) == [r for r in want if r[1] in ("e.txt", "g.TxT")]
    assert files.read_text_reports(spark, str(root / "empty")).collect() == []


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    for n in range(100 * cores):
        (tmp_path / f"{n}.txt").write_text(str(n))
    monkeypatch.setattr(files, "READ_BYTES", 50)
    monkeypatch.setattr(files, "LISTED_ROWS", 30)
    read = files.read_text_reports(spark, str(tmp_path))
    assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString() and read.rdd.getNumPartitions() == 4 * cores
    assert sorted(int(r.text) for r in read.collect()) == list(range(100 * cores))
