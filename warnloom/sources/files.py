"""Reports and CVSS records from files."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cvss import RECORD
from ..functions.text import decode_bytes
from ..operators.joins import lookup_join
from .json_object import object_entries
from .staging import shared_folder, stage

_TEXT_FILES = "*.[tT][xX][tT]"
LISTED_ROWS = 10_000
READ_BYTES = 8 << 20
TASK_FILES = 4096
_BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decode_report_files(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source to report_id, filename, text.

    Files bring no id, so a hash of the path stands in, unless `report_id` is there already.
    """
    report_id = F.col("report_id") if "report_id" in files.columns else F.xxhash64("path")
    return files.select(
        report_id.alias("report_id"),
        _file_name(F.col("path")).alias("filename"),
        decode_bytes(F.col("content")).alias("text"),
    )


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that `path` names in the file system that all machines mount; None if it is in another store, a file or a pattern."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    try:
        shared_folder(spark)
    except ValueError:  # nowhere to keep the list
        return None
    context = spark.sparkContext
    name = context._jvm.org.apache.hadoop.fs.Path(path)
    store = name.getFileSystem(context._jsc.hadoopConfiguration())
    folder = store.makeQualified(name).toUri().getPath()
    return folder if store.getScheme() == "file" and os.path.isdir(folder) else None


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def list_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """The path of every text file below a folder. Tasks list folders, a level at a time, so the driver holds no file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                paths, folders = [], []
                for entry in os.scandir(folder):
                    inner = entry.is_dir()
                    if not _hidden(entry.name) and (inner or (entry.is_file() and fnmatch.fnmatchcase(entry.name, _TEXT_FILES))):
                        paths.append(entry.path)
                        folders.append(inner)
                    if len(paths) == LISTED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])
                        paths, folders = [], []
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    level, found = spark.createDataFrame([(folder,)], "path STRING"), None
    while True:
        listed = stage(level.mapInArrow(look, "path STRING, folder BOOLEAN"), "files-listed")
        files = listed.filter("NOT folder").select("path")
        found = files if found is None else found.unionAll(files)
        level = listed.filter("folder").select("path")
        n = level.count()
        if not n:
            return found
        level = level.repartition(min(n, tasks))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, as Spark's sources write it, and content of the files named; a few MB at a time."""
    paths, contents, size = [], [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as file:
                content = file.read()
            if not content:  # Spark's sources give no row for an empty file
                continue
            if paths and size + len(content) > READ_BYTES:
                yield made()
                paths, contents, size = [], [], 0
            paths.append(f"file:{path}")
            contents.append(content)
            size += len(content)
    yield made()


def read_text_reports(spark: SparkSession, path: str) -> DataFrame:
    """Every .txt file below `path`, in any letter case: report_id, filename, text. UTF-8, else Latin-1.

    A folder of a file system that all machines mount is listed and read by tasks, thousands of small files each; Spark's source
    would hold each file in the driver's memory and give 32 of them to a task. Other stores, patterns and single files are left to it."""
    folder = local_folder(spark, path)
    if folder is not None:
        listed = list_text_files(spark, folder)
        tasks = max(4 * spark.sparkContext.defaultParallelism, -(-listed.count() // TASK_FILES))
        return decode_report_files(listed.repartition(tasks).mapInArrow(_contents, "path STRING, content BINARY"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _TEXT_FILES)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return decode_report_files(files)


def stream_text_reports(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """The same for .txt files that arrive below a folder, as a stream."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_SCHEMA)
        .option("pathGlobFilter", _TEXT_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return decode_report_files(files)


def file_kind(filename: Column) -> Column:
    """txt, pdf (needs its text extracted first) or unsupported, by extension."""
    name = F.lower(filename)
    return (
        F.when(name.endswith(".txt"), "txt").when(name.endswith(".pdf"), "pdf").otherwise("unsupported")
    )


def split_supported(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by file extension; rejected rows say why in `reason`. Rows are never
    failed with an exception, which would stop a job for one file."""
    kinds = df.withColumn("_kind", file_kind(F.col("filename")))
    accepted = kinds.filter("_kind = 'txt'").drop("_kind")
    reason = F.when(F.col("_kind") == "pdf", "pdf text must be extracted first").otherwise(
        "unsupported file type"
    )
    return accepted, kinds.filter("_kind <> 'txt'").withColumn("reason", reason).drop("_kind")


def parse_cvss_json(df: DataFrame, json: str = "value") -> DataFrame:
    """JSON objects of id to record, one per row, to the CVSS dimension. Text that is not JSON gives
    no rows; a null record gives a row of nulls."""
    return (
        df.select(F.from_json(json, f"map<string, {RECORD}>").alias("m"))
        # The outer kind: the other would have the JSON parsed again for a filter on its size.
        .select(F.explode_outer("m").alias("cve_id", "r"))
        .filter("cve_id IS NOT NULL")
        .select("cve_id", "r.score", "r.severity", "r.vector", "r.version")
    )


def load_cvss_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The CVSS dimension from a JSON file of one object (or several files); empty when there is none. An object is
    cut into its entries in parallel, however large, and written on one line or many. A file that is not
    one JSON object gives no rows."""
    try:
        entries = object_entries(spark, path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        entries = spark.createDataFrame([], "file STRING, body STRING")
    parsed = entries.select("file", F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), f"map<string, {RECORD}>").alias("m"))
    parsed = stage(parsed, "cvss-entries")
    broken = parsed.filter("m IS NULL").select("file").distinct()
    rows = lookup_join(parsed, broken, ["file"], "left_anti", spread_by=["file"]).select(F.explode_outer("m").alias("cve_id", "r")).filter("cve_id IS NOT NULL")
    return rows.select("cve_id", "r.score", "r.severity", "r.vector", "r.version")
