"""Analysis of reports as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import MIN_CHARS
from ..operators.rollup import write_sums
from ..plans.analyze import analyze_reports


def analyze_stream(
    reports: DataFrame,
    out: str,
    checkpoint: str,
    cvss: DataFrame | Callable[[SparkSession], DataFrame] | None = None,
    available_now: bool = True,
    min_chars: int | None = MIN_CHARS,
    sums: str | None = None,
    **options,
) -> StreamingQuery:
    """Analyse a stream of reports (report_id, filename, text) into a Parquet table with a folder for each
    micro-batch (column `batch`).

    Reports of fewer than `min_chars` characters are left out, as by `analyze_reports` with the same
    argument; None keeps all. Each micro-batch is analysed as a table, so a CVSS dimension of any size works. A frame
    keeps the files it was made over; a function of the session, such as one that calls
    `load_cvss_dimension`, is called for each micro-batch and so sees what was added. A batch that runs
    again after a failure overwrites its own folder: each report appears exactly once. With `sums`, the
    figures of the dashboard are kept up to date in that folder, see `operators.rollup`.
    """

    def analyse(batch: DataFrame, number: int) -> None:
        dimension = cvss(batch.sparkSession) if callable(cvss) else cvss
        analysed = analyze_reports(batch, dimension, min_chars=min_chars, **options)
        stamped = analysed.withColumn("created_at", F.date_trunc("second", F.current_timestamp()))
        stamped.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if sums is not None:
            write_sums(batch.sparkSession.read.schema(stamped.schema).parquet(f"{out}/batch={number}"), sums, number)

    writer = reports.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
