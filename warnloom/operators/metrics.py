"""Row counts observed while a query runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> DataFrame:
    """Count the rows that pass, as a metric of the query.

    Observed rows must be seen as they are, so the optimizer moves no filter and merges no projection
    across this point.
    """
    return df.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("reports"))
