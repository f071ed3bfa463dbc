"""Arrow batches for operators in Python, small enough for very long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch. Texts of 100 KB still give batches of tens of MB.
ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Lower the session's rows a batch to ``rows``, where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
