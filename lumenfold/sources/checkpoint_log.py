"""The log of an indexing run: lines of time, event, file and arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` grows with the place in a file; lines that are no records are left out."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse(lines)


def parse(lines: DataFrame, *keep: str) -> DataFrame:
    """``value`` and ``line_no`` to ts, event, file_id (null unless a number) and args, and columns to keep. Lines are words, or the JSON that :func:`append` writes."""
    parts = F.split(F.trim("value"), r"\s+", 4)
    record = F.from_json(F.when(F.trim("value").startswith("{"), F.col("value")), "ts double, event string, file_id string, args string")
    is_json = F.trim("value").startswith("{")
    return lines.select(
        *keep, "line_no", F.when(is_json, record["ts"]).otherwise(F.try_element_at(parts, F.lit(1)).try_cast("double")).alias("ts"),
        F.when(is_json, record["event"]).otherwise(F.try_element_at(parts, F.lit(2))).alias("event"),
        F.when(is_json, record["file_id"]).otherwise(F.try_element_at(parts, F.lit(3))).try_cast("bigint").alias("file_id"),
        F.when(is_json, record["args"]).otherwise(F.try_element_at(parts, F.lit(4))).alias("args"),
    ).where("ts is not null")


def last_in_flight(log: DataFrame) -> DataFrame:
    """The file of the last start that no later done answers: one row, or none."""
    rows = log.where("event in ('start', 'done') and file_id is not null")
    last = rows.groupBy("file_id").agg(
        F.max(F.when(F.col("event") == "start", F.col("line_no"))).alias("line_no"), F.max(F.when(F.col("event") == "done", F.col("line_no"))).alias("done")
    )
    open_ = last.where("line_no is not null and (done is null or done < line_no)")
    return open_.orderBy(F.desc("line_no")).limit(1).select("file_id", "line_no")


def levels(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def tail(log: DataFrame, n: int = 200) -> DataFrame:
    """The last lines, told apart by what they are."""
    kind = (
        F.when(F.col("event") == "error", "error").when(F.col("event").isin("mem", "throttle"), "memory").when(F.col("event") == "stage", "stage").otherwise("other")
    )
    return log.orderBy(F.desc("line_no")).limit(n).withColumn("kind", kind)


def append(records: DataFrame, folder: str) -> None:
    """Records (ts, event, file_id, args) as JSON lines behind what is there; :func:`read` and a stream read them."""
    records.select("ts", "event", "file_id", "args").write.mode("append").json(folder)
