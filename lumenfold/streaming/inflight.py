"""Which files an indexing run has in hand, kept as state while its log is written.

Each file of a run is a key of its own, so no run's size matters. The state of a key is numbers alone: the last start
and done, and the starts that no done has answered (as many as there were crashes over this file). Rows say what
changed, with a number of their own for each file; the one with the highest is what is known, and rows that a restart writes
again carry the same number and do no harm.

- ``open``: started, ``tries`` times since it was last done;
- ``done``: a done came after the last start;
- ``given up``: started ``most`` times without a done; it stays so until a done comes;
- ``stalled``: the log's clock has passed a start by ``patience`` seconds and no done came (a timer of the key).

Lines and batches may come in any order: what counts is ``line_no``, and a line that comes again changes nothing but that a
stalled file counts as open anew. Lines of no file, or of other events than
start and done, take no part; lines without a time get no timer. The watermark is the log's clock alone: it is
``late`` behind, and lines that are older than it when they come are left out, so ``late`` has to be longer than log files
of one run lie apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources import checkpoint_log

#: A file that was started so often without a done is given up.
MOST_TRIES = 3
PATIENCE = 600
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
CHANGES = "run string, file_id long, line_no long, ts double, status string, tries int, seq long"


class InFlight(StatefulProcessor):
    def __init__(self, most: int = MOST_TRIES, patience: float = PATIENCE) -> None:
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "start long, ts double, done long, opened array<long>, status string, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Each call of the state or of timers is a message to the JVM and back: a key has two, and one more where a timer is new.
        start, ts, done, opened, status, seq = self.state.get() or (None, None, None, [], None, 0)
        before, timed = (start, done, len(opened), status), ts if status == "open" else None
        lines = set(opened)
        for row in rows:
            if row.event == "done":
                done = row.line_no if done is None else max(done, row.line_no)
            else:
                lines.add(row.line_no)
                if start is None or row.line_no > start:
                    start, ts = row.line_no, row.ts
        opened = sorted(line for line in lines if done is None or line > done)
        status = "done" if not opened else "given up" if len(opened) >= self.most else "open"
        changed = (start, done, len(opened), status) != before
        seq += changed
        self.state.update((start, ts, done, opened, status, seq))
        # Timers of earlier starts stay, and do nothing when they expire.
        if status == "open" and ts is not None and ts != timed:
            self.handle.registerTimer(max(self.due(ts), timerValues.getCurrentWatermarkInMs() + 1))
        if changed:
            yield self.told(key, start, ts, done, opened, status, seq)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        start, ts, done, opened, status, seq = self.state.get()
        if status == "open" and ts is not None and expiredTimerInfo.getExpiryTimeInMs() >= self.due(ts):
            self.state.update((start, ts, done, opened, "stalled", seq + 1))
            yield self.told(key, start, ts, done, opened, "stalled", seq + 1)

    def due(self, ts: float) -> int:
        return int((ts + self.patience) * 1000)

    @staticmethod
    def told(key: Any, start: int, ts: float, done: int, opened: list[int], status: str, seq: int) -> Row:
        return Row(run=key[0], file_id=key[1], line_no=done if status == "done" else start, ts=ts, status=status, tries=len(opened), seq=seq)

    def close(self) -> None:
        pass


def log_lines(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """A folder of run logs as a stream, a run for each file name: ``run``, ``line_no`` (by place in its file), ts, event, file_id, args.

    Files are read whole, as they are put; a log that grows is put in pieces ``RUN.NUMBER.log`` of less than 2^33 lines.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(\d+))?\.log$", 1)
    piece = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(\d+))?\.log$", 2).try_cast("bigint")
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder, wholetext=True)
    lines = raw.select(name.alias("run"), F.coalesce(piece, F.lit(0)).alias("piece"), F.posexplode(F.split("value", "\n")).alias("place", "value"))
    return checkpoint_log.parse(lines.withColumn("line_no", F.col("piece") * (1 << 33) + F.col("place")), "run")


def changes(lines: DataFrame, most: int = MOST_TRIES, patience: float = PATIENCE, late: str = "1 day") -> DataFrame:
    """What becomes of files, row by row, from a stream of lines: ``run``, ``line_no``, ``ts`` (seconds), ``event``, ``file_id``."""
    rows = lines.where("event in ('start', 'done') and file_id is not null and run is not null").select(
        "run", "file_id", "line_no", "ts", "event", F.timestamp_seconds("ts").alias("clock")
    )
    timed = rows.withWatermark("clock", late)
    return timed.groupBy("run", "file_id").transformWithState(InFlight(most, patience), CHANGES, "Append", "EventTime")


def follow(lines: DataFrame, to: str, checkpoint: str, **how) -> None:
    """All that the stream has, once. A restart, after a kill too, goes on where the last whole batch ended."""
    spark = lines.sparkSession
    before = {key: spark.conf.get(key, None) for key in ROCKS}
    try:
        for key, value in ROCKS.items():
            spark.conf.set(key, value)
        out = changes(lines, **how).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint)
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def known(changed: DataFrame) -> DataFrame:
    """The last of each file's changes, by the number that the state gives them."""
    best = F.max_by(F.struct("line_no", "ts", "status", "tries"), "seq")
    return changed.groupBy("run", "file_id").agg(best.alias("b")).select("run", "file_id", "b.*")


def in_hand(changed: DataFrame) -> DataFrame:
    """Files that are started and not done, with their tries."""
    return known(changed).where("status <> 'done'")


def last_in_flight(changed: DataFrame) -> DataFrame:
    """Each run's file in hand that was started last: where a crash struck."""
    return in_hand(changed).groupBy("run").agg(F.max_by(F.struct("file_id", "line_no", "tries"), "line_no").alias("b")).select("run", "b.*")


def tombstones(changed: DataFrame) -> DataFrame:
    """``id`` and an ``error`` of the files that a run gave up."""
    gone = known(changed).where("status = 'given up'").groupBy(F.col("file_id").alias("id"))
    return gone.agg(F.concat(F.lit("given up after "), F.max("tries").cast("string"), F.lit(" starts")).alias("error"))
