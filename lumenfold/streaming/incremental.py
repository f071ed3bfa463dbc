"""Work that goes on as files come: stages over what is open, a run of phases, and streams of the log."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.catalog import Catalog
from lumenfold.operators import duplicates, scanning
from lumenfold.operators.transitions import tombstone
from lumenfold.session import checkpointed
from lumenfold.sources.stages import Stage, apply

LOG_SCHEMA = "ts timestamp, event string, file_id long, args string"


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a stage has not done: an anti-join with its output, the batch form of a stream's progress."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def ingest(catalog: Catalog, listing: DataFrame, prune: bool = False, skipped_roots: tuple[str, ...] = ()) -> dict[str, int]:
    """A listing into the catalog in one commit; gives how many paths met which state."""
    found = checkpointed(scanning.classify(listing, catalog["files"]))
    lost = scanning.prune_set(catalog["files"], found, skipped_roots) if prune else None
    files = scanning.apply_scan(catalog["files"], found, lost)
    counts = {r.state: r.n for r in scanning.counters(found).collect()}
    if lost is not None:
        counts["pruned"] = lost.count()
    catalog.commit({"files": duplicates.mark_live(checkpointed(files))})
    return counts


def run_stage(catalog: Catalog, stage: Stage, limit: int | None = None) -> int:
    """One stage over its queue; gives how many files were open. A second run has nothing to do."""
    files = catalog["files"]
    n = files.where(stage.needs()).count()
    if n:
        part = files
        if limit is not None:
            first = files.where(stage.needs()).orderBy("id").limit(limit).select(F.col("id").alias("l_id"))
            part = files.join(first, F.col("id") == F.col("l_id"), "left_semi")
        flagged, table = apply(stage, part, catalog[stage.table].withColumnRenamed("id", stage.key) if stage.key == "id_" else catalog[stage.table])
        rest = files.join(part.select("id"), "id", "left_anti")
        table = table.withColumnRenamed("id_", "id") if stage.key == "id_" else table
        catalog.commit({"files": rest.unionByName(flagged), stage.table: table})
    return n


@dataclass
class Phase:
    """``reads``: tables and the columns of them that decide what the phase does; none: it looks outside, and is always run.

    ``after``: phases without which this one would do harm. ``how``: arguments, a change of which makes it run again.
    """

    name: str
    run: Callable[[], object]
    needed: bool = True
    reads: Mapping[str, tuple[str, ...]] | None = None
    after: tuple[str, ...] = ()
    how: str = ""


@dataclass
class Report:
    """Exit codes: 0 all well, 1 a phase that others don't need failed, 2 a needed one did."""

    done: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    code: int = 0
    unchanged: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)


def inputs_of(catalog: Catalog, phase: Phase) -> str:
    """What a phase reads, in short: rows and sums of hashes of the columns that it names, whatever the order of rows or files. A scan of these columns alone."""
    parts = [phase.how]
    for table, columns in sorted((phase.reads or {}).items()):
        row = catalog[table].agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("h")).first()
        parts.append(f"{table} {' '.join(columns)} {row.n} {row.h}")
    return "; ".join(parts)


def refresh(phases: list[Phase], catalog: Catalog | None = None) -> Report:
    """Phases in order. A needed one that fails ends the run; others are noted, and what comes after them is held.

    With a catalog, what each phase read is kept there once it is done, as it is after its own changes: a rerun, also
    one after a crash, passes over phases that would read the same. A crash between a phase's commit and its mark makes
    it run again, and it changes nothing then, as each phase looks for what is open. A phase whose inputs a later one changed
    is run once more by the next refresh.
    """
    report = Report()
    for phase in phases:
        if any(name in report.failed or name in report.held for name in phase.after):
            report.held.append(phase.name)
            continue
        kept = catalog is not None and phase.reads is not None
        try:
            if kept and catalog.get_meta(f"phase {phase.name}") == inputs_of(catalog, phase):
                report.unchanged.append(phase.name)
                continue
            phase.run()
            if kept:
                catalog.set_meta(f"phase {phase.name}", inputs_of(catalog, phase))
            report.done.append(phase.name)
        except (Exception, SystemExit) as failure:
            report.failed[phase.name] = str(failure)[:500]
            report.code = 2 if phase.needed else max(report.code, 1)
            if phase.needed:
                break
    return report


def babysit(catalog: Catalog, work: Callable[[], object], in_flight: Callable[[], int | None], max_retries: int = 30, max_tombstones: int = 100) -> Report:
    """Work until it ends well. After a crash the file that was in flight is marked, and work begins again.

    The same file twice in a row, too many tries without progress, or too many marked files end it.
    """
    report, tries, marked, before = Report(), 0, 0, None
    while True:
        try:
            work()
            report.done.append("work")
            return report
        except Exception as failure:
            bad = in_flight()
            report.failed[str(bad)] = str(failure)[:500]
            if bad is None or bad == before or tries >= max_retries or marked >= max_tombstones:
                report.code = 2
                return report
            catalog.commit({"files": tombstone(catalog["files"], bad, f"crashed: {failure}")})
            tries, marked, before = tries + 1, marked + 1, bad


class Locked(RuntimeError):
    """Another run holds the lock."""


class Lock:
    """One refresh at a time, by a file that only one can make; :class:`Locked` for others."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(conf)

    def __enter__(self) -> Lock:
        try:
            out = self.fs.create(self.path, False)  # fails if it is there
        except Exception as failure:
            if self.fs.exists(self.path):
                raise Locked(self.path.toString()) from failure
            raise
        out.write(bytearray(str(time.time()), "utf-8"))
        out.close()
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete(self.path, False)


def log_stream(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """Log records as JSON lines, as they come; so many files at a time, the back-pressure of this source."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def log_counts(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window; what is later than the watermark is left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def available_now(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, once, with progress kept: a restart goes on where this ended."""
    query = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    """Batches to a function, as for changes of a catalog: (rows, number). A batch may come again after a crash; its number tells."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """An extension: a user's events without a longer gap between them."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def status(log: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """The last thing known of each file."""
    rows = log if isinstance(log, DataFrame) else log["checkpoint_log"]
    return rows.groupBy("file_id").agg(F.max_by("event", "line_no").alias("event"), F.max("line_no").alias("line_no"))
