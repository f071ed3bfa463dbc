"""Exact deduplication by a stateful stream whose state lies on disk and never expires.

Two streams, each with its own checkpoint, so that either goes on where a lost executor or driver left it, and so that
files that come later are held against all that came before:

1. every row of the source becomes its id, the SHA-256 of its normalised text and its locator (file, and row in the file);
2. keyed state in RocksDB holds for each digest the least (id, locator) seen and the number of rows. A batch tells only
   the digests that it changed, and of these only those with two rows or more are written: the hits.

A digest alone decides nothing. The bytes of all rows of a hit are compared with those of the row that stays, which is found by
its locator: least and greatest text of a group, taken before the shuffle, are both equal to it if and only if all are. Rows of digests that stand for
several texts are grouped by their texts instead; so the result is exact for a digest of any length.

No unique text is shuffled. Groups of copies of any size are counted in part before the shuffle, and rows look up the HEAVY largest groups
in a table of bounded size; a group beyond these has less than a HEAVY-th of all rows.

Defined results: a null text counts as empty; a null id is greater than all others; rows of equal id and text are told apart by
their locators, one of them stays; very long texts are hashed whole; an empty table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.columns import quoted
from lumenfold.session import shared_dir

#: What one space replaces, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
#: Groups of copies that rows look up in a table sent to every task: about 8 MB.
HEAVY = 1 << 16
#: Smaller groups are never heavy.
HEAVY_FROM = 1000
#: Up to so many bytes of digests with hits are sent to every task to find the texts to compare.
BROADCAST_BYTES = 32 << 20
#: Input of one micro-batch, at most.
BATCH_BYTES = 256 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every partition of the state lays claim to some MB of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
KEEP = "struct<no_id: boolean, id: {id}, file: string, row: long>"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings while a stream starts; it takes a copy of them."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def rows_of(source: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id``, ``content``, ``file``, ``row`` of a Parquet source, streamed or not."""
    return source.select(
        F.col(quoted(id_column)).alias("id"),
        normalised(F.col(quoted(text))).alias("content"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sha", F.unhex(F.sha2("content", 256)))


def key_of(digest_bytes: int) -> Column:
    return F.substring(F.col("sha"), 1, digest_bytes)


def _schema(spark: SparkSession, path: str, id_column: str, text: str) -> T.StructType:
    """The two columns that are read; others could be named as what Spark adds."""
    found = spark.read.parquet(path).select(F.col(quoted(id_column)), F.col(quoted(text))).schema
    return T.StructType([T.StructField(f.name, f.dataType) for f in found])


def ingest(spark: SparkSession, path: str, state: str, id_column: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> None:
    """Take in the files below ``path`` that ``state`` has not seen. Run again, it goes on where it was."""
    schema = _schema(spark, path, id_column, text)
    kind = schema[0].dataType.simpleString()
    # A pattern that names the path alone: a stream takes a folder or a pattern, and a table may be one file.
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")
    located = with_digest(rows_of(source, id_column, text)).drop("content")
    with settings(spark, **STATE):
        first = (
            located.writeStream.format("parquet").option("path", f"{state}/located").option("checkpointLocation", f"{state}/located-log")
            .outputMode("append").trigger(availableNow=True).start()
        )
        first.awaitTermination()
        seen = spark.readStream.schema(f"id {kind}, file string, row long, sha binary").option("maxBytesPerTrigger", BATCH_BYTES).option("maxFileAge", "36500d").parquet(f"{state}/located")
        least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row"))
        groups = seen.groupBy(key_of(digest_bytes).alias("digest")).agg(F.count(F.lit(1)).alias("n"), least.alias("keep"))

        def hits(batch: DataFrame, number: int) -> None:
            # Named by the batch: written once, however often it is tried.
            batch.where("n > 1").write.mode("overwrite").parquet(f"{state}/hits/batch={number}")

        second = groups.writeStream.foreachBatch(hits).option("checkpointLocation", f"{state}/groups-log").outputMode("update").trigger(availableNow=True).start()
        second.awaitTermination()


def found_groups(spark: SparkSession, state: str, kind: str) -> DataFrame:
    """``digest``, ``n``, ``keep`` of the digests with two rows or more, as the last batch left them: counts only rise, and the least only falls."""
    spark.createDataFrame([], f"digest binary, n long, keep {KEEP.format(id=kind)}").write.mode("overwrite").parquet(f"{state}/hits/batch=-1")
    told = spark.read.schema(f"digest binary, n long, keep {KEEP.format(id=kind)}").parquet(f"{state}/hits")
    return told.groupBy("digest").agg(F.max("n").alias("n"), F.min("keep").alias("keep"))


def is_kept() -> Column:
    return (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))


def compared(contents: DataFrame, groups: DataFrame, digest_bytes: int = 32, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``digest`` and ``same``: whether all rows of a hit have the bytes of the row that stays.

    ``contents``: rows with ``content`` and ``sha``. Texts outside the hits meet the table of hits where they are, up to
    ``broadcast_bytes`` of it; beyond, the join deals them by digest. What is shuffled afterwards is one text of a digest and task.
    """
    n_bytes = groups.agg(F.sum(F.length("digest") + F.length("keep.file") + 64)).first()[0] or 0
    table = F.broadcast(groups) if n_bytes <= broadcast_bytes else groups
    rows = contents.withColumn("digest", key_of(digest_bytes)).join(table, "digest")
    kept = F.max(F.when(is_kept(), F.col("content")))
    by = rows.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"), kept.alias("kept"), F.count(F.lit(1)).alias("there"), F.max("n").alias("n"))
    same = F.coalesce((F.col("low") == F.col("kept")) & (F.col("high") == F.col("kept")), F.lit(False))
    return by.select("digest", same.alias("same"), (F.col("there") == F.col("n")).alias("complete"))


def decisions(
    spark: SparkSession, path: str, state: str, id_column: str = "doc_id", text: str = "text", digest_bytes: int = 32,
    heavy: int = HEAVY, heavy_from: int = HEAVY_FROM, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A row for each row taken in: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and its locator ``file``, ``row``."""
    schema = _schema(spark, path, id_column, text)
    kind = schema[0].dataType.simpleString()
    located = spark.read.schema(f"id {kind}, file string, row long, sha binary").parquet(f"{state}/located")
    # Small beside the input: a row for each text that has copies.
    found_groups(spark, state, kind).write.mode("overwrite").parquet(f"{state}/groups")
    groups = spark.read.schema(f"digest binary, n long, keep {KEEP.format(id=kind)}").parquet(f"{state}/groups")
    contents = with_digest(rows_of(spark.read.schema(schema).parquet(path), id_column, text))
    compared(contents, groups, digest_bytes, broadcast_bytes).write.mode("overwrite").parquet(f"{state}/compared")
    checked = spark.read.schema("digest binary, same boolean, complete boolean").parquet(f"{state}/compared")
    clashes = checked.where("not same or not complete").count()
    rows = located.withColumn("digest", key_of(digest_bytes))
    extra = None
    if clashes:
        # Digests that stand for several texts: these rows are grouped by their bytes.
        odd = checked.where("not same or not complete").select("digest")
        groups, rows = groups.join(odd, "digest", "left_anti"), rows.join(odd, "digest", "left_anti")
        texts = contents.withColumn("digest", key_of(digest_bytes)).join(odd, "digest", "left_semi")
        least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row"))
        by_text = texts.groupBy("content").agg(F.count(F.lit(1)).alias("n"), least.alias("keep"))
        extra = texts.join(by_text, "content").select("id", "sha", "file", "row", "n", "keep")
    largest = groups.where(F.col("n") >= heavy_from).orderBy(F.desc("n"), "digest").limit(heavy)
    looked_up = rows.join(F.broadcast(largest), "digest", "left")
    plain = looked_up.where("n is null").select("id", "sha", "file", "row", "digest").join(groups, "digest", "left")
    columns = ["id", "sha", "file", "row", "n", "keep"]
    found = looked_up.where("n is not null").select(*columns).unionByName(plain.select(*columns))
    found = found.unionByName(extra) if extra is not None else found
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | is_kept()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "file",
        "row",
    )


def deduplicate(spark: SparkSession, path: str, state: str | None = None, id_column: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """Take in what is new below ``path`` and decide on all of it.

    ``state``: a folder that all executors share. A named one is kept and known again; else one is made below the shared folder.
    """
    state = (state or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}").rstrip("/")
    ingest(spark, path, state, id_column, text, digest_bytes)
    return decisions(spark, path, state, id_column, text, digest_bytes)


def survivors(spark: SparkSession, path: str, decided: DataFrame) -> DataFrame:
    """The rows of the Parquet table ``path`` that stay, with all their columns."""
    out = decided.where("not kept").select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row"))
    docs = spark.read.parquet(path)
    same = (F.col("_metadata.file_path") == F.col("gone_file")) & (F.col("_metadata.row_index") == F.col("gone_row"))
    return docs.join(out, same, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
