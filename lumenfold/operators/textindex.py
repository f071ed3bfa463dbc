"""The full-text index as tables that stay: postings by the beginning of their terms, changed by files, read only where a query's terms are.

    <folder>/gen=<g>/postings/segment=<k>/bucket=<b>   term, file_id, n_terms, tf, positions; sorted by term
    <folder>/gen=<g>/lengths/segment=<k>               file_id, n_terms, h (a hash of the text)
    <folder>/gen=<g>/gone/segment=<k>                  file_id: what earlier segments have of these files counts no more
    <folder>/gen=<g>/stats/segment=<k>                 by how much documents and terms changed; written last, so it makes the segment count

A change is a segment; one that broke off has no stats, is read by nobody and is written over by the next. Merging writes what counts as the first segment of the
next generation. The bucket is a hash of a term's first two characters, so words, phrases and beginnings of two characters or more read a few buckets, and
within these the files' ranges of terms say what can be skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import text
from lumenfold.session import batches_of, discard, stored

BUCKETS = 64
BEGINNING = 2
#: Texts whose postings are made at a time.
TEXTS_A_BATCH = 256
POSTINGS = "term string, file_id long, n_terms long, tf long, positions array<int>"
LENGTHS = "file_id long, n_terms long, h long"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, BEGINNING)), F.lit(BUCKETS)).cast("int")


def holding(node: text.Node) -> Column:
    """Buckets that can hold the terms of a query's part."""
    if node.kind == "prefix" and len(node.value) < BEGINNING:
        return F.lit(True)
    if node.kind in ("word", "prefix"):
        return F.col("bucket") == bucket(F.lit(node.value))
    if node.kind == "phrase":
        return reduce(lambda a, b: a | b, [F.col("bucket") == bucket(F.lit(w)) for w in node.parts], F.lit(False))
    return reduce(lambda a, b: a | b, [holding(p) for p in node.parts])


class StoredIndex:
    """An index in ``folder``, which all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _numbers(self, path: str, name: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._names(path) if n.startswith(f"{name}="))

    def segments(self) -> tuple[int, list[int]]:
        """The generation that counts (0 if there is none) and its segments."""
        for g in reversed(self._numbers(self.folder, "gen")):
            stats = f"{self.folder}/gen={g}/stats"
            whole = [k for k in self._numbers(stats, "segment") if "_SUCCESS" in self._names(f"{stats}/segment={k}")]
            if whole:
                return g, whole
        return 0, []

    def _read(self, table: str, schema: str, g: int, segments: list[int]) -> DataFrame:
        base = f"{self.folder}/gen={g}/{table}"
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment int" + (", bucket int" if table == "postings" else ""))
        kept = f"{schema}, segment int" + (", bucket int" if table == "postings" else "")
        return self.spark.read.schema(kept).option("basePath", base).parquet(*[f"{base}/segment={k}" for k in segments])

    def _live(self, rows: DataFrame, g: int, segments: list[int]) -> DataFrame:
        """Rows that no later segment replaces."""
        if len(segments) < 2:
            return rows
        last = self._read("gone", "file_id long", g, segments[1:]).groupBy(F.col("file_id").alias("gone_id")).agg(F.max("segment").alias("gone_at"))
        joined = rows.join(last, F.col("file_id") == F.col("gone_id"), "left")
        return joined.where("gone_at is null or segment >= gone_at").drop("gone_id", "gone_at")

    def lengths(self) -> DataFrame:
        g, segments = self.segments()
        return self._live(self._read("lengths", LENGTHS, g, segments), g, segments).drop("segment")

    def totals(self) -> tuple[int, int]:
        """Documents with a term, and terms; from a row a segment."""
        g, segments = self.segments()
        row = self._read("stats", "docs long, terms long", g, segments).agg(F.sum("docs"), F.sum("terms")).first()
        return row[0] or 0, row[1] or 0

    def index(self) -> text.Index:
        """For :func:`text.search`. Nothing is read before a query says which buckets."""
        g, segments = self.segments()
        docs, terms = self.totals()
        postings = self._read("postings", POSTINGS, g, segments)
        live = self._live(postings, g, segments)
        return text.Index(live, self.lengths().where("n_terms > 0").select("file_id", "n_terms"), (docs, terms / docs if docs else None), holding)

    def _write(self, g: int, k: int, postings: DataFrame, lengths: DataFrame, gone: DataFrame, docs: int, terms: int) -> None:
        at = f"{self.folder}/gen={g}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A bucket may hold a large part of all postings, and a term too: their files are dealt to several parts, without a look at the postings beforehand.
        deal = F.pmod(F.xxhash64("file_id"), F.lit(max(1, 4 * parts // BUCKETS)))
        dealt = postings.withColumn("bucket", bucket(F.col("term"))).repartition(parts, "bucket", deal).sortWithinPartitions("bucket", "term", "file_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings/segment={k}")
        lengths.write.mode("overwrite").parquet(f"{at}/lengths/segment={k}")
        gone.write.mode("overwrite").parquet(f"{at}/gone/segment={k}")
        self.spark.createDataFrame([(docs, terms)], "docs long, terms long").coalesce(1).write.mode("overwrite").parquet(f"{at}/stats/segment={k}")

    def change(self, texts: DataFrame, gone: DataFrame | None = None) -> None:
        """``texts`` (file_id, text) replace what there is of their files; files of ``gone`` (file_id) have no text any more."""
        g, segments = self.segments()
        k = (segments[-1] if segments else -1) + 1
        made = text.build(texts)
        file_id = F.col("file_id").cast("long").alias("file_id")
        hashed = stored(texts.select(file_id, F.size(text.terms(F.col("text"))).cast("long").alias("n_terms"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
        touched = hashed.select("file_id")
        touched = (touched if gone is None else touched.unionByName(gone.select(F.col("file_id").cast("long").alias("file_id")))).distinct()
        count = (F.count(F.when(F.col("n_terms") > 0, 1)), F.coalesce(F.sum("n_terms"), F.lit(0)))
        old = self.lengths().join(touched, "file_id", "left_semi").agg(*count).first() if segments else (0, 0)
        new = hashed.agg(*count).first()
        with batches_of(self.spark, TEXTS_A_BATCH):
            self._write(g, k, made.postings, hashed, touched, new[0] - old[0], new[1] - old[1])
        discard(hashed)

    def sync(self, texts: DataFrame) -> int:
        """Take in what differs from ``texts`` (file_id, text; a row a file): how many files changed."""
        if not self.segments()[1]:
            self.change(texts)  # all of them, so nothing is compared
            return self.lengths().count()
        now = texts.select(F.col("file_id").alias("f"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("now"))
        both = self.lengths().select("file_id", "h").join(now, F.col("file_id") == F.col("f"), "full")
        differ = both.where("h is null or now is null or h <> now").select(F.coalesce("f", "file_id").alias("d"), F.col("now").isNull().alias("gone"))
        n = differ.count()
        if n:
            changed = texts.join(differ.where("not gone"), F.col("file_id") == F.col("d"), "left_semi")
            self.change(stored(changed), differ.where("gone").select(F.col("d").alias("file_id")))
        return n

    def merge(self) -> None:
        """All that counts in one segment of a new generation."""
        g, segments = self.segments()
        docs, terms = self.totals()
        postings = self._live(self._read("postings", POSTINGS, g, segments), g, segments).drop("segment", "bucket")
        none = self.spark.createDataFrame([], "file_id long")
        self._write(g + 1, 0, postings, self.lengths(), none, docs, terms)

    def vacuum(self) -> int:
        """Delete the generations before the one that counts; how many."""
        g, _ = self.segments()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        old = [n for n in self._numbers(self.folder, "gen") if n < g]
        for n in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/gen={n}")
            at.getFileSystem(conf).delete(at, True)
        return len(old)


def of_table(spark: SparkSession, source: DataFrame, texts: DataFrame, parent: str) -> StoredIndex:
    """The index of ``texts``, which are those of the Parquet table ``source``: made once for the table's files, as they are named, sized and dated, below ``parent``."""
    files = source.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("at")).distinct()
    n, mark = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)"))).first()
    stored = StoredIndex(spark, f"{parent}/text-index-{n}-{mark or 0}")
    if not stored.segments()[1]:
        stored.sync(texts)
    return stored
