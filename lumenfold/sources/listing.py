"""Directory listings: paths, sizes and times of media files, without their contents; and hashes of those whose contents have to be read.

Folders that all machines have mounted are walked by a data source of its own, a partition for each folder below a root, which goes into
no folder that is left out. Other stores are listed by Spark's files. Hidden folders count below a root only: a root may itself be hidden.
"""

from __future__ import annotations

import hashlib
import os
import re
import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenfold.functions import paths

# Folders of photo libraries whose files are no originals, and what the names of such libraries hold.
DERIVATIVES = (
    "Previews", "Thumbnails", "resources", "private", "external", "database", "scopes", "Data", "Faces", "Caches", "iPod Photo Cache",
    "Auto Import", "Trash", "Auto Save", "Library6.iPhoto", "ProjectDBVersion",
)
LIBRARIES = (".photoslibrary", "iphoto library", ".aplibrary")


#: Bytes of a file that are in memory at a time.
CHUNK = 1 << 20
_CROP = r"_face\d+\.(jpg|jpeg|png)$"


def kept(path: Column) -> Column:
    """A supported file that is no derivative of a library and no face crop."""
    crop = F.lower(paths.basename(path)).rlike(_CROP)
    libraries, folders = ("|".join(n.replace(".", r"\.") for n in names) for names in (LIBRARIES, DERIVATIVES))
    # A library's name in any case, and below it a folder's name as it is.
    derived = path.rlike(rf"(?i:{libraries}).*/({folders})/")
    return paths.extension(path).isin(list(paths.SUPPORTED)) & ~crop & ~derived


def local_path(root: str) -> str | None:
    """A folder's path on this machine; None if it is in another store."""
    found = urlparse(root)
    return os.path.abspath(os.path.expanduser(unquote(found.path) if found.scheme else root)) if found.scheme in ("", "file") else None


@dataclass
class Below(InputPartition):
    """A root's own files, or all that is below one of its folders."""

    folder: str
    deep: bool


class MediaFiles(DataSource):
    """``spark.read.format("media_files").option("roots", ...)``: roots are lines; files are taken once a root."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "path string, size long, mtime double"

    def reader(self, schema: object) -> DataSourceReader:
        return MediaReader([r for r in self.options.get("roots", "").split("\n") if r])


class MediaReader(DataSourceReader):
    def __init__(self, roots: Sequence[str]) -> None:
        self.roots = list(roots)

    def partitions(self) -> list[Below]:
        """Only the roots' own entries are listed here."""
        found = []
        for root in self.roots:
            found.append(Below(root, False))
            if os.path.isdir(root):
                with os.scandir(root) as entries:
                    found += [Below(e.path, True) for e in entries if e.is_dir(follow_symlinks=False) and goes_in(root, e.name)]
        return found

    def read(self, partition: Below) -> Iterator[tuple[str, int, float]]:
        top = partition.folder
        if os.path.isfile(top):
            yield from (row(top),) if taken(top) else ()
            return
        for folder, inner, names in os.walk(top):
            inner[:] = [n for n in inner if goes_in(folder, n)] if partition.deep else []
            for path in (os.path.join(folder, n) for n in names if not n.startswith(".") and taken(n)):
                try:
                    yield row(path)
                except OSError:
                    continue  # gone since it was listed


def goes_in(folder: str, name: str) -> bool:
    lower = folder.lower()
    return not name.startswith(".") and not (name in DERIVATIVES and any(n in lower for n in LIBRARIES))


def taken(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in paths.SUPPORTED and not re.search(_CROP, name.lower())


def row(path: str) -> tuple[str, int, float]:
    state = os.stat(path)
    return path, state.st_size, state.st_mtime


def walk(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path, size, mtime of media below the roots (a file may be a root), each path once. No content is read."""
    here = [p for p in map(local_path, roots) if p is not None]
    there = [r for r in roots if local_path(r) is None]
    spark.dataSource.register(MediaFiles)
    rows = spark.read.format("media_files").option("roots", "\n".join(here)).load()
    for root in there:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        below = F.substring("path", F.length(F.lit(root.rstrip("/"))) + 1, F.length("path"))
        listed = found.where(~below.rlike(r"/\.[^/]") & kept(F.col("path")))
        rows = rows.unionByName(listed.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")))
    return rows.dropDuplicates(["path"])


def content_hash(path: str) -> str | None:
    """SHA-256 of a file of any size; null for what can't be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                digest.update(part)
    except OSError:
        return None
    return digest.hexdigest()


def with_hashes(spark: SparkSession, listing: DataFrame, roots: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """``listing`` with content_hash. Of ``known`` (path, size, mtime, content_hash) files that are as they were keep their hash; no other content is read."""
    columns = listing.columns
    if known is not None:
        old = known.where("content_hash <> ''").groupBy(F.col("path").alias("k_path")).agg(F.max(F.struct("size", "mtime", "content_hash")).alias("k"))
        same = (F.col("size") == F.col("k.size")) & (F.abs(F.col("mtime") - F.col("k.mtime")) < 1e-3)
        listing = listing.join(old, F.col("path") == F.col("k_path"), "left").select(*columns, F.when(same, F.col("k.content_hash")).alias("content_hash"))
        done, todo = listing.where("content_hash is not null"), listing.where("content_hash is null").select(*columns)
    else:
        done, todo = None, listing

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h_path": pdf["path"], "content_hash": [content_hash(p) for p in pdf["path"]]})

    # Paths are dealt out first: a folder's files are read by many tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hashes = todo.where(F.col("path").startswith("/")).select("path").repartition(parts, "path").mapInPandas(read, "h_path string, content_hash string")
    there = [r for r in roots if local_path(r) is None]
    if there:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
        hashes = hashes.unionByName(found.select(F.col("path").alias("h_path"), F.sha2("content", 256).alias("content_hash")))
    hashed = todo.join(hashes, F.col("path") == F.col("h_path"), "left").drop("h_path")
    return hashed if done is None else done.unionByName(hashed)


def too_small(width: Column, height: Column, kind: Column, least: int = 320) -> Column:
    """Both sides below the least; videos and files of unknown size are not."""
    return F.coalesce((width < least) & (height < least) & (kind != "video"), F.lit(False))


def reachable(root: str, timeout: float = 8.0, probe=None) -> bool:
    """Whether a root answers in time. A probe that hangs counts as no, and is left behind: it ends with the process and keeps it from nothing."""
    answer: list[bool] = []

    def look() -> None:
        try:
            if probe is not None:
                answer.append(bool(probe()))
            else:
                with os.scandir(root) as entries:
                    next(entries, None)
                answer.append(True)
        except OSError:
            answer.append(os.path.isfile(root))

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    thread.join(timeout)
    return bool(answer and answer[0])
