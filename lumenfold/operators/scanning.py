"""A new listing against the catalog: what is new, changed, moved, gone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import paths


def classify(listing: DataFrame, files: DataFrame, dedupe: bool = True) -> DataFrame:
    """Each listed path once, with its ``state`` and the row it concerns (``file_id``).

    ``listing``: path, size, mtime, content_hash and, if known, too_small. Of new paths with equal
    bytes the first by name is new, others are skipped; a lost row is claimed by the first.
    """
    if "too_small" not in listing.columns:
        listing = listing.withColumn("too_small", F.lit(0))
    seen = listing.groupBy("path").agg(F.min(F.struct("mtime", "size", "content_hash", "too_small")).alias("first_")).select("path", "first_.*")
    known = files.select(
        F.col("path").alias("k_path"), F.col("id").alias("file_id"), F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("too_small").alias("k_small")
    )
    rows = seen.join(known, F.col("path") == F.col("k_path"), "left")
    same = (F.col("k_size") == F.col("size")) & (F.col("k_mtime") == F.col("mtime"))
    state = (
        F.when(F.col("k_path").isNotNull() & same, F.when(F.col("k_small") == 1, "skipped_small").otherwise("unchanged"))
        .when(F.col("k_path").isNotNull(), F.when(F.col("too_small") == 1, "changed_small").otherwise("changed"))
        .when(F.col("too_small") == 1, "new_small")
    )
    rows = rows.withColumn("state", state).select("path", "size", "mtime", "content_hash", "too_small", "file_id", "state")
    if not dedupe:
        return rows.withColumn("state", F.coalesce("state", F.lit("new")))
    settled, fresh = rows.where("state is not null"), rows.where("state is null")
    by_hash = files.where("content_hash <> ''").groupBy("content_hash").agg(
        F.min(F.when(F.col("missing") == 0, F.col("id"))).alias("live_id"), F.min(F.when(F.col("missing") == 1, F.col("id"))).alias("lost_id")
    )
    first = fresh.groupBy("content_hash").agg(F.min("path").alias("first_path"))
    fresh = fresh.drop("file_id", "state").join(first, "content_hash", "left").join(by_hash, "content_hash", "left")
    is_first = F.col("path") == F.col("first_path")
    state = (
        F.when(F.col("live_id").isNotNull(), "dedup_skipped").when(~is_first, "dedup_skipped").when(F.col("lost_id").isNotNull(), "moved").otherwise("new")
    )
    fresh = fresh.withColumn("state", state).withColumn(
        "file_id", F.when(F.col("live_id").isNotNull(), F.col("live_id")).when(is_first, F.col("lost_id"))
    )
    return settled.unionByName(fresh.select(*settled.columns))


def counters(classified: DataFrame) -> DataFrame:
    return classified.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def prune_set(files: DataFrame, classified: DataFrame, skipped_roots: Sequence[str] = ()) -> DataFrame:
    """Live files that the listing lacks and that stand under no unreachable root: ``id``, ``path``."""
    seen = classified.select(F.col("path").alias("s_path"))
    marked = classified.where("state = 'dedup_skipped' and file_id is not null").select(F.col("file_id").alias("s_id"))
    live = files.where("missing = 0").join(seen, F.col("path") == F.col("s_path"), "left_anti").join(marked, F.col("id") == F.col("s_id"), "left_anti")
    return (live.where(~P.under_roots(skipped_roots)) if skipped_roots else live).select("id", "path")


def apply_scan(files: DataFrame, classified: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """The files table after a scan: a new snapshot, the old one is untouched."""
    from lumenfold.schema import conform
    from lumenfold.session import stored

    base = conform(files, "files")
    # Kept, as it is read three times and its joins would be made each time.
    classified = stored(classified.where("file_id is not null and state <> 'dedup_skipped' or state in ('new', 'new_small')"))
    # Only what the state puts into the row goes through the join; of unchanged files that is no path or hash.
    some = {s: F.col("state").isin(*s.split()) for s in ("moved", "changed", "changed changed_small moved")}
    by_id = classified.where("file_id is not null and state <> 'dedup_skipped'").select(
        F.col("file_id").alias("c_id"), F.col("state").alias("c_state"), F.when(some["moved"], F.col("path")).alias("c_path"),
        *[F.when(some["changed changed_small moved"], F.col(c)).alias(f"c_{c}") for c in ("size", "mtime")], F.when(some["changed"], F.col("content_hash")).alias("c_hash"),
    )
    rows = base.join(by_id, F.col("id") == F.col("c_id"), "left")
    changed, small, moved = (F.coalesce(F.col("c_state"), F.lit("")) == s for s in ("changed", "changed_small", "moved"))
    met = changed | moved | (F.coalesce(F.col("c_state"), F.lit("")) == "unchanged")

    def put(name: str, *cases: tuple[Column, object]) -> None:
        nonlocal rows
        value = F.col(name)
        for condition, new in cases:
            value = F.when(condition, new).otherwise(value)
        rows = rows.withColumn(name, value)

    put("size", (changed | small | moved, F.col("c_size")))
    put("mtime", (changed | small | moved, F.col("c_mtime")))
    put("path", (moved, F.col("c_path")))
    put("content_hash", (changed, F.col("c_hash")))
    put("too_small", (small, F.lit(1)), (changed, F.lit(0)))
    put("missing", (met, F.lit(0)))
    for flag in ("meta_done", "yolo_done", "faces_done", "clip_done"):
        put(flag, (changed, F.lit(0)))
    kept = rows.select(*base.columns)
    if lost is not None:
        gone = lost.select(F.col("id").alias("g_id"))
        kept = kept.join(gone, F.col("id") == F.col("g_id"), "left").withColumn("missing", F.when(F.col("g_id").isNotNull(), 1).otherwise(F.col("missing"))).select(*base.columns)
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    fresh = classified.where("state in ('new', 'new_small')")
    # Ids in order of path: ranks within each hash bucket after the sizes of those before, so no task has all rows.
    fresh = with_ranks(fresh, "path").withColumn("id", F.col("rank") + F.lit(top))
    fresh = fresh.withColumn("content_hash", F.when(F.col("state") == "new_small", "").otherwise(F.col("content_hash"))).withColumn("kind", paths.kind_of(F.col("path")))
    fresh = fresh.select("id", "path", "content_hash", "size", "mtime", "too_small", "kind", paths.mime_of(F.col("path")).alias("mime"))
    return kept.unionByName(conform(fresh, "files").select(*[c for c in kept.columns if c in conform(fresh, "files").columns]), allowMissingColumns=True)


def with_ranks(rows: DataFrame, by: str, buckets: int = 256) -> DataFrame:
    """``rows`` with ``rank`` from 1, unique and without gaps, by hash bucket and then by column."""
    from pyspark.sql import Window

    keyed = rows.withColumn("bucket_", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    sizes = sorted((r.bucket_, r.n) for r in keyed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for bucket, n in sizes:
        starts[bucket] = total
        total += n
    table = rows.sparkSession.createDataFrame(list(starts.items()), "bucket_ int, start_ long")
    place = F.row_number().over(Window.partitionBy("bucket_").orderBy(by))
    return keyed.withColumn("place_", place).join(F.broadcast(table), "bucket_").withColumn("rank", F.col("start_") + F.col("place_")).drop("bucket_", "place_", "start_")


def check_missing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Live rows whose file is not in a fresh listing."""
    return files.where("missing = 0").join(listing.select("path"), "path", "left_anti").select("id", "path")


def resolve_target(files: DataFrame, target: str) -> DataFrame:
    """The file that an id, a hash, a path or a part of a path means, in this order."""
    rules = []
    if target.isdigit():
        rules.append(F.when(F.col("id") == int(target), 1))
    if len(target) == 64:
        rules.append(F.when(F.col("content_hash") == target, 2))
    rules += [F.when(F.col("path") == target, 3), F.when(P.path_like(target), 4)]
    return files.withColumn("rule", F.coalesce(*rules)).where("rule is not null").orderBy("rule", "id").limit(1).select("id", "path", "rule")
