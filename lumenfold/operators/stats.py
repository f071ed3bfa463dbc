"""Counts over the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.operators.timeline import with_meta


def library(files: DataFrame) -> DataFrame:
    """All counts in one pass."""
    live = F.col("missing") == 0
    return files.agg(
        F.count_if(live).alias("files"),
        F.count_if(live & (F.col("meta_done") == 1)).alias("with_meta"),
        F.count_if(live & (F.col("yolo_done") == 1)).alias("with_objects"),
        F.count_if(live & (F.col("faces_done") == 1)).alias("with_faces"),
        F.count_if(live & (F.col("clip_done") == 1)).alias("with_vectors"),
        F.count_if(~live).alias("missing"),
        F.count_if(F.col("decode_failed") == 1).alias("failed"),
    )


def date_range(meta: DataFrame) -> DataFrame:
    return meta.agg(F.min("taken_at").alias("first"), F.max("taken_at").alias("last"))


def top_cameras(meta: DataFrame, limit: int = 10) -> DataFrame:
    counts = meta.where("camera_model is not null").groupBy("camera_model").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "camera_model").limit(limit)


def totals(files: DataFrame) -> DataFrame:
    return files.where("missing = 0").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("dup_of").isNotNull()).alias("duplicates"),
    )


def badges(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Open tasks: rotations to look at, photos without a place."""
    rows = with_meta(files, meta)
    return rows.agg(F.count_if(P.pending_rotation()).alias("pending_rotations"), F.count_if(P.untagged()).alias("untagged"))


def failures(files: DataFrame, limit: int = 50) -> DataFrame:
    return files.where(P.failed()).orderBy("id").limit(limit).select("id", "path", "decode_error")


def failure_total(files: DataFrame) -> DataFrame:
    return files.where(P.failed()).agg(F.count(F.lit(1)).alias("n"))


def inferred_by_year(meta: DataFrame) -> DataFrame:
    return meta.where("date_inferred = 1 and taken_at is not null").groupBy(F.substring("taken_at", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def video_states(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Videos on disk by what the catalog knows of them."""
    known = files.select(F.col("path").alias("known_path"), "decode_failed", "meta_done")
    rows = listing.where(P.is_video_path()).join(known, F.col("path") == F.col("known_path"), "left")
    state = (
        F.when(F.col("known_path").isNull(), "unknown").when(F.col("decode_failed") == 1, "failed").when(F.col("meta_done") == 0, "pending").otherwise("indexed")
    )
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
