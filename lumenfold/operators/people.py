"""Persons, their names over time, and the faces that clusters hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.operators.timeline import key, with_meta

FACES_PAGE = 48


def faces_of(files, meta, faces, clusters, person_id: int) -> DataFrame:
    """Faces of all of a person's clusters in visible files. Clusters are few beside faces; Spark may send them."""
    mine = clusters.where(F.col("person_id") == person_id).select("cluster_id")
    rows = with_meta(files, meta).where(P.visible())
    return faces.join(mine, "cluster_id").join(rows, F.col("file_id") == F.col("id"))


def stats(files, meta, faces, clusters, person_id: int) -> DataFrame:
    return faces_of(files, meta, faces, clusters, person_id).agg(
        F.countDistinct("file_id").alias("photos"), F.count(F.lit(1)).alias("faces"), F.countDistinct("cluster_id").alias("clusters"),
        F.min("taken_at").alias("first"), F.max("taken_at").alias("last"),
    )


def photos(files, meta, faces, clusters, person_id: int, limit: int = 60, offset: int = 0) -> DataFrame:
    mine = clusters.where(F.col("person_id") == person_id).select("cluster_id")
    ids = faces.join(mine, "cluster_id", "left_semi").select(F.col("file_id").alias("face_of"))
    rows = with_meta(files, meta).where(P.visible()).join(ids, F.col("id") == F.col("face_of"), "left_semi")
    rows = rows.orderBy(F.desc(key(F.col("taken_at"), F.col("mtime"), F.col("id"))))
    return (rows.offset(offset) if offset else rows).limit(limit).select("id", "path", "taken_at")


def best_face_by_year(files, meta, faces, clusters, person_id: int) -> DataFrame:
    """Of each year the face with the best score; of equal ones the lowest file."""
    rows = faces_of(files, meta, faces, clusters, person_id).where("taken_at is not null")
    best = F.max_by(F.struct("file_id", "det_score"), F.struct("det_score", -F.col("file_id"))).alias("b")
    return rows.groupBy(F.substring("taken_at", 1, 4).alias("year")).agg(best).select("year", "b.file_id", "b.det_score")


def counts(faces: DataFrame) -> DataFrame:
    """Names and how many faces have them, the commonest first."""
    return faces.where("person_name is not null").groupBy("person_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "person_name")


def known_names(persons: DataFrame, names: DataFrame) -> DataFrame:
    found = persons.select(F.col("primary_name").alias("name")).unionByName(names.select("name"))
    return found.distinct().orderBy(F.lower("name"), "name")


def epochs(names: DataFrame, person_id: int) -> DataFrame:
    rows = names.where(F.col("person_id") == person_id)
    return rows.orderBy(F.asc_nulls_last("start_date"), "id").select("id", "name", "start_date", "end_date")


def resolve_names(faces: DataFrame, meta: DataFrame, clusters: DataFrame, persons: DataFrame, names: DataFrame) -> DataFrame:
    """The name that a person had when the photo was taken: ``file_id``, ``cluster_id``, ``name``.

    Of the epochs that cover the day the one with more bounds wins, then the later start, then
    the later id. Without a day or an epoch it is the primary name. One row for each file and cluster.
    """
    shown = faces.select("file_id", "cluster_id").distinct().join(clusters.where("person_id is not null").select("cluster_id", "person_id"), "cluster_id")
    shown = shown.join(meta.select("file_id", F.substring("taken_at", 1, 10).alias("day")), "file_id", "left")
    epoch = names.select(F.col("person_id").alias("of"), F.col("id").alias("epoch_id"), "name", "start_date", "end_date")
    covers = (
        (F.col("person_id") == F.col("of"))
        & (F.col("day") != "")
        & (F.col("start_date").isNull() | (F.col("start_date") <= F.col("day")))
        & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("day")))
    )
    bounds = F.when(F.coalesce("start_date", F.lit("")) != "", 1).otherwise(0) + F.when(F.coalesce("end_date", F.lit("")) != "", 1).otherwise(0)
    rank = F.struct(bounds, F.coalesce("start_date", F.lit("")), "epoch_id")
    picked = shown.join(epoch, covers, "left").groupBy("file_id", "cluster_id", "person_id").agg(F.max_by("name", F.when(F.col("epoch_id").isNotNull(), rank)).alias("epoch_name"))
    primary = persons.select(F.col("id").alias("person_id"), "primary_name")
    return picked.join(primary, "person_id").select("file_id", "cluster_id", F.coalesce("epoch_name", "primary_name").alias("name"))


def faces_grid(faces: DataFrame, clusters: DataFrame, files: DataFrame, page: int = 0, size: int = FACES_PAGE) -> DataFrame:
    """Clusters that aren't hidden, by live faces, with the file of the best one. The best face comes out of the same grouping."""
    live = faces.join(files.where("missing = 0").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    best = F.max_by("file_id", F.struct("det_score", -F.col("file_id")))
    rows = live.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("face_count"), best.alias("best_file"))
    rows = rows.join(clusters.where("hidden = 0").select("cluster_id", "person_name"), "cluster_id").orderBy(F.desc("face_count"), "cluster_id")
    return (rows.offset(page * size) if page else rows).limit(size)


def label_queue(faces, clusters, files, meta, after: tuple[int, int] | None = None, limit: int = 20) -> DataFrame:
    """Clusters to name, most faces first, from a cursor (face_count, cluster_id) on, so that naming skips none."""
    open_ = clusters.where("person_name is null and hidden = 0").select("cluster_id")
    rows = faces.join(open_, "cluster_id").join(with_meta(files, meta).select(F.col("id").alias("file_id"), "taken_at"), "file_id")
    rows = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("face_count"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last"))
    if after:
        n, c = after
        rows = rows.where((F.col("face_count") < n) | ((F.col("face_count") == n) & (F.col("cluster_id") > c)))
    return rows.orderBy(F.desc("face_count"), "cluster_id").limit(limit)


def label_samples(faces: DataFrame, clusters: DataFrame, n: int = 6) -> DataFrame:
    """The n best faces of each cluster to name: a rank below a limit, which Spark applies before it shuffles."""
    open_ = clusters.where("person_name is null and hidden = 0").select("cluster_id")
    place = Window.partitionBy("cluster_id").orderBy(F.desc("det_score"), "file_id", "x", "w")
    rows = faces.join(open_, "cluster_id").withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    return rows.select("cluster_id", "place", "file_id", "det_score")


def unnamed_count(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    open_ = clusters.where("person_name is null and hidden = 0").join(faces.select("cluster_id"), "cluster_id", "left_semi")
    return open_.agg(F.count(F.lit(1)).alias("n"))


def majority_names(faces: DataFrame, at_least: int = 2) -> DataFrame:
    """Each cluster's commonest name, if it has two votes; of equal ones the first by letter."""
    votes = faces.where("person_name is not null").groupBy("cluster_id", "person_name").agg(F.count(F.lit(1)).alias("votes"))
    place = Window.partitionBy("cluster_id").orderBy(F.desc("votes"), "person_name")
    best = votes.where(F.col("votes") >= at_least).withColumn("place", F.row_number().over(place))
    return best.where("place = 1").select("cluster_id", "person_name", "votes")


def empty_clusters(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    return clusters.join(faces.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id")
