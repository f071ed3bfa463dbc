"""Comparing trees, and plans for copying a library in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import dates, paths
from lumenfold.operators.timeline import with_meta


def _side(files: DataFrame, meta: DataFrame, prefix: str, by: str, exclude: str | None) -> DataFrame:
    rows = with_meta(files, meta).where((F.col("missing") == 0) & P.path_like(prefix))
    rows = rows.where(~P.path_like(exclude)) if exclude else rows
    key = paths.comparison_key(by, F.col("taken_at"), F.col("path"), F.col("phash"))
    return rows.select("id", key.alias("key"))


def compare(files: DataFrame, meta: DataFrame, a: str, b: str, by: str = "name", exclude: str | None = None) -> DataFrame:
    """Keys of two trees: ``key``, the first file in each, and where it is: a, b or both."""
    one = _side(files, meta, a, by, exclude).where("key is not null").groupBy("key").agg(F.min("id").alias("a_id"))
    two = _side(files, meta, b, by, None).where("key is not null").groupBy("key").agg(F.min("id").alias("b_id"))
    where = F.when(F.col("a_id").isNull(), "b").when(F.col("b_id").isNull(), "a").otherwise("both")
    return one.join(two, "key", "full").select("key", "a_id", "b_id", where.alias("side"))


def verdict(files: DataFrame, meta: DataFrame, a: str, b: str, by: str = "name", exclude: str | None = None) -> DataFrame:
    """How two trees relate, in counts and in a word."""
    rows = compare(files, meta, a, b, by, exclude).agg(
        F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"), F.count_if(F.col("side") == "both").alias("both")
    )
    word = (
        F.when(F.col("only_a") + F.col("only_b") + F.col("both") == 0, "nothing keyed")
        .when((F.col("only_a") == 0) & (F.col("only_b") == 0), "identical")
        .when(F.col("only_a") == 0, "a within b")
        .when(F.col("only_b") == 0, "b within a")
        .otherwise("partial")
    )
    return rows.withColumn("verdict", word)


def _plan(rows: DataFrame, flat: bool, undated: str, target: str) -> DataFrame:
    folder = F.lit("") if flat else paths.date_folder(F.col("taken_at"), undated)
    rows = rows.select("id", "path", "content_hash", "size", folder.alias("folder")).withColumn("name_key", F.lower(paths.basename(F.col("path"))))
    # Two different hashes are enough to know: least and greatest need no set in memory.
    clash = rows.groupBy("folder", "name_key").agg((F.min("content_hash") != F.max("content_hash")).alias("clash"))
    rows = rows.join(clash, ["folder", "name_key"])
    name = paths.target_name(F.col("path"), F.col("content_hash"), F.col("clash"))
    full = F.concat_ws("/", F.lit(target), F.nullif(F.col("folder"), F.lit("")), name)
    return rows.select("id", "path", "size", "folder", "clash", full.alias("target"))


def collate_plan(files: DataFrame, meta: DataFrame, target: str, undated: str = "undated", recollate: bool = False) -> DataFrame:
    """Where every original goes: a folder for each day, and a hash in names that clash."""
    rows = with_meta(files, meta).where(P.collatable(None if recollate else target))
    return _plan(rows, False, undated, target)


def export_plan(
    files: DataFrame, meta: DataFrame, target: str, camera: str | None = None, before: str | None = None, after: str | None = None,
    person: str | None = None, faces: DataFrame | None = None, flat: bool = False, undated: str = "undated",
) -> DataFrame:
    rows = with_meta(files, meta).where(P.exportable(camera, before, after))
    if person and faces is not None:
        ids = faces.where(F.col("person_name") == person).select(F.col("file_id").alias("f"))
        rows = rows.join(ids, F.col("id") == F.col("f"), "left_semi")
    return _plan(rows, flat, undated, target)


def plan_summary(plan: DataFrame, undated: str = "undated") -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("folder") == undated).alias("undated"), F.count_if("clash").alias("renamed"),
    )


def collisions(plan: DataFrame) -> DataFrame:
    rows = plan.where("clash").groupBy("folder", F.lower(paths.basename(F.col("path"))).alias("name"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def repoint(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``files`` with the paths of a plan that was carried out."""
    new = plan.select(F.col("id").alias("p_id"), F.col("target").alias("p_target"))
    rows = files.join(new, F.col("id") == F.col("p_id"), "left")
    return rows.withColumn("path", F.coalesce("p_target", "path")).select(*files.columns)


def inferred_dates(rows: DataFrame) -> DataFrame:
    return rows.select("id", dates.infer_date(F.col("path")).alias("inferred"))


def backfill(files: DataFrame, meta: DataFrame, redo: bool = False, substring: str | None = None) -> DataFrame:
    """``file_id`` and ``taken_at`` to write: dates that paths tell of undated files."""
    rows = with_meta(files, meta).where(P.undated(redo, substring))
    return inferred_dates(rows).where("inferred is not null").select(F.col("id").alias("file_id"), F.col("inferred").alias("taken_at"))
