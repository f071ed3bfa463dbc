"""Cameras and their lenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.operators.timeline import with_meta


def summary(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Visible photos by make and model, with first and last day, and their share of the largest count."""
    rows = with_meta(files, meta, "inner").where(P.visible() & F.col("camera_model").isNotNull())
    rows = rows.groupBy("camera_make", "camera_model").agg(F.count(F.lit(1)).alias("n"), F.min("taken_at").alias("first_seen"), F.max("taken_at").alias("last_seen"))
    # One row a camera: a window over all of them is small beside the photos.
    return rows.withColumn("bar", F.round(F.col("n") * 100.0 / F.max("n").over(Window.partitionBy()), 0).cast("int"))


def photos(files: DataFrame, meta: DataFrame, model: str, lens: str | None = None, page: int = 0, size: int = 60) -> DataFrame:
    rows = with_meta(files, meta, "inner").where(P.camera_lens(model, lens)).orderBy(F.desc_nulls_last("taken_at"), F.desc("id"))
    return (rows.offset(page * size) if page else rows).limit(size).select("id", "path", "taken_at", "lens")


def parsed(meta: DataFrame) -> DataFrame:
    """``orient`` and ``focal`` (mm) of each row's lens."""
    lens, model = F.lower("lens"), F.lower("camera_model")
    rest = F.when(lens.startswith(model), F.trim(F.substring(lens, F.length(model) + 1, F.length(lens)))).otherwise(lens)
    none = F.col("lens").isNull() | F.col("lens").isin("", "65535")
    orient = F.when(none, "unknown").when(rest.contains("front") | rest.contains("selfie"), "front").otherwise("back")
    focal = F.when(~none, F.nullif(F.regexp_extract(rest, r"(\d+(?:\.\d+)?)\s*mm", 1), F.lit("")).try_cast("double"))
    return meta.withColumn("orient", orient).withColumn("focal", focal)


#: What back lenses are called, by how many there are, from the shortest on.
POSITIONS = {1: ["Main"], 2: ["Wide", "Tele"], 3: ["Ultra wide", "Main", "Telephoto"], 4: ["Ultra wide", "Main", "Tele", "Telephoto"]}


def lens_groups(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Of every camera the lenses by side and focal length, with what to call them. A camera with one group has none."""
    rows = parsed(with_meta(files, meta, "inner").where(P.visible() & F.col("camera_model").isNotNull()))
    short = F.when(F.col("focal") > 0, F.round("focal", 1))
    groups = rows.groupBy("camera_model", "orient", short.alias("focal")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("lens")), "\t").alias("value")
    )
    camera = Window.partitionBy("camera_model")
    ranked = (F.col("orient") == "back") & F.col("focal").isNotNull()
    groups = groups.withColumn("n_groups", F.count(F.lit(1)).over(camera)).withColumn("n_back", F.count_if(ranked).over(camera))
    place = F.row_number().over(Window.partitionBy("camera_model", ranked).orderBy("focal"))
    groups = groups.withColumn("place", place).where("n_groups > 1")
    name = F.when(F.col("place") == 1, "Ultra wide").when(F.col("place") == F.col("n_back"), "Telephoto")
    for n, labels in POSITIONS.items():
        for i, label in enumerate(labels, 1):
            name = F.when((F.col("n_back") == n) & (F.col("place") == i), label).otherwise(name)
    mm = F.concat(F.regexp_replace(F.col("focal").cast("string"), r"\.0$", ""), F.lit("mm"))
    label = (
        F.when(F.col("orient") == "unknown", "(no lens info)")
        .when(F.col("orient") == "front", F.concat_ws(" · ", F.lit("Front"), mm))
        .when(ranked, F.concat_ws(" · ", F.coalesce(name, F.lit("Back")), mm))
        .otherwise("Back")
    )
    return groups.select("camera_model", "orient", "focal", "n", "value", label.alias("label"))
