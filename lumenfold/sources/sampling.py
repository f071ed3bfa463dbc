"""Samples for training, spread over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_year(meta: DataFrame, samples: int, seed: int, least: int = 100) -> DataFrame:
    """``year``, ``file_id``: of each year as many as twice its share, ``least`` at least, in order of a hash."""
    rows = meta.where("taken_at is not null").select(F.substring("taken_at", 1, 4).alias("year"), "file_id")
    n_years = rows.agg(F.countDistinct("year")).first()[0] or 1
    each = max(least, 2 * samples // n_years)
    order = Window.partitionBy("year").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_id").cast("string"))), "file_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("year", "file_id")


def top_up(sample: DataFrame, meta: DataFrame, samples: int, seed: int) -> DataFrame:
    """``sample`` filled up with other files, undated ones too."""
    short = max(0, samples - sample.count())
    rest = meta.join(sample.select("file_id"), "file_id", "left_anti").select(F.substring("taken_at", 1, 4).alias("year"), "file_id")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_id").cast("string")))
    return sample.unionByName(rest.orderBy(order, "file_id").limit(short))
