"""Cities and landmarks as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDMARK_SCHEMA = "name string, lat double, lon double, kind string, sitelinks long"
LEAST_SITELINKS = 5


def landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated landmarks, plain or compressed; rows that don't fit the schema are skipped."""
    rows = spark.read.csv(path, sep="\t", schema=LANDMARK_SCHEMA, mode="DROPMALFORMED", quote="")
    return rows.where("name is not null and lat is not null and lon is not null")


def cities(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="name string, country string, region string, lat double, lon double, population long", mode="DROPMALFORMED", quote="")
    return rows.where("name is not null and lat is not null and lon is not null")


def from_points(found: DataFrame) -> DataFrame:
    """Landmarks of a query's results: qid, name, kind, point 'Point(lon lat)', sitelinks. Of one qid the row with most links stays, then the first kind."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)"
    point = rf"Point\({number} {number}\)"
    rows = found.withColumn("lon", F.nullif(F.regexp_extract("point", point, 1), F.lit("")).try_cast("double"))
    rows = rows.withColumn("lat", F.nullif(F.regexp_extract("point", point, 2), F.lit("")).try_cast("double"))
    rows = rows.where((F.col("sitelinks") >= LEAST_SITELINKS) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    best = F.max_by(F.struct("name", "lat", "lon", "kind", "sitelinks"), F.struct("sitelinks", -F.col("kind_no"))).alias("b")
    return rows.groupBy("qid").agg(best).select("b.*")


def write(rows: DataFrame, path: str) -> None:
    rows.select("name", "lat", "lon", "kind", "sitelinks").write.mode("overwrite").csv(path, sep="\t", compression="gzip", quote="")
