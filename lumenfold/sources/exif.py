"""Metadata rows from an EXIF reader's JSON, one object a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reader's field names, the first that is there wins.
DATES = ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:ModifyDate", "QuickTime:CreateDate", "QuickTime:MediaCreateDate")
NO_DATE = "0000:00:00 00:00:00"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reader output as a map of texts for each file: arrays of objects, or an object a line."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("tags"))
    return lines.select(F.try_element_at("tags", F.lit("SourceFile")).alias("path"), "tags")


def _tag(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(F.col("tags"), F.lit(n)), F.lit("")) for n in names])


def taken_at() -> Column:
    """The first date that is one; its first two colons become dashes."""
    first = F.coalesce(*[F.nullif(F.nullif(F.try_element_at(F.col("tags"), F.lit(n)), F.lit(NO_DATE)), F.lit("")) for n in DATES])
    return F.regexp_replace(first, r"^([^:]*):([^:]*):", "$1-$2-")


def _signed(value: Column, ref: Column, negative: str) -> Column:
    return F.when(F.upper(ref).startswith(negative), -F.abs(value)).otherwise(value)


def rows(tags: DataFrame) -> DataFrame:
    """``tags`` (path and a map) as columns of photo metadata. Rows keep their path: results are joined by it, never by place."""
    lat = _signed(_tag("Composite:GPSLatitude", "EXIF:GPSLatitude").try_cast("double"), _tag("EXIF:GPSLatitudeRef"), "S")
    lon = _signed(_tag("Composite:GPSLongitude", "EXIF:GPSLongitude").try_cast("double"), _tag("EXIF:GPSLongitudeRef"), "W")
    return tags.select(
        "path", taken_at().alias("taken_at"), _tag("EXIF:Make", "QuickTime:Make").alias("camera_make"), _tag("EXIF:Model", "QuickTime:Model").alias("camera_model"),
        _tag("EXIF:LensModel", "Composite:LensID").alias("lens"), _tag("EXIF:ISO").try_cast("double").cast("int").alias("iso"),
        _tag("EXIF:FNumber").try_cast("double").alias("aperture"), _tag("EXIF:ExposureTime").alias("shutter"), _tag("EXIF:FocalLength").try_cast("double").alias("focal_mm"),
        lat.alias("lat"), lon.alias("lon"), _tag("Composite:GPSAltitude", "EXIF:GPSAltitude").try_cast("double").alias("alt"),
    )
