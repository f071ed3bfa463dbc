"""The timeline: dated photos from the newest on, then undated ones by file time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P

PAGE = 60
COLUMNS = ("id", "path", "content_hash", "kind", "live_video_id", "rotation", "duration_sec", "taken_at", "mtime")


def order() -> list[Column]:
    """Newest first; all dated rows stand before undated ones, as text sorts after numbers in the store that this mirrors."""
    return [F.desc(F.col("taken_at").isNotNull()), F.desc_nulls_last("taken_at"), F.desc(F.when(F.col("taken_at").isNull(), F.col("mtime"))), F.desc("id")]


def key(taken: Column, mtime: Column, row_id: Column) -> Column:
    """One value that sorts as :func:`order` does, ascending."""
    return F.struct(
        taken.isNotNull().alias("dated"), F.coalesce(taken, F.lit("")).alias("taken"), F.when(taken.isNull(), mtime).otherwise(0.0).alias("m"), row_id.alias("id")
    )


def with_meta(files: DataFrame, meta: DataFrame, how: str = "left") -> DataFrame:
    return files.join(meta, files["id"] == meta["file_id"], how).drop("file_id")


def matching(files: DataFrame, meta: DataFrame, year: str | int | None = None, months: Sequence[str] = (), roots: Sequence[str] = ()) -> DataFrame:
    found = P.visible() & P.in_year(year) & P.in_months(months) & P.under_roots(roots)
    # A filter on the date makes the join an inner one; else undated files stay.
    return with_meta(files, meta, "inner" if year or months else "left").where(found)


def page(files: DataFrame, meta: DataFrame, number: int = 0, size: int = PAGE, **filters) -> DataFrame:
    rows = matching(files, meta, **filters).orderBy(*order())
    return (rows.offset(number * size) if number else rows).limit(size).select(*COLUMNS)


def page_until(files: DataFrame, meta: DataFrame, number: int = 0, size: int = PAGE, **filters) -> DataFrame:
    """All pages up to and with ``number``."""
    return matching(files, meta, **filters).orderBy(*order()).limit((number + 1) * size).select(*COLUMNS)


def has_next(files: DataFrame, meta: DataFrame, number: int, size: int = PAGE, **filters) -> DataFrame:
    n = matching(files, meta, **filters).agg(F.count(F.lit(1)).alias("total"))
    return n.select("total", (F.lit((number + 1) * size) < F.col("total")).alias("has_next"))


def years(meta: DataFrame) -> DataFrame:
    return meta.where("taken_at is not null").select(F.substring("taken_at", 1, 4).alias("year")).distinct()


def months(meta: DataFrame, year: str | int | None = None) -> DataFrame:
    return meta.where(F.col("taken_at").isNotNull() & P.in_year(year)).select(F.substring("taken_at", 6, 2).alias("month")).distinct()


def after_cursor(files: DataFrame, meta: DataFrame, date: str, row_id: int, limit: int = PAGE) -> DataFrame:
    """The next rows after (date, id), newest first; undated rows have the date ''."""
    day = F.coalesce("taken_at", F.lit(""))
    rows = with_meta(files, meta).where(P.untagged()).where((day < date) | ((day == date) & (F.col("id") < row_id)))
    return rows.orderBy(F.desc(day), F.desc("id")).limit(limit).select("id", "path", "taken_at")


def neighbours(files: DataFrame, meta: DataFrame, row_id: int) -> DataFrame:
    """The rows before and after one in timeline order: ``side`` and ``id``. Each side is a top-1, no window over all rows."""
    rows = with_meta(files, meta).where(P.visible()).select("id", key(F.col("taken_at"), F.col("mtime"), F.col("id")).alias("k"))
    one = with_meta(files, meta).where(F.col("id") == row_id).select(key(F.col("taken_at"), F.col("mtime"), F.col("id")).alias("here"))
    both = rows.join(F.broadcast(one))  # one row
    newer = both.where("k > here").orderBy(F.asc("k")).limit(1).select(F.lit("prev").alias("side"), "id")
    older = both.where("k < here").orderBy(F.desc("k")).limit(1).select(F.lit("next").alias("side"), "id")
    return newer.unionByName(older)


def page_of_photo(files: DataFrame, meta: DataFrame, row_ids: Sequence[int], size: int = PAGE) -> DataFrame:
    """On which page of its month each photo is: newer photos of the month over the page's size."""
    rows = with_meta(files, meta).where(P.visible() & F.col("taken_at").isNotNull())
    month = F.substring("taken_at", 1, 7)
    some = rows.where(F.col("id").isin(list(row_ids))).select(F.col("id").alias("photo"), month.alias("month"), F.col("taken_at").alias("at"))
    newer = rows.select(month.alias("month"), "taken_at").join(F.broadcast(some), "month")
    count = F.count_if(F.col("taken_at") > F.col("at"))
    return newer.groupBy("photo", "month").agg(count.alias("newer"), F.floor(count / size).cast("int").alias("page"))
