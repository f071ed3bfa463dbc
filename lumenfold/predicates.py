"""Named predicates over catalog columns. Each gives a Column; patterns compare without ASCII case."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of videos and of derivative files.
VIDEO_EXTENSIONS = (".mov", ".mp4", ".m4v", ".avi", ".mkv")
LIVE_VIDEO_EXTENSIONS = (".mov", ".mp4", ".m4v")


def col(name: str, of: str | None = None) -> Column:
    return F.col(f"{of}.{name}" if of else name)


def any_of(conditions: Sequence[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)


def visible(of: str | None = None) -> Column:
    """Live, no companion of a live photo, no duplicate."""
    return (col("missing", of) == 0) & col("live_photo_of", of).isNull() & col("dup_of", of).isNull()


def under_roots(roots: Sequence[str], path: str = "path") -> Column:
    """In one of the folders; no folders mean no filter."""
    return any_of([F.col(path).ilike(r.rstrip("/") + "/%") for r in roots], empty=True)


def in_year(year: str | int | None, taken: str = "taken_at") -> Column:
    return F.col(taken).startswith(str(year)) if year else F.lit(True)


def parse_months(raw: str | None) -> list[str]:
    """Months 1 to 12 of a comma list, two digits, the first of each; anything else is dropped."""
    months = []
    for part in (raw or "").split(","):
        part = part.strip()
        if part.isdigit() and 1 <= int(part) <= 12 and (m := f"{int(part):02d}") not in months:
            months.append(m)
    return months


def in_months(months: Sequence[str], taken: str = "taken_at") -> Column:
    return F.substring(taken, 6, 2).isin(list(months)) if months else F.lit(True)


def effective_roots(stored: Sequence[str], current: Sequence[str]) -> list[str]:
    """Stored roots that still exist, in their order."""
    live = set(current)
    return [r for r in stored if r in live]


def roots_in_force(stored: Column, live: Column) -> Column:
    """:func:`effective_roots` for a column of stored JSON lists; where none is left, or the JSON is no list, all live roots."""
    kept = F.array_intersect(F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>")), live)
    return F.when(F.size(kept) == 0, live).otherwise(kept)


def roots_to_save(picked: Sequence[str], current: Sequence[str]) -> list[str]:
    """What to store: nothing if all are picked, as that is no filter."""
    kept = [r for r in current if r in set(picked)]
    return [] if len(kept) == len(list(current)) else kept


def is_image() -> Column:
    return F.coalesce(F.col("kind"), F.lit("image")) != "video"


def work_queue(stages: Sequence[str] = ("yolo", "faces", "clip", "meta")) -> Column:
    """Files that some of the stages have not done."""
    open_stage = any_of([F.col(f"{s}_done") == 0 for s in stages])
    return (F.col("missing") == 0) & (F.col("decode_failed") == 0) & (F.col("too_small") == 0) & F.col("live_photo_of").isNull() & open_stage


def _readable() -> Column:
    return (F.col("missing") == 0) & (F.col("too_small") == 0) & (F.col("decode_failed") == 0) & (F.col("content_hash") != "")


def path_like(substring: str | None) -> Column:
    """Path contains the substring; percent and underscore in it act as wildcards."""
    return F.col("path").ilike(f"%{substring}%") if substring else F.lit(True)


def path_contains(substring: str) -> Column:
    """The strict form: every character stands for itself."""
    return F.lower(F.col("path")).contains(substring.lower())


def ocr_queue(redo: bool = False, substring: str | None = None) -> Column:
    done = F.lit(True) if redo else F.col("ocr_done") == 0
    return _readable() & F.col("dup_of").isNull() & done & path_like(substring)


def readability_queue(kind: str | None = None, substring: str | None = None) -> Column:
    return _readable() & (F.col("kind") == kind if kind else F.lit(True)) & path_like(substring)


def phash_queue() -> Column:
    return (
        (F.col("missing") == 0) & (F.col("too_small") == 0) & F.col("phash").isNull() & F.col("dup_of").isNull() & (F.col("content_hash") != "") & is_image()
    )


def rotation_queue(redo: bool = False) -> Column:
    checked = F.lit(True) if redo else F.col("rotation_checked") == 0
    return visible() & (F.col("kind") == "image") & (F.col("rotation") == 0) & (F.col("content_hash") != "") & checked


def pending_rotation() -> Column:
    return F.col("rotation_suggested").isNotNull() & (F.col("rotation") == 0) & visible()


def untagged() -> Column:
    return visible() & F.col("lat").isNull()


def geolocated() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & visible()


def in_box(lat: tuple[float, float], lon: tuple[float, float]) -> Column:
    return F.col("lat").between(*lat) & F.col("lon").between(*lon)


def undated(redo: bool = False, substring: str | None = None) -> Column:
    none = F.col("taken_at").isNull()
    return (F.col("missing") == 0) & (F.col("meta_done") == 1) & ((none | (F.col("date_inferred") == 1)) if redo else none) & path_like(substring)


def exportable(camera: str | None = None, before: str | None = None, after: str | None = None) -> Column:
    """Original photos for an export. Dates compare as text, so that a year alone is a bound."""
    found = (F.col("missing") == 0) & F.col("dup_of").isNull() & (F.col("content_hash") != "") & (F.col("kind") == "image")
    if camera:
        found &= F.col("camera_model").ilike(f"%{camera}%")
    if before:
        found &= F.col("taken_at") < before
    if after:
        found &= F.col("taken_at") >= after
    return found


def collatable(target: str | None = None) -> Column:
    found = F.col("dup_of").isNull() & (F.col("missing") == 0) & (F.col("content_hash") != "")
    return found & ~F.col("path").ilike(target.rstrip("/") + "/%") if target else found


def small(min_pixels: int = 320) -> Column:
    w, h = F.col("width"), F.col("height")
    return (F.col("missing") == 0) & (w > 0) & (h > 0) & (w < min_pixels) & (h < min_pixels)


def is_video_path(path: str = "path") -> Column:
    return any_of([F.lower(F.col(path)).endswith(e) for e in VIDEO_EXTENSIONS])


def is_live_video_path(path: str = "path") -> Column:
    return F.lower(F.substring(F.col(path), -4, 4)).isin(list(LIVE_VIDEO_EXTENSIONS))


#: What derivative files of photo libraries look like.
THUMBNAIL_PATTERNS = (
    "%/thumbnails/%", "%/previews/%", "%/resources/%", "%_thumb.jpg", "%_face0.jpg", "%.thumbnail.jpg", "%/.thumbs/%", "%/thumbs/%",
)


def thumbnail_junk() -> Column:
    return any_of([F.col("path").ilike(p) for p in THUMBNAIL_PATTERNS])


def failed() -> Column:
    return F.col("decode_failed") == 1


def camera_lens(model: str, lens: str | None = None) -> Column:
    """Photos of a camera; of some lenses, tab-separated; the empty string means no lens."""
    found = (F.col("camera_model") == model) & visible()
    if lens is None:
        return found
    return found & (F.col("lens").isin(lens.split("\t")) if lens else F.col("lens").isNull())
