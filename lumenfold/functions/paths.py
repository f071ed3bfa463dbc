"""Parts of paths, kinds of files, and names of targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind of file.
IMAGE_EXTENSIONS = tuple(".jpg .jpeg .png .tif .tiff .bmp .gif .webp .heic .heif .avif".split())
RAW_EXTENSIONS = tuple(".cr2 .cr3 .nef .arw .dng .orf .rw2 .raf .pef".split())
VIDEO_EXTENSIONS = tuple(".mov .mp4 .m4v .avi .mkv".split())
SUPPORTED = IMAGE_EXTENSIONS + RAW_EXTENSIONS + VIDEO_EXTENSIONS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case, or the empty string."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def kind_of(path: Column) -> Column:
    return F.when(extension(path).isin(list(VIDEO_EXTENSIONS)), "video").otherwise("image")


def mime_of(path: Column) -> Column:
    ext = extension(path)
    sub = F.substring(ext, 2, 10)
    return (
        F.when(ext.isin(".jpg", ".jpeg"), "image/jpeg")
        .when(ext.isin(".tif", ".tiff"), "image/tiff")
        .when(ext.isin(".heic", ".heif", ".avif", ".png", ".webp", ".bmp", ".gif"), F.concat(F.lit("image/"), sub))
        .when(ext == ".mov", "video/quicktime")
        .when(ext.isin(".mp4", ".m4v"), "video/mp4")
    )


def date_folder(taken: Column, undated: str = "undated") -> Column:
    """YYYY/MM/DD of a text timestamp whose dashes stand in their places, or the folder for the rest."""
    dashed = (F.length(taken) >= 10) & (F.substring(taken, 5, 1) == "-") & (F.substring(taken, 8, 1) == "-")
    return F.when(dashed, F.concat_ws("/", F.substring(taken, 1, 4), F.substring(taken, 6, 2), F.substring(taken, 9, 2))).otherwise(undated)


def target_name(path: Column, content_hash: Column, collides: Column) -> Column:
    """The file's name, with eight digits of its hash before the extension where names collide."""
    name = basename(path)
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return F.when(collides, F.concat(stem(path), F.lit("-"), F.substring(content_hash, 1, 8), ext)).otherwise(name)


def comparison_key(by: str, taken: Column, path: Column, phash: Column) -> Column:
    """By what two trees' files are the same: exif, phash, taken or name. Null or empty means no key."""
    keys = {
        "exif": F.when(F.coalesce(taken, F.lit("")) != "", F.concat(taken, F.lit("|"), F.lower(basename(path)))),
        "phash": F.nullif(phash, F.lit("")),
        "taken": F.nullif(taken, F.lit("")),
        "name": F.lower(basename(path)),
    }
    return keys[by]


def clean_error(text: Column, most: int = 500) -> Column:
    return F.substring(F.regexp_replace(text, "\n", " "), 1, most)
