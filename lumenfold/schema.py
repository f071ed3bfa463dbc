"""Table schemas of the catalog, and conforming frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 13


def _table(text: str) -> list[tuple[str, str, object]]:
    """Lines of name, type and, where a missing column needs one, a default."""
    rows = []
    for line in text.strip().splitlines():
        name, kind, *default = line.split()
        rows.append((name, kind, default[0] if default else None))
    return rows


TABLES: dict[str, list[tuple[str, str, object]]] = {
    "files": _table("""
        id bigint
        path string
        content_hash string
        size bigint
        mtime double
        mime string
        width int
        height int
        indexed_at double
        meta_done int 0
        yolo_done int 0
        faces_done int 0
        clip_done int 0
        ocr_done int 0
        missing int 0
        decode_failed int 0
        decode_error string
        too_small int 0
        kind string image
        duration_sec double
        live_photo_of bigint
        live_video_id bigint
        phash string
        dup_of bigint
        rotation int 0
        rotation_checked int 0
        rotation_suggested int
        rotation_suggested_conf double
    """),
    "photo_meta": _table("""
        file_id bigint
        taken_at string
        camera_make string
        camera_model string
        lens string
        iso int
        aperture double
        shutter string
        focal_mm double
        lat double
        lon double
        alt double
        city string
        region string
        country string
        date_inferred int 0
    """),
    "detections": _table("""
        id bigint
        file_id bigint
        label string
        conf double
        x double
        y double
        w double
        h double
        frame_id bigint
    """),
    "faces": _table("""
        id bigint
        file_id bigint
        x double
        y double
        w double
        h double
        det_score double
        cluster_id bigint
        person_name string
        frame_id bigint
    """),
    "face_clusters": _table("""
        cluster_id bigint
        centroid array<float>
        person_name string
        face_count bigint
        person_id bigint
        hidden int 0
    """),
    "persons": _table("""
        id bigint
        primary_name string
        notes string
        created_at string
    """),
    "person_names": _table("""
        id bigint
        person_id bigint
        name string
        start_date string
        end_date string
        is_nickname int 0
    """),
    "frames": _table("""
        id bigint
        file_id bigint
        ts_sec double
        width int
        height int
    """),
    "scan_roots": _table("""
        path string
        last_scanned_at double
    """),
    "app_meta": _table("""
        key string
        value string
    """),
    "vec_clip": _table("""
        id bigint
        embedding array<float>
    """),
    "vec_faces": _table("""
        id bigint
        embedding array<float>
    """),
    "vec_clip_frames": _table("""
        id bigint
        embedding array<float>
    """),
    "ocr_text": _table("""
        file_id bigint
        text string
    """),
}

#: Child tables and their column that refers to files, cleared with a file.
FILE_CHILDREN = {
    "photo_meta": "file_id",
    "detections": "file_id",
    "faces": "file_id",
    "frames": "file_id",
    "ocr_text": "file_id",
    "vec_clip": "id",
}


def struct(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k, _ in TABLES[table]])


def ddl(table: str) -> str:
    return ", ".join(f"{n} {k}" for n, k, _ in TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns in order: missing ones added with their default, others cast, extra ones kept last."""
    have = set(df.columns)
    columns = []
    for name, kind, default in TABLES[table]:
        column = F.col(f"`{name}`") if name in have else F.lit(default)
        columns.append(column.cast(kind).alias(name))
    known = {n for n, _, _ in TABLES[table]}
    return df.select(*columns, *[F.col(f"`{c}`") for c in df.columns if c not in known])
