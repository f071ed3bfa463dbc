"""The catalog's tables as views of the driver's tables, in SQL that Spark and DuckDB read alike.

``{sha}`` stands for the engine's SHA-256 in hex. Whole numbers are cast to double before they are divided.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "files": """
        SELECT id, path, content_hash, size, CAST(id AS DOUBLE) AS mtime,
               CAST(50 + id * 7 % 900 AS INT) AS width, CAST(50 + id * 13 % 700 AS INT) AS height,
               CAST(CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END AS INT) AS missing,
               CAST(CASE WHEN id % 29 = 0 THEN 1 ELSE 0 END AS INT) AS too_small,
               CASE WHEN id % 17 = 0 THEN id + 1 END AS dup_of,
               CASE WHEN id % 31 = 0 THEN id + 1 END AS live_photo_of,
               CASE WHEN id % 10 = 0 THEN 'video' ELSE 'image' END AS kind,
               CASE WHEN id % 47 <> 0 THEN substr(content_hash, 1, 15) || substr('0123456789abcdef', CAST(id % 16 AS INT) + 1, 1) END AS phash,
               CAST(CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS INT) AS decode_failed,
               CASE WHEN id % 97 = 0 THEN 'cannot decode ' || CAST(id AS STRING) END AS decode_error,
               CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS INT) AS yolo_done,
               CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END AS INT) AS faces_done,
               CAST(CASE WHEN id % 11 = 0 THEN 0 ELSE 1 END AS INT) AS clip_done,
               CAST(CASE WHEN id % 13 = 0 THEN 0 ELSE 1 END AS INT) AS meta_done,
               CAST(CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS INT) AS ocr_done,
               CAST(CASE WHEN id % 5 = 0 THEN 90 * (id % 4) ELSE 0 END AS INT) AS rotation,
               CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS rotation_checked,
               CAST(CASE WHEN id % 19 = 0 THEN 90 * (1 + id % 3) END AS INT) AS rotation_suggested,
               CASE WHEN id % 19 = 0 THEN CAST(id % 100 AS DOUBLE) / 100 END AS rotation_suggested_conf,
               CASE WHEN id % 10 = 0 THEN CAST(id % 14400 AS DOUBLE) / 2 END AS duration_sec,
               CAST(NULL AS BIGINT) AS live_video_id
        FROM (
            SELECT CAST(o_orderkey AS BIGINT) AS id,
                   '/lib/r' || substr(o_orderpriority, 1, 1) || '/' || replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '/')
                       || '/roll' || CAST(o_orderkey AS STRING) || '/IMG_' || lpad(CAST(o_custkey AS STRING), 6, '0')
                       || CASE WHEN o_orderkey % 10 = 0 THEN '.MOV' WHEN o_orderkey % 10 = 1 THEN '.HEIC' ELSE '.JPG' END AS path,
                   {sha}(CAST(o_custkey AS STRING) || '-' || o_orderstatus) AS content_hash,
                   CAST(floor(o_totalprice) AS BIGINT) AS size
            FROM orders
        ) o""",
    "photo_meta": """
        SELECT CAST(o_orderkey AS BIGINT) AS file_id,
               CASE WHEN o_orderkey % 7 <> 0 THEN
                   substr(CAST(o_orderdate AS STRING), 1, 10) || ' ' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':00:00' END AS taken_at,
               c_mktsegment AS camera_make,
               c_mktsegment || ' ' || CAST(c_nationkey % 5 AS STRING) AS camera_model,
               CASE o_custkey % 6
                   WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '65535'
                   WHEN 2 THEN c_mktsegment || ' ' || CAST(c_nationkey % 5 AS STRING) || ' front camera 2.7mm f/2.2'
                   ELSE c_mktsegment || ' ' || CAST(c_nationkey % 5 AS STRING) || ' back camera ' || CAST(o_custkey % 6 AS STRING) || '.' || CAST(o_custkey % 2 AS STRING) || 'mm f/1.8'
               END AS lens,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey * 37 % 17000 AS DOUBLE) / 100 - 85 END AS lat,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey * 53 % 35000 AS DOUBLE) / 100 - 175 END AS lon,
               'CITY_' || CAST(o_custkey % 50 AS STRING) AS city, r_name AS region, n_name AS country,
               CAST(CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS INT) AS date_inferred
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "detections": """
        SELECT CAST(l_orderkey AS BIGINT) AS file_id, p_type AS label, l_discount * 10 AS conf,
               CAST(l_partkey % 100 AS DOUBLE) / 100 AS x, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS y,
               CAST(l_linenumber AS DOUBLE) / 20 AS w, CAST(l_linenumber AS DOUBLE) / 16 AS h
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "faces": """
        SELECT CAST(l_orderkey AS BIGINT) AS file_id, CAST(l_suppkey AS BIGINT) AS cluster_id, round(1 - l_tax, 4) AS det_score,
               CAST(l_partkey % 60 AS DOUBLE) / 100 AS x, CAST(l_partkey % 40 AS DOUBLE) / 100 AS y,
               CAST(1 + l_linenumber AS DOUBLE) / 32 AS w, CAST(1 + l_linenumber AS DOUBLE) / 32 AS h,
               CASE WHEN l_suppkey % 3 <> 0 THEN s_name END AS person_name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE l_returnflag = 'R'""",
    "face_clusters": """
        SELECT CAST(s_suppkey AS BIGINT) AS cluster_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS person_name,
               CAST(s_nationkey AS BIGINT) AS person_id, CAST(CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS hidden
        FROM supplier
        UNION ALL
        SELECT CAST(n_nationkey + 10000000 AS BIGINT), CASE WHEN n_nationkey > 9 THEN n_name END, CAST(NULL AS BIGINT), 0 FROM nation""",
    "persons": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS primary_name FROM nation",
    "person_names": """
        SELECT CAST(n_nationkey * 3 AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS person_id, n_name || ' ever' AS name,
               CAST(NULL AS STRING) AS start_date, CAST(NULL AS STRING) AS end_date FROM nation
        UNION ALL
        SELECT CAST(n_nationkey * 3 + 1 AS BIGINT), CAST(n_nationkey AS BIGINT), n_name || ' since', '1994-0' || CAST(1 + n_nationkey % 9 AS STRING) || '-01', CAST(NULL AS STRING) FROM nation
        UNION ALL
        SELECT CAST(n_nationkey * 3 + 2 AS BIGINT), CAST(n_nationkey AS BIGINT), n_name || ' then', '1995-01-01', '199' || CAST(5 + n_nationkey % 4 AS STRING) || '-12-31' FROM nation""",
    "vectors": "SELECT CAST(vec_id AS BIGINT) AS id, embedding, label FROM embeddings",
    "ocr_text": "SELECT CAST(doc_id AS BIGINT) AS file_id, text FROM documents",
    "checkpoint_log": """
        SELECT CAST(event_id AS BIGINT) AS line_no,
               CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'stage' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'mem' END AS event,
               CAST(user_id AS BIGINT) AS file_id
        FROM events""",
    "listing": """
        SELECT path, size, mtime, content_hash FROM (
            SELECT path, CASE WHEN id % 37 = 0 THEN size + 1 ELSE size END AS size, mtime,
                   CASE WHEN id % 37 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash
            FROM files WHERE id % 41 <> 0
            UNION ALL
            SELECT '/lib/r9/new' || CAST(id AS STRING) || '.JPG', size, mtime, CASE WHEN id % 2 = 0 THEN content_hash ELSE content_hash || CAST(id AS STRING) END
            FROM files WHERE id % 43 = 0
        ) l""",
    "dated_paths": """
        SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 7
            WHEN 0 THEN '/lib/IMG_' || replace(d, '-', '') || '_' || lpad(CAST(o_orderkey % 30 AS STRING), 2, '0') || '1500.jpg'
            WHEN 1 THEN '/lib/Screenshot ' || d || '.png'
            WHEN 2 THEN '/lib/' || replace(d, '-', '/') || '/a.jpg'
            WHEN 3 THEN '/lib/March ' || CAST(CAST(substr(d, 9, 2) AS INT) AS STRING) || ', ' || substr(d, 1, 4) || '/b.jpg'
            WHEN 4 THEN '/lib/' || substr(d, 1, 7) || '/c' || CAST(o_orderkey AS STRING) || '.jpg'
            WHEN 5 THEN '/lib/' || replace(substr(d, 1, 7), '-', '/') || '/d.jpg'
            ELSE '/lib/Aug ' || substr(d, 1, 4) || '/e.jpg' END AS path
        FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS d FROM orders) o""",
    "cities": """
        SELECT n_name AS name, substr(r_name, 1, 2) AS country, r_name AS region, CAST(n_nationkey * 331 % 170 AS DOUBLE) - 85 AS lat,
               CAST(n_nationkey * 577 % 350 AS DOUBLE) - 175 AS lon, CAST(n_nationkey AS BIGINT) * 90000 AS population
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "landmarks": """
        SELECT p_name AS name, p_brand AS kind, CAST(p_partkey * 7 % 170 AS DOUBLE) - 85 AS lat, CAST(p_partkey * 13 % 350 AS DOUBLE) - 175 AS lon,
               CAST(p_size AS BIGINT) AS sitelinks
        FROM part""",
}

#: Catalog tables that read others.
NEEDS = {"listing": ["files"]}
SOURCES = "region nation customer supplier part orders lineitem events documents embeddings".split()


class Catalog(Mapping[str, DataFrame]):
    """Lazy frames of the projected tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    @cached_property
    def _sources(self) -> dict[str, DataFrame]:
        return {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._sources[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = TABLES[name].format(sha="sha2_256")
            text = text.replace("sha2_256(CAST(o_custkey AS STRING) || '-' || o_orderstatus)", "sha2(CAST(o_custkey AS STRING) || '-' || o_orderstatus, 256)")
            words = set(text.replace("(", " ").replace(")", " ").split())
            frames = {s: self.source(s) for s in SOURCES if s in words} | {t: self[t] for t in NEEDS.get(name, ())}
            # Frames go in as arguments: no view of the session is made or hidden.
            for key in frames:
                text = _named(text, key)
            self._frames[name] = self.spark.sql(text, **frames)
        return self._frames[name]

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self[name]
        raise AttributeError(name)


def _named(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}} AS {table}", text)


def oracle(query: str, *tables: str) -> str:
    """DuckDB SQL: the named tables, and those they need, before ``query``."""
    order: list[str] = []
    for t in tables:
        for n in [*NEEDS.get(t, ()), t]:
            if n not in order:
                order.append(n)
    if not order:
        return query
    views = ", ".join(f"{t} AS ({TABLES[t].format(sha='sha256')})" for t in order)
    return f"WITH RECURSIVE {views} {query}" if not query.lstrip().upper().startswith("WITH ") else f"WITH RECURSIVE {views}, {query.lstrip()[5:]}"
