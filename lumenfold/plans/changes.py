"""Queries that show changes of the catalog, sources and stages: new snapshots compared with SQL's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import bits, formats, geo, paths
from lumenfold.operators import clustering, duplicates, organise, people, places, scanning, search, stats
from lumenfold.operators import transitions as X
from lumenfold.plans.projection import Catalog
from lumenfold.plans.registry import CLASSIFY, FM, FMI, LIVE_PAIRS, VIS, _classified, _first_vector, _keeper_sql, _pairable, query
from lumenfold.session import shared_dir
from lumenfold.sources import exif, gazetteer, sampling, stages
from lumenfold.streaming import incremental, inflight


def _flags(files: DataFrame, *names: str) -> DataFrame:
    return files.select("id", *names)


@query(
    "apply_scan",
    f"""WITH {CLASSIFY}, hit AS (SELECT c.file_id, c.state, c.path, l.size, l.mtime, l.content_hash FROM classified c JOIN listing l ON l.path = c.path WHERE c.file_id IS NOT NULL AND state <> 'dedup_skipped')
        SELECT CASE WHEN state = 'moved' THEN h.path ELSE f.path END AS path, CASE WHEN state IN ('changed', 'moved') THEN h.size ELSE f.size END AS size,
            CASE WHEN state = 'changed' THEN h.content_hash ELSE f.content_hash END AS content_hash,
            CASE WHEN state IN ('changed', 'moved', 'unchanged') THEN 0 ELSE f.missing END AS missing, CASE WHEN state = 'changed' THEN 0 ELSE f.yolo_done END AS yolo_done,
            CASE WHEN state = 'changed' THEN 0 ELSE f.too_small END AS too_small
        FROM files f LEFT JOIN hit h ON h.file_id = f.id
        UNION ALL SELECT c.path, l.size, l.content_hash, 0, 0, 0 FROM classified c JOIN listing l ON l.path = c.path WHERE state = 'new'""",
    "files", "listing",
)
def _(c):
    return scanning.apply_scan(c.files, _classified(c)).select("path", "size", "content_hash", "missing", "yolo_done", "too_small")


@query(
    "mark_missing",
    "SELECT id, CASE WHEN missing = 0 AND path IN (SELECT path FROM listing) THEN 0 ELSE 1 END AS missing FROM files", "files", "listing",
)
def _(c):
    return _flags(X.mark_missing(c.files, scanning.check_missing(c.files, c.listing)), "missing")


@query(
    "mark_live",
    f"""WITH {LIVE_PAIRS}, back AS (SELECT still_id, min(video_id) AS v FROM pairs GROUP BY still_id)
        SELECT id, pairs.still_id AS live_photo_of, v AS live_video_id FROM files LEFT JOIN pairs ON id = video_id LEFT JOIN back ON back.still_id = id""",
    "files",
)
def _(c):
    return _flags(duplicates.mark_live(_pairable(c)), "live_photo_of", "live_video_id")


@query(
    "mark_duplicates",
    f"SELECT f.id AS id, coalesce(CASE WHEN k.keeper <> f.id THEN k.keeper END, f.dup_of) AS dup_of FROM files f LEFT JOIN ({_keeper_sql('length(path), path')}) k ON k.id = f.id",
    "files", "photo_meta",
)
def _(c):
    return _flags(duplicates.mark_duplicates(c.files, c.photo_meta), "dup_of")


@query("reset_duplicates", "SELECT id, CAST(NULL AS BIGINT) AS dup_of FROM files", "files")
def _(c):
    return _flags(X.reset_duplicates(c.files), "dup_of")


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in sorted(tables.items()):
        row = frame.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _cascade_sql(condition: str) -> str:
    gone = f"SELECT id FROM files WHERE {condition}"
    return f"""SELECT 'files' AS tab, count(*) AS n FROM files WHERE id NOT IN ({gone})
        UNION ALL SELECT 'photo_meta', count(*) FROM photo_meta WHERE file_id NOT IN ({gone}) UNION ALL SELECT 'detections', count(*) FROM detections WHERE file_id NOT IN ({gone})
        UNION ALL SELECT 'faces', count(*) FROM faces WHERE file_id NOT IN ({gone}) UNION ALL SELECT 'ocr_text', count(*) FROM ocr_text WHERE file_id NOT IN ({gone})
        UNION ALL SELECT 'vec_clip', count(*) FROM vectors WHERE id NOT IN ({gone})"""


def _tables(c: Catalog) -> dict[str, DataFrame]:
    return {n: c[n] for n in ("files", "photo_meta", "detections", "faces", "ocr_text")} | {"vec_clip": c.vectors}


for _name, _sql, _make in (
    ("drop_small", "missing = 0 AND width > 0 AND height > 0 AND width < 320 AND height < 320", P.small),
    ("drop_videos", "lower(path) LIKE '%.mov'", P.is_video_path),
    ("drop_path", "path ILIKE '%/lib/r2/%'", lambda: P.path_like("/lib/r2/")),
    ("cleanup_thumbnails", "path ILIKE '%/thumbs/%' OR path ILIKE '%/previews/%'", P.thumbnail_junk),
):

    @query(_name, _cascade_sql(_sql), "files", "photo_meta", "detections", "faces", "ocr_text", "vectors")
    def _(c, make=_make):
        return _counts(X.drop_where(_tables(c), make()))


@query("tombstone", "SELECT id, CASE WHEN id = 8 THEN 1 ELSE decode_failed END AS decode_failed, CASE WHEN id = 8 THEN 'bad codec' ELSE decode_error END AS decode_error FROM files", "files")
def _(c):
    return _flags(X.tombstone(c.files, 8, "bad\ncodec"), "decode_failed", "decode_error")


@query("clear_failures", "SELECT id, CASE WHEN path ILIKE '%/r1/%' THEN 0 ELSE decode_failed END AS decode_failed FROM files", "files")
def _(c):
    return _flags(X.clear_failures(c.files, "/r1/"), "decode_failed")


@query(
    "reset_turned",
    """SELECT id, CASE WHEN height < 400 THEN 0 ELSE yolo_done END AS yolo_done, CASE WHEN height < 400 THEN 0 ELSE width END AS width FROM files""",
    "files",
)
def _(c):
    sizes = c.files.select("id", F.when(F.col("height") < 400, F.col("width") + 1).otherwise(F.col("width")).alias("width"), "height")
    return _flags(X.reset_turned(c.files, sizes, {})["files"], "yolo_done", "width")


@query(
    "fill_hashes",
    "SELECT id, CASE WHEN phash IS NULL AND missing = 0 AND too_small = 0 AND dup_of IS NULL AND kind <> 'video' THEN CASE WHEN height < 400 THEN 'ab' ELSE '' END ELSE phash END AS phash FROM files",
    "files",
)
def _(c):
    return _flags(X.fill_hashes(c.files, c.files.where("height < 400").select("id", F.lit("ab").alias("phash"))), "phash")


@query(
    "backfill_applied",
    """WITH i AS (SELECT file_id FROM files JOIN photo_meta ON id = file_id WHERE missing = 0 AND meta_done = 1 AND taken_at IS NULL)
        SELECT m.file_id AS file_id, CASE WHEN i.file_id IS NOT NULL THEN replace(regexp_extract(path, '/([0-9]{4}/[0-9]{2}/[0-9]{2})/', 1), '/', '-') || ' 12:00:00' ELSE taken_at END AS taken_at,
            CASE WHEN i.file_id IS NOT NULL THEN 1 ELSE date_inferred END AS date_inferred FROM photo_meta m JOIN files ON id = m.file_id LEFT JOIN i ON i.file_id = m.file_id""",
    "files", "photo_meta",
)
def _(c):
    _, meta = X.backfill_dates(c.files, c.photo_meta, organise.backfill(c.files, c.photo_meta))
    return meta.select("file_id", "taken_at", "date_inferred")


@query(
    "geotag_applied",
    """SELECT file_id, CASE WHEN file_id IN (3, 5) THEN 1.5 ELSE lat END AS lat, CASE WHEN file_id IN (3, 5) THEN 'Town' ELSE city END AS city FROM photo_meta
        UNION ALL SELECT 999999999, 1.5, 'Town'""",
    "photo_meta",
)
def _(c):
    return X.geotag(c.photo_meta, [3, 5, 999999999], 1.5, 2.5, "Town").select("file_id", "lat", "city")


EXIF = """tags AS (SELECT CAST(o_orderkey AS BIGINT) AS id, replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', ':') || ' 10:20:30' AS d, c_mktsegment AS make, CAST(o_custkey % 90 AS VARCHAR) AS lat,
    CASE WHEN o_orderkey % 2 = 0 THEN 'South' ELSE 'N' END AS ref FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _tags(c: Catalog) -> DataFrame:
    rows = c.source("orders").join(c.source("customer"), F.col("o_custkey") == F.col("c_custkey"))
    date = F.concat(F.replace(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit("-"), F.lit(":")), F.lit(" 10:20:30"))
    even, third = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    tags = F.create_map(
        F.lit("EXIF:DateTimeOriginal"), F.when(third, exif.NO_DATE).otherwise(date), F.lit("EXIF:CreateDate"), date, F.lit("EXIF:Make"), F.col("c_mktsegment"),
        F.lit("EXIF:GPSLatitude"), (F.col("o_custkey") % 90).cast("string"), F.lit("EXIF:GPSLatitudeRef"), F.when(even, "South").otherwise("N"), F.lit("EXIF:ISO"), F.lit("many"),
    )
    return rows.select(F.col("o_orderkey").cast("string").alias("path"), tags.alias("tags"))


@query(
    "exif_rows",
    f"""WITH {EXIF} SELECT CAST(id AS VARCHAR) AS path, regexp_replace(d, '^([0-9]+):([0-9]+):', '\\1-\\2-') AS taken_at, make AS camera_make,
        CASE WHEN ref = 'South' THEN -abs(CAST(lat AS DOUBLE)) + 0.0 ELSE CAST(lat AS DOUBLE) END AS lat, CAST(NULL AS INT) AS iso FROM tags""",
)
def _(c):
    return exif.rows(_tags(c)).select("path", "taken_at", "camera_make", (F.col("lat") + 0.0).alias("lat"), "iso")


@query(
    "store_metadata",
    f"""WITH {EXIF} SELECT id AS file_id, regexp_replace(d, '^([0-9]+):([0-9]+):', '\\1-\\2-') AS taken_at, 0 AS date_inferred, CAST(NULL AS VARCHAR) AS city FROM tags
        UNION ALL SELECT file_id, taken_at, date_inferred, city FROM photo_meta WHERE file_id NOT IN (SELECT id FROM tags)""",
    "photo_meta",
)
def _(c):
    found = exif.rows(_tags(c)).withColumn("file_id", F.col("path").cast("bigint")).drop("path")
    meta, _ = X.store_metadata(c.photo_meta, c.files, found.select(*[x for x in found.columns if x in c.photo_meta.columns]))
    return meta.select("file_id", "taken_at", "date_inferred", "city")


@query("rotate", "SELECT id, CASE WHEN id = 5 THEN CAST((rotation + 270) % 360 AS INT) ELSE rotation END AS rotation FROM files", "files")
def _(c):
    return _flags(X.rotate(c.files, 5, -90), "rotation")


@query(
    "record_suggestions",
    """SELECT id, 1 AS rotation_checked,
        CASE WHEN (id % 3) * 90 <> 0 AND id % 100 >= 90 THEN CAST((id % 3) * 90 AS INT) END AS rotation_suggested FROM files""",
    "files",
)
def _(c):
    found = c.files.select("id", ((F.col("id") % 3) * 90).cast("int").alias("degrees"), (F.col("id") % 100 / 100.0).cast("double").alias("prob"))
    return _flags(X.record_suggestions(c.files, found), "rotation_checked", "rotation_suggested")


@query(
    "accept_rotation",
    "SELECT id, CASE WHEN id = 38 AND rotation_suggested IS NOT NULL THEN rotation_suggested ELSE rotation END AS rotation, CASE WHEN id = 38 THEN NULL ELSE rotation_suggested END AS rotation_suggested FROM files",
    "files",
)
def _(c):
    return _flags(X.accept_rotation(c.files, 38), "rotation", "rotation_suggested")


@query("hide_cluster", "SELECT cluster_id, CASE WHEN cluster_id = 4 THEN 1 ELSE hidden END AS hidden FROM face_clusters", "face_clusters")
def _(c):
    return X.hide_cluster(c.face_clusters, 4).select("cluster_id", "hidden")


@query(
    "name_cluster",
    "SELECT cluster_id, coalesce(CASE WHEN cluster_id = 3 THEN 'New Name' ELSE person_name END, '-') AS name, count(*) AS n FROM faces GROUP BY 1, 2", "faces",
)
def _(c):
    faces = X.name_cluster(c.faces, c.face_clusters, c.persons, c.person_names, 3, "New Name")["faces"]
    return faces.groupBy("cluster_id", F.coalesce("person_name", F.lit("-")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_clusters",
    """WITH m AS (SELECT CASE WHEN cluster_id IN (4, 5) THEN 2 ELSE cluster_id END AS cluster_id, person_name FROM faces)
        SELECT cluster_id, coalesce(CASE WHEN cluster_id = 2 THEN (SELECT person_name FROM face_clusters WHERE cluster_id = 2) ELSE person_name END, '-') AS name, count(*) AS n FROM m GROUP BY 1, 2""",
    "faces", "face_clusters",
)
def _(c):
    faces, _ = X.merge_clusters(c.faces, c.face_clusters, 2, [4, 5])
    return faces.groupBy("cluster_id", F.coalesce("person_name", F.lit("-")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_persons",
    "SELECT CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id, name FROM person_names", "person_names",
)
def _(c):
    return X.merge_persons(c.persons, c.person_names, c.face_clusters, 1, 2)[1].select("person_id", "name")


@query(
    "refresh_names",
    """WITH s AS (SELECT DISTINCT f.file_id, f.cluster_id, person_id, substr(taken_at, 1, 10) AS "day" FROM faces f JOIN face_clusters USING (cluster_id) LEFT JOIN photo_meta m ON m.file_id = f.file_id),
        r AS (SELECT s.*, e.name, row_number() OVER (PARTITION BY file_id, cluster_id ORDER BY (start_date IS NOT NULL)::INT + (end_date IS NOT NULL)::INT DESC, coalesce(start_date, '') DESC, e.id DESC) AS rn
            FROM s LEFT JOIN person_names e ON e.person_id = s.person_id AND "day" <> '' AND (start_date IS NULL OR start_date <= "day") AND (end_date IS NULL OR end_date >= "day"))
        SELECT coalesce(r.name, primary_name) AS person_name, count(*) AS n FROM faces f JOIN r ON r.file_id = f.file_id AND r.cluster_id = f.cluster_id AND rn = 1 JOIN persons p ON p.id = person_id GROUP BY 1""",
    "faces", "face_clusters", "photo_meta", "persons", "person_names",
)
def _(c):
    rows = X.refresh_names(c.faces, c.photo_meta, c.face_clusters, c.persons, c.person_names)
    return rows.groupBy("person_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "backfill_persons",
    """SELECT primary_name FROM persons UNION ALL SELECT DISTINCT person_name FROM face_clusters WHERE lower(person_name) NOT IN (SELECT lower(primary_name) FROM persons)""",
    "persons", "face_clusters",
)
def _(c):
    loose = c.face_clusters.withColumn("person_id", F.lit(None).cast("bigint"))
    return X.backfill_persons(loose, c.persons, c.person_names)[1].select("primary_name")


@query("purge_orphans", "SELECT id FROM vectors WHERE id IN (SELECT id FROM files WHERE kind = 'video')", "vectors", "files")
def _(c):
    return X.purge_orphans(c.vectors, c.files.where("kind = 'video'")).select("id")


@query(
    "set_meta",
    "SELECT 'collate_target' AS \"key\", '/out' AS value UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region",
)
def _(c):
    table = c.source("region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    new = c.spark.createDataFrame([("collate_target", "/out")], "key string, value string")
    return X.replace_by_key(table, new, "key")


# Keys, bits, landmarks, samples.


@query(
    "comparison_keys",
    f"""SELECT id, CASE WHEN coalesce(taken_at, '') <> '' THEN taken_at || '|' || lower(regexp_extract(path, '[^/]*$')) END AS exif, nullif(taken_at, '') AS taken, lower(regexp_extract(path, '[^/]*$')) AS name FROM {FM}""",
    "files", "photo_meta",
)
def _(c):
    rows = c.files.join(c.photo_meta, F.col("id") == F.col("file_id"), "left")
    key = lambda by: paths.comparison_key(by, F.col("taken_at"), F.col("path"), F.col("phash")).alias(by)
    return rows.select("id", key("exif"), key("taken"), key("name"))


@query(
    "hash_distances",
    """WITH h AS (SELECT id, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM files)
        SELECT a.id AS id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INT) AS d FROM h a JOIN h b ON b.id = a.id + 1""",
    "files",
)
def _(c):
    h = c.files.select("id", bits.bits_of(F.col("phash")).alias("x"))
    other = h.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return h.join(other, "id").select("id", bits.hamming(F.col("x"), F.col("y")).alias("d"))


@query(
    "landmarks_dedupe",
    """SELECT name, kind, CAST(sitelinks AS BIGINT) AS sitelinks FROM (SELECT p_name AS name, p_brand AS kind, p_size + 5 AS sitelinks, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1""",
)
def _(c):
    rows = c.source("part").select(
        (F.col("p_partkey") % 200).cast("string").alias("qid"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("kind_no"),
        F.concat(F.lit("Point("), F.col("p_size"), F.lit(" "), F.col("p_size") / 2, F.lit(")")).alias("point"), (F.col("p_size") + 5).cast("bigint").alias("sitelinks"),
    )
    return gazetteer.from_points(rows).select("name", "kind", "sitelinks")


@query(
    "sample_top_up",
    """WITH y AS (SELECT file_id, substr(taken_at, 1, 4) AS "year", md5('7:' || file_id) AS h FROM photo_meta),
        s AS (SELECT file_id, "year" FROM y WHERE "year" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "year" ORDER BY h, file_id) <= 50),
        r AS (SELECT file_id, "year" FROM y WHERE file_id NOT IN (SELECT file_id FROM s) ORDER BY h, file_id LIMIT (SELECT greatest(0, 1700 - count(*)) FROM s))
        SELECT "year", file_id FROM s UNION ALL SELECT "year", file_id FROM r""",
    "photo_meta",
)
def _(c):
    return sampling.top_up(sampling.by_year(c.photo_meta, samples=100, seed=7, least=50), c.photo_meta, 1700, 7)


@query(
    "map_boxes",
    f"""SELECT count(*) AS n FROM {FMI} WHERE lat BETWEEN 48.85 - 500 / 111.32 AND 48.85 + 500 / 111.32 AND lon BETWEEN 2.35 - 500 / (111.32 * cos(radians(48.85))) AND 2.35 + 500 / (111.32 * cos(radians(48.85)))""",
    "files", "photo_meta",
)
def _(c):
    return c.files.join(c.photo_meta, F.col("id") == F.col("file_id")).where(P.in_box(*geo.degree_box(48.85, 2.35, 500))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "search_vector_visible",
    f"""SELECT id FROM (SELECT v.id AS id FROM vectors v JOIN files f ON f.id = v.id, vectors q WHERE q.id = 0 AND {VIS.replace('missing', 'f.missing')}
        ORDER BY sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: pow(CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), v.id LIMIT 30)""",
    "vectors", "files",
)
def _(c):
    return search.by_vector(c.files, c.photo_meta, c.vectors, _first_vector(c), 30, visible_only=True).select("id")


@query(
    "nearest_frames_and_photos",
    """SELECT v.id AS id, round(sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: pow(CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), 6) AS distance
        FROM vectors v, vectors q WHERE q.id = 0 ORDER BY distance, v.id LIMIT 20""",
    "vectors",
)
def _(c):
    """An extension: photos' and frames' vectors in one search."""
    photos = c.vectors.where("id % 2 = 0").select("id", "embedding")
    frames = c.vectors.where("id % 2 = 1").select("id", "embedding")
    return search.nearest(photos.unionByName(frames), _first_vector(c), 20).select("id", F.round("distance", 6).alias("distance"))


# Stages, the log, events.


_QUEUE = "missing = 0 AND decode_failed = 0 AND too_small = 0 AND live_photo_of IS NULL"
_HEX = "CAST(('0x' || substr(content_hash, {}, 2)) AS INT)"


@query(
    "stage_embed",
    f"""WITH q AS (SELECT id, content_hash FROM files WHERE {_QUEUE} AND clip_done = 0),
        x AS (SELECT id, [{', '.join(f'({_HEX.format(2 * i + 1)} - 127.5) / 128' for i in range(32))}] AS v FROM q),
        e AS (SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS "first", 32 AS dim FROM x)
        SELECT id, CASE WHEN id IN (SELECT id FROM q) THEN 1 ELSE clip_done END AS clip_done, "first", dim FROM files JOIN (
            SELECT * FROM e UNION ALL SELECT id, round(CAST(embedding[1] AS DOUBLE), 5), len(embedding) FROM vectors WHERE id NOT IN (SELECT id FROM q)) USING (id)""",
    "files", "vectors",
)
def _(c):
    files, table = stages.apply(stages.EMBED, c.files, c.vectors.select(F.col("id").alias("id_"), "embedding"))
    return files.join(table, F.col("id") == F.col("id_")).select(
        "id", "clip_done", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").alias("dim")
    )


@query(
    "stage_detect",
    f"""WITH q AS (SELECT id, content_hash FROM files WHERE {_QUEUE} AND yolo_done = 0),
        made AS (SELECT id AS file_id, content_hash, unnest(range({_HEX.format(1)} % 4)) AS i FROM q),
        rows AS (SELECT file_id, 'label' || CAST(CAST(('0x' || substr(content_hash, CAST(3 + 12 * i AS INT), 2)) AS INT) % 20 AS VARCHAR) AS label,
                CAST(('0x' || substr(content_hash, CAST(5 + 12 * i AS INT), 2)) AS INT) / 256.0 AS conf FROM made
            UNION ALL SELECT file_id, label, conf FROM detections WHERE file_id NOT IN (SELECT id FROM q))
        SELECT file_id, label, round(conf, 6) AS conf FROM rows WHERE file_id IN (SELECT id FROM files WHERE yolo_done = 1 OR id IN (SELECT id FROM q))""",
    "files", "detections",
)
def _(c):
    files, table = stages.apply(stages.DETECT, c.files, c.detections)
    return table.withColumn("conf", F.round("conf", 6)).join(files.where("yolo_done = 1").select("id").hint("shuffle_hash"), F.col("file_id") == F.col("id"), "left_semi").select("file_id", "label", "conf")


@query("incremental_rows", "SELECT id FROM files WHERE id NOT IN (SELECT file_id FROM faces)", "files", "faces")
def _(c):
    return incremental.new_rows(c.files.withColumnRenamed("id", "file_id"), c.faces, "file_id").select(F.col("file_id").alias("id"))


@query(
    "log_status",
    "SELECT file_id, arg_max(event, line_no) AS event, max(line_no) AS line_no FROM checkpoint_log GROUP BY file_id",
    "checkpoint_log",
)
def _(c):
    return incremental.status(c.checkpoint_log)


@query(
    "stream_in_flight",
    """WITH l AS (SELECT strftime(ts::TIMESTAMP, '%Y-%m-%d') AS run, CAST(user_id AS BIGINT) AS file_id, CAST(event_id AS BIGINT) AS line_no, event_type AS e FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        d AS (SELECT run, file_id, max(line_no) AS done FROM l WHERE e = 'purchase' GROUP BY ALL)
        SELECT run, file_id, max(line_no) AS line_no, CAST(count(*) AS INT) AS tries FROM l LEFT JOIN d USING (run, file_id) WHERE e = 'view' AND (done IS NULL OR line_no > done) GROUP BY ALL""",
)
def _(c):
    """Files in hand of each day's run, by a stream of the events with a state for each file."""
    place = f"{shared_dir(c.spark)}/in-flight-{uuid.uuid4().hex}"
    events = c.spark.readStream.schema(c.source("events").schema).option("maxFilesPerTrigger", 64).parquet(f"{c.sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    word = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done")
    lines = events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_id").cast("bigint").alias("line_no"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("ts"),
        word.alias("event"), F.col("user_id").cast("bigint").alias("file_id"),
    )
    inflight.follow(lines, f"{place}/changes", f"{place}/progress", patience=1e9, late="3650 days")
    return inflight.in_hand(c.spark.read.schema(inflight.CHANGES).parquet(f"{place}/changes")).select("run", "file_id", "line_no", "tries")


@query(
    "event_windows",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def _(c):
    """An extension: events by windows of six hours."""
    rows = c.source("events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts::TIMESTAMP AS t, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(t) AS "start", max(t) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(c):
    """An extension: a user's events without a gap of half an hour."""
    return incremental.sessions(c.source("events"))


# Whole profiles.


@query(
    "photo_detail",
    f"""SELECT f.id AS id, path, taken_at, (SELECT count(*) FROM detections d WHERE d.file_id = f.id) AS n_detections, (SELECT count(*) FROM faces x WHERE x.file_id = f.id) AS n_faces
        FROM files f LEFT JOIN photo_meta m ON m.file_id = f.id WHERE f.id IN (7, 100, 101)""",
    "files", "photo_meta", "detections", "faces",
)
def _(c):
    ids = [7, 100, 101]
    one = lambda t, n: c[t].where(F.col("file_id").isin(ids)).groupBy("file_id").agg(F.count(F.lit(1)).alias(n))
    rows = places.by_ids(c.files, c.photo_meta, ids).select("id", "path", "taken_at")
    rows = rows.join(one("detections", "n_detections"), F.col("id") == F.col("file_id"), "left").drop("file_id")
    rows = rows.join(one("faces", "n_faces"), F.col("id") == F.col("file_id"), "left").drop("file_id")
    return rows.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_detections", "n_faces")})


@query(
    "majority_written",
    """WITH v AS (SELECT cluster_id, person_name, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, person_name) AS rn FROM faces WHERE person_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT k.cluster_id AS cluster_id, coalesce(k.person_name, v.person_name) AS person_name FROM face_clusters k LEFT JOIN v ON v.cluster_id = k.cluster_id AND rn = 1""",
    "faces", "face_clusters",
)
def _(c):
    votes = people.majority_names(c.faces).select("cluster_id", F.col("person_name").alias("v"))
    return c.face_clusters.join(votes, "cluster_id", "left").select("cluster_id", F.coalesce("person_name", "v").alias("person_name"))


@query("usable_clusters", "SELECT DISTINCT CAST(label AS BIGINT) AS cluster_id FROM vectors WHERE label % 3 <> 0", "vectors")
def _(c):
    zero = F.transform("embedding", lambda x: x * F.lit(0.0))
    rows = c.vectors.select(F.col("label").cast("bigint").alias("cluster_id"), F.when(F.col("label") % 3 == 0, zero).otherwise(F.col("embedding")).alias("centroid"))
    return clustering.usable(rows).select("cluster_id").distinct()


@query(
    "error_texts", "SELECT id, substr(decode_error, 1, 12) AS shown FROM files WHERE decode_failed = 1", "files",
)
def _(c):
    return stats.failures(c.files, 1 << 30).select("id", paths.clean_error(F.col("decode_error"), 12).alias("shown"))


@query(
    "durations", "SELECT id, CAST(floor(duration_sec / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(duration_sec) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS shown FROM files WHERE kind = 'video'", "files",
)
def _(c):
    return c.files.where("kind = 'video'").select("id", formats.clock(F.col("duration_sec")).alias("shown"))



@query("local_minutes", "SELECT id, strftime(make_timestamp(CAST(mtime * 100000 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') AS shown FROM files", "files")
def _(c):
    return c.files.select("id", formats.local_minute(F.col("mtime") * 100000).alias("shown"))


@query(
    "downscaled_sizes",
    """WITH s AS (SELECT id, width, height, least(1.0::DOUBLE, sqrt(100000.0::DOUBLE / (CAST(width AS DOUBLE) * height))) AS k FROM files)
        SELECT id, CAST(floor(width * k) AS INT) AS w, CAST(floor(height * k) AS INT) AS h FROM s""",
    "files",
)
def _(c):
    return c.files.select("id", formats.downscaled(F.col("width"), F.col("height"), 100000).alias("s")).select("id", F.col("s.width").alias("w"), F.col("s.height").alias("h"))


@query("repointed", "SELECT id, CASE WHEN id % 5 = 0 THEN '/out/' || regexp_extract(path, '[^/]*$') ELSE path END AS path FROM files", "files")
def _(c):
    """Where files are after copies of some of them."""
    plan = c.files.where("id % 5 = 0").select("id", F.concat(F.lit("/out/"), paths.basename(F.col("path"))).alias("target"))
    return _flags(organise.repoint(c.files, plan), "path")


@query(
    "facet_links",
    """WITH v AS (SELECT DISTINCT 'label' AS facet, label AS value FROM detections UNION ALL SELECT DISTINCT 'camera', camera_model FROM photo_meta
            UNION ALL SELECT DISTINCT 'person', person_name FROM faces UNION ALL SELECT DISTINCT 'country', country FROM photo_meta)
        SELECT facet, value, '?' || facet || '=' || replace(url_encode(value), '%20', '+') || '&k=60' AS link FROM v WHERE value IS NOT NULL""",
    "detections", "photo_meta", "faces",
)
def _(c):
    """A link for everything that the search form offers."""
    found = search.facets(c.photo_meta, c.detections, c.faces)
    of = {facet: F.when(F.col("facet") == facet, F.col("value")) for facet in ("label", "camera", "person", "country")}
    return found.select("facet", "value", search.link(of).alias("link"))


@query(
    "country_names",
    "SELECT name, country, coalesce((SELECT r_name FROM region WHERE substr(r_name, 1, 2) = country AND r_name <> 'ASIA'), country) AS country_name FROM cities",
    "cities",
)
def _(c):
    names = c.source("region").where("r_name <> 'ASIA'").select(F.substring("r_name", 1, 2).alias("code"), F.col("r_name").alias("name"))
    return places.with_country_names(c.cities, names).select("name", "country", "country_name")


ASKED = """CASE s_suppkey % 6 WHEN 0 THEN ', United Kingdom' WHEN 1 THEN ',fr ' WHEN 2 THEN ' usa' WHEN 3 THEN ' , xx' WHEN 4 THEN ' New-Zealand' ELSE '' END"""


@query(
    "places_asked",
    """SELECT s_suppkey AS id, replace(lower(s_name), '-', ' ') || CASE s_suppkey % 6 WHEN 3 THEN ' xx' WHEN 4 THEN ' new zealand' ELSE '' END AS name,
        CASE s_suppkey % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' WHEN 2 THEN 'US' END AS country FROM supplier""",
)
def _(c):
    """The name and the country that each of many queries asks for."""
    asked = c.source("supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.expr(ASKED)).alias("asked"))
    return asked.select("id", geo.place_and_country(F.col("asked"), {"FR", "GB"}).alias("p")).select("id", "p.name", "p.country")


STORED_ROOTS = """CASE n_nationkey % 4 WHEN 0 THEN '["/lib/r1/", "/gone/"]' WHEN 1 THEN '["/gone/"]' WHEN 2 THEN 'no list [' ELSE '["/lib/r3/", "/lib/r2/"]' END"""


@query(
    "roots_in_force",
    """WITH n AS (SELECT '/lib/' || split_part(path, '/', 3) || '/' AS root, count(*) AS n FROM files WHERE missing = 0 GROUP BY 1)
        SELECT n_nationkey AS setting, root, n FROM nation, n WHERE CASE n_nationkey % 4 WHEN 0 THEN root = '/lib/r1/' WHEN 3 THEN root IN ('/lib/r2/', '/lib/r3/') ELSE true END""",
    "files",
)
def _(c):
    """How many files each root has that a stored setting lets through."""
    root = F.concat(F.lit("/lib/"), F.split_part(F.col("path"), F.lit("/"), F.lit(3)), F.lit("/"))
    counts = c.files.where("missing = 0").groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("n"))
    live = counts.agg(F.collect_set("root").alias("live"))  # a row a root
    settings = c.source("nation").select(F.col("n_nationkey").alias("setting"), F.expr(STORED_ROOTS).alias("stored")).join(F.broadcast(live))  # one row
    return settings.select("setting", F.explode(P.roots_in_force(F.col("stored"), F.col("live"))).alias("root")).join(counts, "root")


@query(
    "clusters_written",
    """SELECT CAST(v.label AS BIGINT) AS cluster_id, count(*) AS face_count, coalesce(any_value(k.hidden), 0) AS hidden,
        coalesce(any_value(k.person_name), CASE WHEN count(*) FILTER (v.id % 3 = 0) >= 2 THEN 'P' || v.label END) AS person_name
        FROM vectors v LEFT JOIN face_clusters k ON k.cluster_id = v.label GROUP BY v.label""",
    "vectors", "face_clusters",
)
def _(c):
    """Clusters after all faces got new ones: counts anew, names kept or by majority, clusters without faces gone."""
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("P"), F.col("label").cast("string")))
    faces = c.vectors.select("id", F.col("id").alias("file_id"), F.lit(-1).cast("bigint").alias("cluster_id"), name.alias("person_name"))
    clusters = c.face_clusters.withColumns({"centroid": F.lit(None).cast("array<float>"), "face_count": F.lit(0).cast("bigint")})
    assigned = c.vectors.select("id", F.col("label").cast("bigint").alias("cluster_id"))
    return X.write_clusters(faces, clusters, c.vectors, assigned)["face_clusters"].select("cluster_id", "face_count", "hidden", "person_name")


EPOCH_NAMES = """SELECT CAST(o_orderkey AS BIGINT) AS id, 1000000000000 + (o_orderkey * 7919 % 700000) * 1000000 AS ms FROM orders"""


@query(
    "epoch_names",
    f"SELECT id, CASE WHEN id % 3 < 2 THEN strftime(make_timestamp(CAST(ms * 1000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS inferred FROM ({EPOCH_NAMES})",
)
def _(c):
    """Dates of names that begin with milliseconds since 1970; a digit more, and they aren't."""
    rows = c.source("orders").select(F.col("o_orderkey").cast("bigint").alias("id"))
    ms = F.lit(1000000000000) + (F.col("id") * 7919 % 700000) * 1000000
    end = F.when(F.col("id") % 3 == 0, ".jpg").when(F.col("id") % 3 == 1, "_x.jpg").otherwise("7.jpg")
    return organise.inferred_dates(rows.select("id", F.concat(F.lit("/lib/"), ms.cast("string"), end).alias("path")))
