"""All queries over the media catalog, and the same in DuckDB SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import bits, formats, paths
from lumenfold.functions import vectors as V
from lumenfold.operators import cameras, clustering, density, duplicates, nearest, orientation, organise, people, places, scanning, search, stats, text, textindex, timeline
from lumenfold.plans.projection import Catalog, oracle
from lumenfold.session import checkpointed, shared_dir
from lumenfold.sources import checkpoint_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIS = "missing = 0 AND live_photo_of IS NULL AND dup_of IS NULL"
FM = "files LEFT JOIN photo_meta ON id = file_id"
FMI = "files JOIN photo_meta ON id = file_id"
NEWEST = "taken_at IS NOT NULL DESC, taken_at DESC NULLS LAST, CASE WHEN taken_at IS NULL THEN mtime END DESC NULLS LAST, id DESC"
PAGE_COLUMNS = "id, path, content_hash, kind, live_video_id, rotation, duration_sec, taken_at, mtime"
FOUND_COLUMNS = "id, path, content_hash, kind, live_video_id, rotation, taken_at, camera_model, country"
NAME = "regexp_extract(path, '[^/]*$')"


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function of the catalog, and its SQL over the tables named."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *tables)
        return f

    return add


# The timeline.


@query("timeline_page", f"SELECT {PAGE_COLUMNS} FROM {FM} WHERE {VIS} ORDER BY {NEWEST} LIMIT 60", "files", "photo_meta")
def _(c):
    return timeline.page(c.files, c.photo_meta)


@query("timeline_second_page", f"SELECT {PAGE_COLUMNS} FROM {FM} WHERE {VIS} ORDER BY {NEWEST} LIMIT 60 OFFSET 60", "files", "photo_meta")
def _(c):
    return timeline.page(c.files, c.photo_meta, 1)


@query(
    "timeline_year_months",
    f"SELECT {PAGE_COLUMNS} FROM {FMI} WHERE {VIS} AND taken_at LIKE '1995%' AND substr(taken_at, 6, 2) IN ('03', '11') ORDER BY {NEWEST} LIMIT 120",
    "files", "photo_meta",
)
def _(c):
    return timeline.page_until(c.files, c.photo_meta, 1, year=1995, months=P.parse_months("3, 11, x, 3, 13"))


@query(
    "timeline_roots", f"SELECT {PAGE_COLUMNS} FROM {FM} WHERE {VIS} AND (path ILIKE '/lib/r1/%' OR path ILIKE '/LIB/R3/%') ORDER BY {NEWEST} LIMIT 60", "files", "photo_meta"
)
def _(c):
    return timeline.page(c.files, c.photo_meta, roots=P.effective_roots(["/lib/r1/", "/gone", "/LIB/R3"], ["/LIB/R3", "/lib/r1/"]))


@query("timeline_has_next", f"SELECT count(*) AS total, 120 < count(*) AS has_next FROM {FM} WHERE {VIS}", "files", "photo_meta")
def _(c):
    return timeline.has_next(c.files, c.photo_meta, 1)


@query("timeline_nav_years", "SELECT DISTINCT substr(taken_at, 1, 4) AS \"year\" FROM photo_meta WHERE taken_at IS NOT NULL", "photo_meta")
def _(c):
    return timeline.years(c.photo_meta)


@query("timeline_nav_months", "SELECT DISTINCT substr(taken_at, 6, 2) AS \"month\" FROM photo_meta WHERE taken_at LIKE '1996%'", "photo_meta")
def _(c):
    return timeline.months(c.photo_meta, 1996)


@query(
    "timeline_cursor",
    f"""SELECT id, path, taken_at FROM {FM} WHERE {VIS} AND lat IS NULL
        AND (coalesce(taken_at, '') < '1996-05-01 12:00:00' OR (coalesce(taken_at, '') = '1996-05-01 12:00:00' AND id < 500))
        ORDER BY coalesce(taken_at, '') DESC, id DESC LIMIT 60""",
    "files", "photo_meta",
)
def _(c):
    return timeline.after_cursor(c.files, c.photo_meta, "1996-05-01 12:00:00", 500)


@query(
    "timeline_neighbours",
    f"""WITH k AS (SELECT id, row(taken_at IS NOT NULL, coalesce(taken_at, ''), CASE WHEN taken_at IS NULL THEN mtime ELSE 0 END, id) AS k FROM {FM} WHERE {VIS} OR id = 1001)
        (SELECT 'prev' AS side, id FROM k WHERE k > (SELECT k FROM k WHERE id = 1001) AND id <> 1001 ORDER BY k LIMIT 1)
        UNION ALL (SELECT 'next', id FROM k WHERE k < (SELECT k FROM k WHERE id = 1001) AND id <> 1001 ORDER BY k DESC LIMIT 1)""",
    "files", "photo_meta",
)
def _(c):
    return timeline.neighbours(c.files, c.photo_meta, 1001)


@query(
    "timeline_page_of_photo",
    f"""WITH r AS (SELECT id, substr(taken_at, 1, 7) AS "month", taken_at FROM {FM} WHERE {VIS} AND taken_at IS NOT NULL)
        SELECT s.id AS photo, s."month" AS "month", count(*) FILTER (r.taken_at > s.taken_at) AS newer,
               CAST(floor(count(*) FILTER (r.taken_at > s.taken_at) / 20.0) AS INT) AS page
        FROM r s JOIN r ON r."month" = s."month" WHERE s.id IN (1, 101, 1001, 1500) GROUP BY s.id, s."month" """,
    "files", "photo_meta",
)
def _(c):
    return timeline.page_of_photo(c.files, c.photo_meta, [1, 101, 1001, 1500], 20)


# Counts.


@query(
    "library_stats",
    """SELECT count(*) FILTER (missing = 0) AS files, count(*) FILTER (missing = 0 AND meta_done = 1) AS with_meta,
        count(*) FILTER (missing = 0 AND yolo_done = 1) AS with_objects, count(*) FILTER (missing = 0 AND faces_done = 1) AS with_faces,
        count(*) FILTER (missing = 0 AND clip_done = 1) AS with_vectors, count(*) FILTER (missing <> 0) AS missing,
        count(*) FILTER (decode_failed = 1) AS failed FROM files""",
    "files",
)
def _(c):
    return stats.library(c.files)


@query("date_range", 'SELECT min(taken_at) AS "first", max(taken_at) AS "last" FROM photo_meta', "photo_meta")
def _(c):
    return stats.date_range(c.photo_meta)


@query(
    "top_cameras",
    "SELECT camera_model, count(*) AS n FROM photo_meta WHERE camera_model IS NOT NULL GROUP BY camera_model ORDER BY n DESC, camera_model LIMIT 10",
    "photo_meta",
)
def _(c):
    return stats.top_cameras(c.photo_meta)


@query(
    "about_totals",
    """SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (kind = 'video') AS videos,
        count(*) FILTER (dup_of IS NOT NULL) AS duplicates FROM files WHERE missing = 0""",
    "files",
)
def _(c):
    return stats.totals(c.files)


@query(
    "badges",
    f"""SELECT count(*) FILTER (rotation_suggested IS NOT NULL AND rotation = 0 AND {VIS}) AS pending_rotations,
        count(*) FILTER ({VIS} AND lat IS NULL) AS untagged FROM {FM}""",
    "files", "photo_meta",
)
def _(c):
    return stats.badges(c.files, c.photo_meta)


@query("failures", "SELECT id, path, decode_error FROM files WHERE decode_failed = 1 ORDER BY id LIMIT 50", "files")
def _(c):
    return stats.failures(c.files)


@query("failure_total", "SELECT count(*) AS n FROM files WHERE decode_failed = 1", "files")
def _(c):
    return stats.failure_total(c.files)


@query("inferred_by_year", 'SELECT substr(taken_at, 1, 4) AS "year", count(*) AS n FROM photo_meta WHERE date_inferred = 1 AND taken_at IS NOT NULL GROUP BY 1', "photo_meta")
def _(c):
    return stats.inferred_by_year(c.photo_meta)


@query(
    "video_states",
    """SELECT CASE WHEN f.path IS NULL THEN 'unknown' WHEN decode_failed = 1 THEN 'failed' WHEN meta_done = 0 THEN 'pending' ELSE 'indexed' END AS state, count(*) AS n
        FROM listing l LEFT JOIN files f ON l.path = f.path WHERE regexp_matches(lower(l.path), '\\.(mov|mp4|m4v|avi|mkv)$') GROUP BY 1""",
    "files", "listing",
)
def _(c):
    return stats.video_states(c.listing, c.files)


# Cameras.


@query(
    "camera_summary",
    f"""SELECT camera_make, camera_model, count(*) AS n, min(taken_at) AS first_seen, max(taken_at) AS last_seen,
        CAST(round(count(*) * 100.0 / max(count(*)) OVER ()) AS INT) AS bar
        FROM {FMI} WHERE {VIS} AND camera_model IS NOT NULL GROUP BY camera_make, camera_model""",
    "files", "photo_meta",
)
def _(c):
    return cameras.summary(c.files, c.photo_meta)


@query(
    "camera_photos",
    f"SELECT id, path, taken_at, lens FROM {FMI} WHERE {VIS} AND camera_model = 'BUILDING 1' ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 60",
    "files", "photo_meta",
)
def _(c):
    return cameras.photos(c.files, c.photo_meta, "BUILDING 1")


@query(
    "camera_lens_photos",
    f"SELECT id, path, taken_at, lens FROM {FMI} WHERE {VIS} AND camera_model = 'BUILDING 1' AND lens IS NULL ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 60 OFFSET 60",
    "files", "photo_meta",
)
def _(c):
    return cameras.photos(c.files, c.photo_meta, "BUILDING 1", "", page=1)


@query(
    "lens_groups",
    f"""WITH r AS (
            SELECT camera_model, lens, CASE WHEN lens IS NULL OR lens IN ('', '65535') THEN NULL
                WHEN starts_with(lower(lens), lower(camera_model)) THEN trim(substr(lower(lens), length(camera_model) + 1)) ELSE lower(lens) END AS rest
            FROM {FMI} WHERE {VIS} AND camera_model IS NOT NULL
        ), p AS (
            SELECT camera_model, lens, CASE WHEN rest IS NULL THEN 'unknown' WHEN rest LIKE '%front%' OR rest LIKE '%selfie%' THEN 'front' ELSE 'back' END AS orient,
                   round(TRY_CAST(nullif(regexp_extract(rest, '([0-9]+([.][0-9]+)?) *mm', 1), '') AS DOUBLE), 1) AS focal FROM r
        ), g AS (
            SELECT camera_model, orient, focal, count(*) AS n, coalesce(string_agg(DISTINCT lens, chr(9) ORDER BY lens), '') AS value FROM p GROUP BY ALL
        ), w AS (
            SELECT *, count(*) OVER (PARTITION BY camera_model) AS n_groups,
                   count(*) FILTER (orient = 'back' AND focal IS NOT NULL) OVER (PARTITION BY camera_model) AS n_back,
                   row_number() OVER (PARTITION BY camera_model, orient = 'back' AND focal IS NOT NULL ORDER BY focal NULLS FIRST) AS place FROM g
        )
        SELECT camera_model, orient, focal, n, value, CASE
            WHEN orient = 'unknown' THEN '(no lens info)'
            WHEN orient = 'front' THEN 'Front' || coalesce(' · ' || regexp_replace(CAST(focal AS VARCHAR), '[.]0$', '') || 'mm', '')
            WHEN focal IS NULL THEN 'Back'
            ELSE coalesce(CASE n_back WHEN 1 THEN 'Main' WHEN 2 THEN ['Wide', 'Tele'][place] WHEN 3 THEN ['Ultra wide', 'Main', 'Telephoto'][place]
                WHEN 4 THEN ['Ultra wide', 'Main', 'Tele', 'Telephoto'][place]
                ELSE CASE WHEN place = 1 THEN 'Ultra wide' WHEN place = n_back THEN 'Telephoto' END END, 'Back') || ' · ' || regexp_replace(CAST(focal AS VARCHAR), '[.]0$', '') || 'mm'
            END AS label
        FROM w WHERE n_groups > 1""",
    "files", "photo_meta",
)
def _(c):
    return cameras.lens_groups(c.files, c.photo_meta)


# Search.


def _search_sql(condition: str, join: str = FM) -> str:
    return f"SELECT {FOUND_COLUMNS} FROM {join} WHERE {VIS} AND {condition} ORDER BY taken_at DESC NULLS LAST, id DESC LIMIT 60"


@query("search_label", _search_sql("id IN (SELECT file_id FROM detections WHERE label = 'ECONOMY')"), "files", "photo_meta", "detections")
def _(c):
    return search.run(c, search.Request(label="ECONOMY"))


@query("search_person", _search_sql("id IN (SELECT file_id FROM faces WHERE person_name = 'Supplier#000000007')"), "files", "photo_meta", "faces")
def _(c):
    return search.run(c, search.Request(person="Supplier#000000007"))


@query("search_cluster", _search_sql("id IN (SELECT file_id FROM faces WHERE cluster_id = 5)"), "files", "photo_meta", "faces")
def _(c):
    return search.run(c, search.Request(cluster=5))


@query("search_camera", _search_sql("camera_model = 'MACHINERY 2'", FMI), "files", "photo_meta")
def _(c):
    return search.run(c, search.Request(camera="MACHINERY 2"))


@query("search_country", _search_sql("country = (SELECT min(n_name) FROM nation)", FMI), "files", "photo_meta")
def _(c):
    first = c.source("nation").agg(F.min("n_name")).first()[0]
    return search.run(c, search.Request(country=first))


@query(
    "search_facets",
    """SELECT DISTINCT 'label' AS facet, label AS value FROM detections WHERE label IS NOT NULL
        UNION ALL SELECT DISTINCT 'camera', camera_model FROM photo_meta WHERE camera_model IS NOT NULL
        UNION ALL SELECT DISTINCT 'person', person_name FROM faces WHERE person_name IS NOT NULL
        UNION ALL SELECT DISTINCT 'country', country FROM photo_meta WHERE country IS NOT NULL""",
    "detections", "photo_meta", "faces",
)
def _(c):
    return search.facets(c.photo_meta, c.detections, c.faces)


def _first_vector(c: Catalog) -> list[float]:
    return c.vectors.where("id = 0").first().embedding


L2 = "sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: pow(CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2))))"


@query("knn_topk", f"SELECT v.id AS id, round({L2}, 6) AS distance FROM vectors v, vectors q WHERE q.id = 0 ORDER BY {L2}, v.id LIMIT 20", "vectors")
def _(c):
    return search.nearest(c.vectors, _first_vector(c), 20).select("id", F.round("distance", 6).alias("distance"))


@query(
    "search_vector",
    f"""SELECT {FOUND_COLUMNS}, round(d, 6) AS distance FROM (SELECT v.id AS near_id, {L2} AS d FROM vectors v, vectors q WHERE q.id = 0 ORDER BY d, v.id LIMIT 40) n
        JOIN files ON id = near_id LEFT JOIN photo_meta ON id = file_id WHERE path ILIKE '/lib/r1/%' OR path ILIKE '/lib/r2/%'""",
    "vectors", "files", "photo_meta",
)
def _(c):
    rows = search.by_vector(c.files, c.photo_meta, c.vectors, _first_vector(c), 40, ["/lib/r1", "/lib/r2"])
    return rows.withColumn("distance", F.round("distance", 6))


# Text.

INDEXED = """words AS (
    SELECT file_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM ocr_text),
    docs AS (SELECT file_id, t, len(t) AS n_terms FROM words WHERE len(t) > 0),
    post AS (SELECT file_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM docs)"""


def _index(c: Catalog) -> text.Index:
    return textindex.of_table(c.spark, c.source("documents"), c.ocr_text, shared_dir(c.spark)).index()


def _ids(sql: str) -> str:
    return f"WITH {INDEXED} SELECT DISTINCT file_id FROM ({sql})"


@query("text_and", _ids("SELECT file_id FROM post WHERE term = 'the' INTERSECT SELECT file_id FROM post WHERE term = 'are'"), "ocr_text")
def _(c):
    return text.search(_index(c), "the are").select("file_id")


@query("text_or", _ids("SELECT file_id FROM post WHERE term IN ('nicht', 'avec')"), "ocr_text")
def _(c):
    return text.search(_index(c), "nicht OR avec").select("file_id")


@query(
    "text_not",
    _ids("SELECT file_id FROM (SELECT file_id FROM post WHERE term IN ('der', 'la') EXCEPT SELECT file_id FROM post WHERE term = 'the')"),
    "ocr_text",
)
def _(c):
    return text.search(_index(c), "(der OR la) NOT the").select("file_id")


@query("text_phrase", _ids("SELECT a.file_id FROM post a JOIN post b ON a.file_id = b.file_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"), "ocr_text")
def _(c):
    return text.search(_index(c), '"of the"').select("file_id")


@query("text_prefix", _ids("SELECT file_id FROM post WHERE starts_with(term, 'réeux') OR starts_with(term, 'reeux')"), "ocr_text")
def _(c):
    return text.search(_index(c), "réeux*").select("file_id")


@query("text_malformed", "SELECT CAST(0 AS BIGINT) AS file_id WHERE false", "ocr_text")
def _(c):
    return text.search(_index(c), 'the "of').select("file_id")


@query(
    "text_bm25",
    f"""WITH {INDEXED}, tf AS (SELECT file_id, term, count(*) AS tf FROM post WHERE term IN ('with', 'idiot') GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(n_terms) AS mean FROM docs)
        SELECT file_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6) AS "rank"
        FROM tf JOIN df USING (term) JOIN docs USING (file_id), s GROUP BY file_id ORDER BY "rank", file_id LIMIT 50""",
    "ocr_text",
)
def _(c):
    rows = text.search(_index(c), "with OR idiot").withColumn("rank", F.round("rank", 6))
    return rows.orderBy("rank", "file_id").limit(50)


@query(
    "text_search_visible",
    f"""WITH {INDEXED}, tf AS (SELECT file_id, term, count(*) AS tf FROM post WHERE term IN ('the', 'of') GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(n_terms) AS mean FROM docs),
        hit AS (SELECT file_id AS hit_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 9) AS "rank"
            FROM tf JOIN df USING (term) JOIN docs USING (file_id), s GROUP BY file_id HAVING count(*) = 2)
        SELECT {FOUND_COLUMNS}, "rank" FROM hit JOIN files ON id = hit_id LEFT JOIN photo_meta ON photo_meta.file_id = id
        WHERE {VIS} AND path ILIKE '/lib/r1/%' ORDER BY "rank", id LIMIT 60""",
    "ocr_text", "files", "photo_meta",
)
def _(c):
    return search.by_text(c.files, c.photo_meta, _index(c), "the of", 60, ["/lib/r1"]).withColumn("rank", F.round("rank", 9))


# People.

FACES_OF = f"faces JOIN face_clusters USING (cluster_id) JOIN files ON id = faces.file_id LEFT JOIN photo_meta ON photo_meta.file_id = id WHERE {VIS} AND person_id = 3"


@query(
    "person_stats",
    f"""SELECT count(DISTINCT id) AS photos, count(*) AS faces, count(DISTINCT cluster_id) AS clusters, min(taken_at) AS "first", max(taken_at) AS "last" FROM {FACES_OF}""",
    "faces", "face_clusters", "files", "photo_meta",
)
def _(c):
    return people.stats(c.files, c.photo_meta, c.faces, c.face_clusters, 3)


@query(
    "person_photos",
    f"""SELECT id, path, taken_at FROM {FM} WHERE {VIS} AND id IN (SELECT file_id FROM faces JOIN face_clusters USING (cluster_id) WHERE person_id = 3)
        ORDER BY {NEWEST} LIMIT 60""",
    "faces", "face_clusters", "files", "photo_meta",
)
def _(c):
    return people.photos(c.files, c.photo_meta, c.faces, c.face_clusters, 3)


@query(
    "person_year_faces",
    f"""SELECT "year", file_id, det_score FROM (SELECT substr(taken_at, 1, 4) AS "year", id AS file_id, det_score,
        row_number() OVER (PARTITION BY substr(taken_at, 1, 4) ORDER BY det_score DESC, id) AS rn FROM {FACES_OF} AND taken_at IS NOT NULL) WHERE rn = 1""",
    "faces", "face_clusters", "files", "photo_meta",
)
def _(c):
    return people.best_face_by_year(c.files, c.photo_meta, c.faces, c.face_clusters, 3)


@query("people_counts", "SELECT person_name, count(*) AS n FROM faces WHERE person_name IS NOT NULL GROUP BY person_name", "faces")
def _(c):
    return people.counts(c.faces)


@query("known_names", "SELECT primary_name AS name FROM persons UNION SELECT name FROM person_names", "persons", "person_names")
def _(c):
    return people.known_names(c.persons, c.person_names)


@query("epoch_list", "SELECT id, name, start_date, end_date FROM person_names WHERE person_id = 4", "person_names")
def _(c):
    return people.epochs(c.person_names, 4)


@query(
    "name_epoch_resolution",
    """WITH s AS (SELECT DISTINCT f.file_id, f.cluster_id, person_id, substr(taken_at, 1, 10) AS "day" FROM faces f JOIN face_clusters USING (cluster_id)
            LEFT JOIN photo_meta m ON m.file_id = f.file_id),
        r AS (SELECT s.*, e.name, row_number() OVER (PARTITION BY file_id, cluster_id ORDER BY (start_date IS NOT NULL)::INT + (end_date IS NOT NULL)::INT DESC,
            coalesce(start_date, '') DESC, e.id DESC) AS rn
            FROM s LEFT JOIN person_names e ON e.person_id = s.person_id AND "day" <> '' AND (start_date IS NULL OR start_date <= "day") AND (end_date IS NULL OR end_date >= "day"))
        SELECT file_id, cluster_id, coalesce(name, primary_name) AS name FROM r JOIN persons ON persons.id = person_id WHERE rn = 1""",
    "faces", "face_clusters", "photo_meta", "persons", "person_names",
)
def _(c):
    return people.resolve_names(c.faces, c.photo_meta, c.face_clusters, c.persons, c.person_names)


@query(
    "faces_grid",
    """SELECT cluster_id, count(*) AS face_count, first(f.file_id ORDER BY det_score DESC, f.file_id) AS best_file, any_value(k.person_name) AS person_name
        FROM faces f JOIN face_clusters k USING (cluster_id) JOIN files ON id = f.file_id WHERE missing = 0 AND hidden = 0
        GROUP BY cluster_id ORDER BY face_count DESC, cluster_id LIMIT 48""",
    "faces", "face_clusters", "files",
)
def _(c):
    return people.faces_grid(c.faces, c.face_clusters, c.files)


@query(
    "label_queue",
    """SELECT cluster_id, count(*) AS face_count, min(taken_at) AS "first", max(taken_at) AS "last" FROM faces JOIN face_clusters k USING (cluster_id)
        JOIN files ON id = faces.file_id LEFT JOIN photo_meta m ON m.file_id = id WHERE k.person_name IS NULL AND hidden = 0
        GROUP BY cluster_id HAVING count(*) < 205 OR (count(*) = 205 AND cluster_id > 3) ORDER BY face_count DESC, cluster_id LIMIT 20""",
    "faces", "face_clusters", "files", "photo_meta",
)
def _(c):
    return people.label_queue(c.faces, c.face_clusters, c.files, c.photo_meta, (205, 3))


@query(
    "label_samples",
    """SELECT cluster_id, CAST(place AS INT) AS place, file_id, det_score FROM (SELECT cluster_id, file_id, det_score,
        row_number() OVER (PARTITION BY cluster_id ORDER BY det_score DESC, file_id, x, w) AS place
        FROM faces JOIN face_clusters k USING (cluster_id) WHERE k.person_name IS NULL AND hidden = 0) WHERE place <= 6""",
    "faces", "face_clusters",
)
def _(c):
    return people.label_samples(c.faces, c.face_clusters)


@query(
    "unnamed_count",
    "SELECT count(*) AS n FROM face_clusters WHERE person_name IS NULL AND hidden = 0 AND cluster_id IN (SELECT cluster_id FROM faces)",
    "face_clusters", "faces",
)
def _(c):
    return people.unnamed_count(c.faces, c.face_clusters)


@query(
    "majority_names",
    """SELECT cluster_id, person_name, votes FROM (SELECT cluster_id, person_name, count(*) AS votes,
        row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, person_name) AS rn FROM faces WHERE person_name IS NOT NULL
        GROUP BY cluster_id, person_name HAVING count(*) >= 2) WHERE rn = 1""",
    "faces",
)
def _(c):
    return people.majority_names(c.faces)


@query("empty_clusters", "SELECT cluster_id FROM face_clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM faces)", "face_clusters", "faces")
def _(c):
    return people.empty_clusters(c.face_clusters, c.faces)


# Places.


def _km(lat: float, lon: float) -> str:
    return (
        f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - ({lat})) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - ({lon})) / 2), 2))))"
    )


@query("nearby", f"SELECT id, path, lat, lon, round({_km(48.85, 2.35)}, 6) AS km FROM {FMI} WHERE {VIS} AND lat IS NOT NULL AND {_km(48.85, 2.35)} <= 1500", "files", "photo_meta")
def _(c):
    return places.nearby(c.files, c.photo_meta, 48.85, 2.35, 1500).withColumn("km", F.round("km", 6))


@query(
    "nearby_page",
    f"SELECT id, path, lat, lon, round({_km(48.85, 2.35)}, 6) AS km FROM {FMI} WHERE {VIS} AND lat IS NOT NULL AND {_km(48.85, 2.35)} <= 3000 ORDER BY {_km(48.85, 2.35)}, id LIMIT 20 OFFSET 20",
    "files", "photo_meta",
)
def _(c):
    return places.nearby(c.files, c.photo_meta, 48.85, 2.35, 3000, 20, 20).withColumn("km", F.round("km", 6))


@query("map_points", f"SELECT id, content_hash, lat, lon, taken_at FROM {FMI} WHERE lat IS NOT NULL AND lon IS NOT NULL AND {VIS} AND path ILIKE '/lib/r2/%'", "files", "photo_meta")
def _(c):
    return places.map_points(c.files, c.photo_meta, ("/lib/r2",))


@query(
    "map_grid",
    f"""SELECT CAST(floor(lat / 10) AS BIGINT) AS cell_lat, CAST(floor(lon / 10) AS BIGINT) AS cell_lon, count(*) AS n, min(id) AS first_id
        FROM {FMI} WHERE lat IS NOT NULL AND lon IS NOT NULL AND {VIS} GROUP BY 1, 2""",
    "files", "photo_meta",
)
def _(c):
    return places.map_grid(c.files, c.photo_meta)


@query("untagged_count", f"SELECT count(*) AS n FROM {FM} WHERE {VIS} AND lat IS NULL", "files", "photo_meta")
def _(c):
    return places.untagged_count(c.files, c.photo_meta)


@query(
    "same_day",
    f"SELECT id, taken_at FROM {FMI} WHERE {VIS} AND lat IS NULL AND id <> 4 AND substr(taken_at, 1, 10) = (SELECT substr(taken_at, 1, 10) FROM photo_meta WHERE file_id = 4)",
    "files", "photo_meta",
)
def _(c):
    return places.same_day(c.files, c.photo_meta, 4)


@query("geotag_batch", f"SELECT id, path, taken_at, lat, lon FROM {FM} WHERE id IN (3, 5, 8, 999999999)", "files", "photo_meta")
def _(c):
    return places.by_ids(c.files, c.photo_meta, [3, 5, 8, 999999999])


TILES = f"""geo AS (SELECT id, lat, lon, radians(greatest(-85.05112878, least(85.05112878, lat))) AS r FROM {FMI} WHERE {VIS} AND lat IS NOT NULL AND lon IS NOT NULL),
    cut AS (SELECT id, lat, lon, zoom, CAST(greatest(0, least((1 << zoom) - 1, floor((lon + 180.0) / 360.0 * (1 << zoom)))) AS INT) AS x,
        CAST(greatest(0, least((1 << zoom) - 1, floor((1.0 - ln(tan(r) + 1.0 / cos(r)) / pi()) / 2.0 * (1 << zoom)))) AS INT) AS y FROM geo, (SELECT CAST(unnest(range(0, 15)) AS INT) AS zoom)),
    tiles AS (SELECT zoom, x, y, count(*) AS n, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, min(id) AS first_id FROM cut GROUP BY zoom, x, y)"""


def _rounded(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("lat", F.round("lat", 9)).withColumn("lon", F.round("lon", 9))


@query("map_tiles", f"WITH {TILES} SELECT * FROM tiles", "files", "photo_meta")
def _(c):
    return _rounded(places.map_tiles(c.files, c.photo_meta))


@query(
    "map_markers",
    f"""WITH {TILES} SELECT t.* FROM tiles t LEFT JOIN tiles p ON p.zoom = t.zoom - 1 AND p.x = t.x >> 1 AND p.y = t.y >> 1
        WHERE t.zoom >= 2 AND (t.zoom = 2 OR p.n > 300) AND (t.n <= 300 OR t.zoom = 14)""",
    "files", "photo_meta",
)
def _(c):
    return _rounded(places.map_markers(places.map_tiles(c.files, c.photo_meta), 2, 300))


@query(
    "reverse_geocode",
    """SELECT id, city, region, country, round(km, 6) AS km FROM (SELECT file_id AS id, c.name AS city, c.region AS region, c.country AS country, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(c.lat) - radians(m.lat)) / 2), 2)
        + cos(radians(m.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - m.lon) / 2), 2)))) AS km,
        row_number() OVER (PARTITION BY file_id ORDER BY km, c.name) AS rn FROM photo_meta m, cities c WHERE m.lat IS NOT NULL AND m.lon IS NOT NULL) WHERE rn = 1""",
    "photo_meta", "cities",
)
def _(c):
    points = c.photo_meta.select(F.col("file_id").alias("id"), "lat", "lon")
    return places.reverse_geocode(points, c.cities).withColumn("km", F.round("km", 6))


@query(
    "place_search",
    """WITH b AS (SELECT name, region, country, lat, lon, least(1.0, population / 1e6) AS importance, 0 AS source FROM cities
            UNION ALL SELECT name, kind, '', lat, lon, least(1.0, sitelinks / 40.0), 1 FROM landmarks),
        s AS (SELECT *, CASE WHEN n = 'nation_1' THEN 100 WHEN starts_with(n, 'nation_1') THEN 60 WHEN contains(n, 'nation_1') THEN 30 END AS score
            FROM (SELECT *, replace(lower(name), '-', ' ') AS n FROM b))
        SELECT name, region, country, lat, lon, CAST(score AS INT) AS score, CAST(importance AS DOUBLE) AS importance FROM s WHERE score IS NOT NULL
        ORDER BY score DESC, importance DESC, source, name, lat, lon LIMIT 8""",
    "cities", "landmarks",
)
def _(c):
    return places.place_search("Nation_1", c.cities, c.landmarks)


# Duplicates.

LIVE = "missing = 0 AND too_small = 0 AND dup_of IS NULL"


@query(
    "dup_exact",
    f"""SELECT content_hash AS "key", count(*) AS n, min(id) AS first_id, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE {LIVE} AND coalesce(content_hash, '') <> ''
        GROUP BY content_hash HAVING count(*) > 1""",
    "files",
)
def _(c):
    return duplicates.groups(c.files)


@query(
    "dup_visual",
    f"""SELECT phash AS "key", count(*) AS n, min(id) AS first_id, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE {LIVE} AND coalesce(phash, '') <> '' AND coalesce(kind, 'image') <> 'video'
        GROUP BY phash HAVING count(*) > 1""",
    "files",
)
def _(c):
    return duplicates.groups(c.files, "phash")


@query(
    "dup_summary",
    f"""SELECT count(*) AS "groups", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM files WHERE {LIVE} GROUP BY content_hash HAVING count(*) > 1)""",
    "files",
)
def _(c):
    return duplicates.summary(c.files)


def _keeper_sql(order: str, by: str = "content_hash") -> str:
    return f"""SELECT id, keeper FROM (SELECT id, count(*) OVER (PARTITION BY {by}) AS n, first_value(id) OVER (PARTITION BY {by} ORDER BY
        CASE WHEN lat IS NOT NULL THEN 0 WHEN coalesce(taken_at, '') <> '' THEN 1 ELSE 2 END, {order}, id) AS keeper
        FROM {FM} WHERE {LIVE}) WHERE n > 1"""


for _rule, _order in {"shortest-path": "length(path), path", "longest-path": "length(path) DESC, path DESC", "oldest": "mtime", "newest": "mtime DESC"}.items():

    @query(f"dup_keeper_{_rule.replace('-', '_')}", _keeper_sql(_order), "files", "photo_meta")
    def _(c, rule=_rule):
        return duplicates.keepers(c.files, c.photo_meta, rule=rule)


HASHED = f"""h AS (SELECT id, lower({NAME}) AS name, phash, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo
    FROM files WHERE {LIVE} AND kind <> 'video' AND coalesce(phash, '') <> '')"""


@query(
    "near_pairs",
    f"""WITH {HASHED}, v AS (SELECT name, phash, hi, lo, min(id) AS id FROM h GROUP BY ALL)
        SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INT) AS distance
        FROM v a JOIN v b ON a.name = b.name AND a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12""",
    "files",
)
def _(c):
    return duplicates.near_pairs(c.files)


@query(
    "near_groups",
    f"""WITH {HASHED}, e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.name = b.name AND a.id <> b.id
            WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12),
        reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id)
        SELECT id, min(r) AS group_id FROM reach GROUP BY id""",
    "files",
)
def _(c):
    return duplicates.near_groups(c.files)


@query(
    "phash_siblings",
    """WITH h AS (SELECT id, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM files)
        SELECT b.id AS id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INT) AS distance FROM h a, h b
        WHERE a.id = 12 AND b.id <> 12 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 24""",
    "files",
)
def _(c):
    return duplicates.siblings(c.files, 12, 24)


def _pairable(c: Catalog) -> DataFrame:
    """Files in few folders, so that videos find stills."""
    return c.files.withColumn("path", F.concat(F.lit("/live/"), paths.basename(F.col("path"))))


LIVE_PAIRS = f"""p AS (SELECT id, missing, '/live/' || {NAME} AS path FROM files), s AS (SELECT id, lower(regexp_extract(path, '[.][^.]*$')) AS ext, lower(regexp_replace(path, '[.][^.]*$', '')) AS place FROM p WHERE missing = 0),
    pairs AS (SELECT v.id AS video_id, min(i.id) AS still_id FROM s v JOIN s i ON v.place = i.place WHERE v.ext IN ('.mov', '.mp4', '.m4v') AND i.ext IN ('.heic', '.heif', '.jpg', '.jpeg', '.png') GROUP BY v.id)"""


@query("live_pairs", f"WITH {LIVE_PAIRS} SELECT * FROM pairs", "files")
def _(c):
    return duplicates.live_pairs(_pairable(c))


@query("live_reverse", f"WITH {LIVE_PAIRS} SELECT still_id, min(video_id) AS live_video_id FROM pairs GROUP BY still_id", "files")
def _(c):
    return duplicates.live_reverse(duplicates.live_pairs(_pairable(c)))


# Trees, plans, dates.


def _tree_sql(a: str, b: str) -> str:
    side = "SELECT lower({n}) AS \"key\", min(id) AS i FROM files WHERE missing = 0 AND path ILIKE '%{p}%' GROUP BY 1"
    return f"""SELECT coalesce(x."key", y."key") AS "key", x.i AS a_id, y.i AS b_id, CASE WHEN x.i IS NULL THEN 'b' WHEN y.i IS NULL THEN 'a' ELSE 'both' END AS side
        FROM ({side.format(n=NAME, p=a)}) x FULL JOIN ({side.format(n=NAME, p=b)}) y ON x."key" = y."key" """


@query("compare_trees", _tree_sql("/r1/", "/r2/"), "files")
def _(c):
    return organise.compare(c.files, c.photo_meta, "/r1/", "/r2/")


@query(
    "compare_verdict",
    f"""SELECT count(*) FILTER (side = 'a') AS only_a, count(*) FILTER (side = 'b') AS only_b, count(*) FILTER (side = 'both') AS "both", 'b within a' AS verdict
        FROM ({_tree_sql('/lib/', '/r2/')})""",
    "files",
)
def _(c):
    return organise.verdict(c.files, c.photo_meta, "/lib/", "/r2/")


def _plan_sql(where: str, target: str, join: str = FM) -> str:
    folder = "CASE WHEN taken_at IS NOT NULL THEN replace(substr(taken_at, 1, 10), '-', '/') ELSE 'undated' END"
    return f"""WITH r AS (SELECT id, path, content_hash, size, {folder} AS folder, {NAME} AS name FROM {join} WHERE {where}),
        p AS (SELECT id, path, size, folder, min(content_hash) OVER w <> max(content_hash) OVER w AS clash, content_hash, name FROM r WINDOW w AS (PARTITION BY folder, lower(name))),
        plan AS (SELECT id, path, size, folder, clash, '{target}/' || folder || '/' || CASE WHEN clash THEN
            regexp_replace(name, '[.][^.]*$', '') || '-' || substr(content_hash, 1, 8) || regexp_extract(name, '[.][^.]*$') ELSE name END AS target FROM p)"""


COLLATE = _plan_sql("dup_of IS NULL AND missing = 0 AND content_hash <> ''", "/out")


@query("collate_plan", f"{COLLATE} SELECT * FROM plan", "files", "photo_meta")
def _(c):
    return organise.collate_plan(c.files, c.photo_meta, "/out")


@query(
    "collate_summary",
    f"{COLLATE} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (folder = 'undated') AS undated, count(*) FILTER (clash) AS renamed FROM plan",
    "files", "photo_meta",
)
def _(c):
    return organise.plan_summary(organise.collate_plan(c.files, c.photo_meta, "/out"))


@query("collision_groups", f"{COLLATE} SELECT folder, lower({NAME}) AS name, count(*) AS n FROM plan WHERE clash GROUP BY 1, 2", "files", "photo_meta")
def _(c):
    return organise.collisions(organise.collate_plan(c.files, c.photo_meta, "/out"))


@query(
    "export_plan",
    _plan_sql(
        "missing = 0 AND dup_of IS NULL AND content_hash <> '' AND kind = 'image' AND camera_model ILIKE '%building%' AND taken_at < '1997' AND taken_at >= '1993-06' "
        "AND id IN (SELECT file_id FROM faces WHERE person_name = 'Supplier#000000007')",
        "/ex",
    )
    + " SELECT * FROM plan",
    "files", "photo_meta", "faces",
)
def _(c):
    return organise.export_plan(c.files, c.photo_meta, "/ex", "building", "1997", "1993-06", "Supplier#000000007", c.faces)


@query(
    "infer_dates",
    """WITH n AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS name FROM dated_paths),
        x AS (SELECT id, regexp_extract(name, '(^|[^0-9])((19|20)[0-9]{6})_([0-9]{6})([^0-9]|$)', 2) AS c, regexp_extract(name, '(^|[^0-9])((19|20)[0-9]{6})_([0-9]{6})([^0-9]|$)', 4) AS t,
            regexp_extract(name, '(^|[^0-9])((19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})([^0-9]|$)', 2) AS dash, regexp_extract(path, '/((19|20)[0-9]{2}/[0-9]{2}/[0-9]{2})/', 1) AS ymd,
            regexp_extract(path, 'March ([0-9]{1,2}), ((19|20)[0-9]{2})', 2) AS my, regexp_extract(path, 'March ([0-9]{1,2}), ((19|20)[0-9]{2})', 1) AS md,
            regexp_extract(path, '/((19|20)[0-9]{2}/[0-9]{2})/', 1) AS ym, regexp_extract(path, 'Aug ((19|20)[0-9]{2})', 1) AS aug FROM n)
        SELECT id, CASE
            WHEN c <> '' THEN substr(c, 1, 4) || '-' || substr(c, 5, 2) || '-' || substr(c, 7, 2) || ' ' ||
                CASE WHEN substr(t, 1, 2) < '24' THEN substr(t, 1, 2) || ':' || substr(t, 3, 2) || ':' || substr(t, 5, 2) ELSE '12:00:00' END
            WHEN dash <> '' THEN dash || ' 12:00:00' WHEN ymd <> '' THEN replace(ymd, '/', '-') || ' 12:00:00'
            WHEN my <> '' THEN my || '-03-' || lpad(md, 2, '0') || ' 12:00:00' WHEN ym <> '' THEN replace(ym, '/', '-') || '-01 12:00:00'
            WHEN aug <> '' THEN aug || '-08-01 12:00:00' END AS inferred FROM x""",
    "dated_paths",
)
def _(c):
    return organise.inferred_dates(c.dated_paths)


@query(
    "backfill_dates",
    """SELECT file_id, regexp_replace(regexp_extract(path, '/((19|20)[0-9]{2}/[0-9]{2}/[0-9]{2})/', 1), '/', '-', 'g') || ' 12:00:00' AS taken_at
        FROM files JOIN photo_meta ON id = file_id WHERE missing = 0 AND meta_done = 1 AND taken_at IS NULL""",
    "files", "photo_meta",
)
def _(c):
    return organise.backfill(c.files, c.photo_meta)


# Scans and queues.

CLASSIFY = """k AS (SELECT l.path, l.size, l.mtime, l.content_hash, f.id, CASE WHEN f.path IS NULL THEN NULL
        WHEN f.size = l.size AND f.mtime = l.mtime THEN CASE WHEN f.too_small = 1 THEN 'skipped_small' ELSE 'unchanged' END ELSE 'changed' END AS state
    FROM listing l LEFT JOIN files f ON l.path = f.path),
    fresh AS (SELECT k.*, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rn,
        (SELECT min(id) FROM files f WHERE f.content_hash = k.content_hash AND missing = 0) AS live_id,
        (SELECT min(id) FROM files f WHERE f.content_hash = k.content_hash AND missing = 1) AS lost_id FROM k WHERE state IS NULL),
    classified AS (SELECT path, id AS file_id, state FROM k WHERE state IS NOT NULL UNION ALL
        SELECT path, CASE WHEN live_id IS NOT NULL THEN live_id WHEN rn = 1 THEN lost_id END,
            CASE WHEN live_id IS NOT NULL OR rn > 1 THEN 'dedup_skipped' WHEN lost_id IS NOT NULL THEN 'moved' ELSE 'new' END FROM fresh)"""


def _classified(c: Catalog) -> DataFrame:
    return scanning.classify(c.listing, c.files)


@query("scan_diff", f"WITH {CLASSIFY} SELECT path, file_id, state FROM classified", "files", "listing")
def _(c):
    return _classified(c).select("path", "file_id", "state")


@query("scan_counters", f"WITH {CLASSIFY} SELECT state, count(*) AS n FROM classified GROUP BY state", "files", "listing")
def _(c):
    return scanning.counters(_classified(c))


@query(
    "prune_set",
    f"""WITH {CLASSIFY} SELECT id, path FROM files WHERE missing = 0 AND path NOT IN (SELECT path FROM classified)
        AND id NOT IN (SELECT file_id FROM classified WHERE state = 'dedup_skipped' AND file_id IS NOT NULL) AND path NOT ILIKE '/lib/r4/%'""",
    "files", "listing",
)
def _(c):
    return scanning.prune_set(c.files, _classified(c), ["/lib/r4"])


@query("check_missing", "SELECT id, path FROM files WHERE missing = 0 AND path NOT IN (SELECT path FROM listing)", "files", "listing")
def _(c):
    return scanning.check_missing(c.files, c.listing)


def _queue(name: str, condition: str, make) -> None:
    query(name, f"SELECT id FROM files WHERE {condition}", "files")(lambda c: c.files.where(make()).select("id"))


READABLE = "missing = 0 AND too_small = 0 AND decode_failed = 0 AND content_hash <> ''"
_queue(
    "work_queue", "missing = 0 AND decode_failed = 0 AND too_small = 0 AND live_photo_of IS NULL AND (yolo_done = 0 OR faces_done = 0 OR clip_done = 0 OR meta_done = 0)", P.work_queue
)
_queue("work_queue_meta_only", "missing = 0 AND decode_failed = 0 AND too_small = 0 AND live_photo_of IS NULL AND meta_done = 0", lambda: P.work_queue(["meta"]))
_queue("ocr_queue", f"{READABLE} AND dup_of IS NULL AND ocr_done = 0 AND path ILIKE '%img_0001%'", lambda: P.ocr_queue(substring="img_0001"))
_queue("readability_queue", f"{READABLE} AND kind = 'video'", lambda: P.readability_queue("video"))
_queue("phash_queue", "missing = 0 AND too_small = 0 AND phash IS NULL AND dup_of IS NULL AND content_hash <> '' AND kind <> 'video'", P.phash_queue)
_queue("rotation_queue", f"{VIS} AND kind = 'image' AND rotation = 0 AND content_hash <> '' AND rotation_checked = 0", P.rotation_queue)
_queue("small_files", "missing = 0 AND width > 0 AND height > 0 AND width < 320 AND height < 320", P.small)
_queue("video_files", "lower(path) LIKE '%.mov' OR lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.m4v' OR lower(path) LIKE '%.avi' OR lower(path) LIKE '%.mkv'", P.is_video_path)
_queue("prune_path", "path ILIKE '%IMG_0_01%'", lambda: P.path_like("IMG_0_01"))


@query(
    "pending_rotations",
    f"""SELECT id, rotation_suggested, rotation_suggested_conf FROM files WHERE rotation_suggested IS NOT NULL AND rotation = 0 AND {VIS}
        ORDER BY rotation_suggested_conf DESC, id LIMIT 200""",
    "files",
)
def _(c):
    rows = c.files.where(P.pending_rotation()).orderBy(F.desc("rotation_suggested_conf"), "id").limit(200)
    return rows.select("id", "rotation_suggested", "rotation_suggested_conf")


@query("resolve_target", "SELECT id, path, CAST(4 AS INT) AS \"rule\" FROM files WHERE path ILIKE '%roll12/%' ORDER BY id LIMIT 1", "files")
def _(c):
    return scanning.resolve_target(c.files, "roll12/")


@query(
    "last_in_flight",
    """SELECT file_id, max(line_no) AS line_no FROM checkpoint_log l WHERE event = 'start' AND NOT EXISTS
        (SELECT 1 FROM checkpoint_log d WHERE d.file_id = l.file_id AND d.event = 'done' AND d.line_no > l.line_no) GROUP BY file_id ORDER BY line_no DESC LIMIT 1""",
    "checkpoint_log",
)
def _(c):
    return checkpoint_log.last_in_flight(c.checkpoint_log)


@query("log_levels", "SELECT event, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM checkpoint_log GROUP BY event", "checkpoint_log")
def _(c):
    return checkpoint_log.levels(c.checkpoint_log)


# Expressions.


@query(
    "frame_schedule",
    """WITH v AS (SELECT id, duration_sec AS d FROM files WHERE kind = 'video'),
        e AS (SELECT id, list_concat(range(0, CAST(least(ceil(d), 60) AS BIGINT)), list_transform(range(0, CAST(greatest(ceil((d - 60) / 10), 0) AS BIGINT)), lambda i: 60 + i * 10)) AS f, d FROM v),
        t AS (SELECT id, d, CASE WHEN d IS NULL OR d <= 0 THEN [1] WHEN len(f) > 600 THEN list_slice(list_concat(list_slice(f, 1, 300),
            list_filter(list_slice(f, 301, len(f)), lambda x, i: (i - 1) % greatest(1, (len(f) - 300) // 300) = 0)), 1, 600) ELSE f END AS f FROM e)
        SELECT id, len(f) AS n, CAST(f[1] AS DOUBLE) AS "first", CAST(f[len(f)] AS DOUBLE) AS "last", CAST(list_sum(f) AS DOUBLE) AS total FROM t""",
    "files",
)
def _(c):
    rows = c.files.where("kind = 'video'").select("id", formats.frame_schedule(F.col("duration_sec")).alias("f"))
    return rows.select(
        "id", F.size("f").cast("bigint").alias("n"), F.element_at("f", 1).alias("first"), F.element_at("f", -1).alias("last"), V.total(F.col("f")).alias("total")
    )


@query(
    "boxes_turned",
    """SELECT file_id, round(bx, 6) AS x, round(by_, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, count(*) AS n FROM (
        SELECT file_id, 1 - (y - h / 2 + h) AS bx, x - w / 2 AS by_, h AS w, w AS h FROM detections) GROUP BY ALL""",
    "detections",
)
def _(c):
    corner = formats.top_left(F.lit("det"), *[F.col(k) for k in "xywh"])
    turned = formats.turn_box(F.lit(-270), corner["x"], corner["y"], corner["w"], corner["h"])
    rows = c.detections.select("file_id", turned.alias("b")).select("file_id", *[F.round(f"b.{k}", 6).alias(k) for k in "xywh"])
    return rows.groupBy("file_id", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n"))


@query(
    "face_crop_rect",
    """WITH r AS (SELECT f.file_id, greatest(0, CAST(trunc(f.x * width - f.w * width * 0.4) AS INT)) AS "left", greatest(0, CAST(trunc(f.y * height - f.h * height * 0.4) AS INT)) AS top,
            least(width, CAST(trunc((f.x + f.w) * width + f.w * width * 0.4) AS INT)) AS "right", least(height, CAST(trunc((f.y + f.h) * height + f.h * height * 0.4) AS INT)) AS bottom
            FROM faces f JOIN files ON id = f.file_id) SELECT *, count(*) AS n FROM r GROUP BY ALL""",
    "faces", "files",
)
def _(c):
    rows = c.faces.join(c.files.select("id", "width", "height"), F.col("file_id") == F.col("id"))
    rect = formats.crop_rect(*[F.col(k) for k in ("x", "y", "w", "h", "width", "height")])
    return rows.select("file_id", rect.alias("r")).select("file_id", "r.*").groupBy("file_id", "left", "top", "right", "bottom").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rotation_algebra",
    """SELECT rotation, d, CAST((rotation + d + 720) % 360 AS INT) AS turned, count(*) AS n FROM files, (SELECT unnest([-90, 90, 270]) AS d) GROUP BY 1, 2, 3""",
    "files",
)
def _(c):
    rows = c.files.withColumn("d", F.explode(F.array(F.lit(-90), F.lit(90), F.lit(270))))
    return rows.groupBy("rotation", "d", formats.turned(F.col("rotation"), F.col("d")).alias("turned")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "human_sizes",
    """SELECT id, CASE WHEN size * 1000 >= 1048576 THEN printf('%.1f MB', size * 1000 / 1048576.0) WHEN size * 1000 >= 1024 THEN printf('%.1f KB', size * 1000 / 1024.0)
        ELSE printf('%d B', size * 1000) END AS shown FROM files""",
    "files",
)
def _(c):
    return c.files.select("id", formats.human_bytes(F.col("size") * 1000).alias("shown"))


@query(
    "path_parts",
    f"""SELECT id, lower({NAME}) AS name, regexp_replace({NAME}, '[.][^.]*$', '') AS stem, lower(regexp_extract(path, '[.][^.]*$')) AS ext,
        regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN path LIKE '%.MOV' THEN 'video' ELSE 'image' END AS kind,
        CASE WHEN path LIKE '%.MOV' THEN 'video/quicktime' WHEN path LIKE '%.HEIC' THEN 'image/heic' ELSE 'image/jpeg' END AS mime FROM files""",
    "files",
)
def _(c):
    p = F.col("path")
    return c.files.select(
        "id", F.lower(paths.basename(p)).alias("name"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), paths.directory(p).alias("folder"),
        paths.kind_of(p).alias("kind"), paths.mime_of(p).alias("mime"),
    )


# Vectors.

MEMBERS = "m AS (SELECT id, CAST(label AS BIGINT) AS cluster_id, embedding FROM vectors)"
UNITS = f"""{MEMBERS}, x AS (SELECT id, cluster_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM m),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id), u AS (SELECT id, cluster_id, i, x / n AS x FROM x JOIN n USING (id)),
    mean AS (SELECT cluster_id, i, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL), size AS (SELECT cluster_id, sqrt(sum(x * x)) AS s, max(n) AS n FROM mean GROUP BY ALL),
    c AS (SELECT cluster_id, i, x / s AS x, size.n AS face_count FROM mean JOIN size USING (cluster_id))"""


def _members(c: Catalog) -> DataFrame:
    return c.vectors.select("id", F.col("label").cast("bigint").alias("cluster_id"))


@query("centroids", f"WITH {UNITS} SELECT cluster_id, face_count, CAST(i AS INT) AS i, round(x, 6) AS x FROM c", "vectors")
def _(c):
    rows = clustering.centroids(c.vectors, _members(c))
    return rows.select("cluster_id", "face_count", F.posexplode("centroid").alias("i", "x")).select("cluster_id", "face_count", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


NEAREST_SQL = f"""WITH {UNITS}, d AS (SELECT u.id, c.cluster_id, sqrt(greatest(0, 2 - 2 * sum(u.x * c.x))) AS d FROM u JOIN c ON u.i = c.i GROUP BY u.id, c.cluster_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) AS rn FROM d)
        SELECT id, cluster_id, round(d, 5) AS distance FROM r WHERE rn = 1 AND d < 1.2"""


@query("centroid_assign", NEAREST_SQL, "vectors")
def _(c):
    made = clustering.centroids(c.vectors, _members(c))
    return clustering.assign(c.vectors, made, 1.2).withColumn("distance", F.round("distance", 5))


@query("centroid_search", NEAREST_SQL, "vectors")
def _(c):
    made = clustering.usable(clustering.centroids(c.vectors, _members(c)))
    return nearest.search(c.vectors, made, 1.2).withColumn("distance", F.round("distance", 5))


@query("orphan_vectors", "SELECT id FROM vectors WHERE id NOT IN (SELECT file_id FROM faces)", "vectors", "faces")
def _(c):
    return clustering.orphans(c.vectors, c.faces, "file_id")


def _density_sql(source: str, m: int = 3) -> str:
    """CTEs over ``source`` (id, embedding): ``core``, ``tree`` and ``found`` (id, label), as density clustering has them.

    The tree is grown from the first vector. What is joined at some distance then is a run in the order of growth, so the runs between longer edges
    are the nodes of the tree of merges; their sums are made from the shortest distance up.
    """
    excess = "(c.mass - c.size * level)"
    inside = f"(c.branched AND c.inn > {excess})"
    return f"""
    v0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM {source}),
    p AS MATERIALIZED (SELECT i, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v0),
    d AS MATERIALIZED (SELECT a.i AS a, b.i AS b, CASE WHEN a.i = b.i THEN 0 ELSE round(list_distance(a.v, b.v), 9) END AS d FROM p a CROSS JOIN p b),
    core AS MATERIALIZED (SELECT a, list_sort(list(d))[{m}] AS core FROM d GROUP BY a),
    w AS MATERIALIZED (SELECT d.a, d.b, CASE WHEN d.a = d.b THEN NULL ELSE greatest(d, x.core, y.core) END AS w FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b),
    grown AS (
        SELECT 0 AS k, i AS b, i = 1 AS inside, CASE WHEN i > 1 THEN w END AS link, 1::BIGINT AS last, NULL::DOUBLE AS edge FROM p JOIN w ON w.a = 1 AND w.b = i
        UNION ALL
        SELECT g.k + 1, g.b, g.inside OR g.b = g.next, CASE WHEN g.inside OR g.b = g.next THEN NULL ELSE least(g.link, w.w) END, g.next, g.least
        FROM (SELECT *, arg_min(b, link) OVER () AS next, min(link) OVER () AS least FROM grown WHERE k < (SELECT count(*) FROM p) - 1) g JOIN w ON w.a = g.next AND w.b = g.b
    ),
    tree AS MATERIALIZED (SELECT DISTINCT k, last AS i, edge AS w FROM grown),
    runs AS MATERIALIZED (SELECT DISTINCT coalesce((SELECT max(y.k) FROM tree y WHERE y.k < x.k AND y.w > x.w), 0) AS l,
        coalesce((SELECT min(y.k) FROM tree y WHERE y.k > x.k AND y.w > x.w), (SELECT count(*) FROM p)) - 1 AS r, w FROM tree x WHERE k > 0),
    nodes AS MATERIALIZED (SELECT x.l, x.r, x.r - x.l + 1 AS size, CASE WHEN x.w > 0 THEN 1 / x.w ELSE 1e12 END AS level, dense_rank() OVER (ORDER BY x.w) AS k,
        (SELECT arg_min(struct_pack(l := y.l, r := y.r), y.r - y.l) FROM runs y WHERE y.l <= x.l AND y.r >= x.r AND y.r - y.l > x.r - x.l) AS up FROM runs x),
    summed AS (
        SELECT 0::BIGINT AS step, l, r, size, level, k, up, 0::DOUBLE AS mass, 0::DOUBLE AS inn, false AS branched, false AS stays FROM nodes
        UNION ALL
        SELECT s.step + 1, s.l, s.r, s.size, s.level, s.k, s.up,
            CASE WHEN s.k <> s.step + 1 THEN s.mass WHEN g.n = 1 THEN g.mass + (s.size - g.size) * s.level WHEN s.size >= {m} THEN s.size * s.level ELSE 0 END,
            CASE WHEN s.k <> s.step + 1 THEN s.inn WHEN g.n = 1 THEN g.inn WHEN g.n > 1 THEN g.value ELSE 0 END,
            CASE WHEN s.k <> s.step + 1 THEN s.branched WHEN g.n = 1 THEN g.branched ELSE coalesce(g.n > 1, false) END,
            s.stays OR coalesce(h.n > 1 AND h.k = s.step + 1 AND s.size >= {m} AND NOT (s.branched AND s.inn > s.mass - s.size * h.level), false)
        FROM summed s
        LEFT JOIN (SELECT c.up, count(*) AS n, max(c.mass) AS mass, max(c.size) AS size, max(c.inn) AS inn, bool_or(c.branched) AS branched,
            sum(CASE WHEN {inside.replace("level", "u.level")} THEN c.inn ELSE {excess.replace("level", "u.level")} END) AS value
            FROM summed c JOIN nodes u ON u.l = c.up.l AND u.r = c.up.r WHERE c.size >= {m} GROUP BY c.up) g ON g.up.l = s.l AND g.up.r = s.r
        LEFT JOIN (SELECT u.l, u.r, u.k, u.level, count(*) AS n FROM nodes c JOIN nodes u ON u.l = c.up.l AND u.r = c.up.r WHERE c.size >= {m} GROUP BY ALL) h ON h.l = s.up.l AND h.r = s.up.r
        WHERE s.step < (SELECT max(k) FROM nodes)
    ),
    found AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY l, r) AS label FROM (
        SELECT id, l, r, row_number() OVER (PARTITION BY id ORDER BY size DESC) AS rn FROM tree JOIN p USING (i) JOIN summed s ON tree.k BETWEEN s.l AND s.r
        WHERE s.stays AND s.step = (SELECT max(k) FROM nodes)) WHERE rn = 1)"""


@query(
    "perceptual_hashes",
    """WITH x AS (SELECT id, (generate_subscripts(embedding, 1) - 1) // 8 AS r, (generate_subscripts(embedding, 1) - 1) % 8 AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors),
        k AS (SELECT u, i, cos(pi() * u * (2 * i + 1) / 16) AS k FROM range(8) a(u), range(8) b(i)),
        t AS (SELECT id, u, c, sum(k * x) AS t FROM x JOIN k ON k.i = r GROUP BY ALL), low AS (SELECT id, t.u, k.u AS v, sum(k * t) AS w FROM t JOIN k ON k.i = c GROUP BY ALL),
        m AS (SELECT id, median(w) AS m FROM low GROUP BY id)
        SELECT id, string_agg(format('{:x}', n), '' ORDER BY part) AS phash FROM (
            SELECT id, (u * 8 + v) // 4 AS part, CAST(sum(CASE WHEN w > m THEN 1 << (3 - v % 4) ELSE 0 END) AS BIGINT) AS n FROM low JOIN m USING (id) GROUP BY ALL) GROUP BY id""",
    "vectors",
)
def _(c):
    return c.vectors.select("id", bits.perceptual_hash(F.col("embedding")).alias("phash"))


@query(
    "orientation_turns",
    """WITH x AS (SELECT id, (generate_subscripts(embedding, 1) - 1) // 8 AS r, (generate_subscripts(embedding, 1) - 1) % 8 AS c, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM vectors),
        t AS (SELECT id, turn, x, CASE turn WHEN 0 THEN 8 * r + c WHEN 1 THEN 8 * (7 - c) + r WHEN 2 THEN 8 * (7 - r) + 7 - c ELSE 8 * c + 7 - r END AS place FROM x, range(4) k(turn))
        SELECT id, CAST(turn AS INT) AS turn, CAST(sum((place + 1) * (place + 3) * x) AS BIGINT) AS weighed FROM t GROUP BY ALL""",
    "vectors",
)
def _(c):
    turned = orientation.all_turns(c.vectors.select("id", F.col("embedding").alias("image")))
    weighed = F.aggregate(F.transform("image", lambda x, p: (p + 1) * (p + 3) * F.floor(x * 1024)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return turned.select("id", "turn", weighed.alias("weighed"))


def _upright(c):
    """Vectors as pictures of eight values a side."""
    return c.vectors.select("id", F.col("embedding").alias("image"))


HELD_OUT = "crc32(CAST(id AS STRING)) % 5 = 0"


@query("orientation_quality")
def _(c):
    """Trained on four fifths of all pictures, asked about all turns of the others."""
    model = orientation.train(_upright(c).where(f"NOT ({HELD_OUT})"), fewest=1)
    return orientation.quality(model, _upright(c).where(HELD_OUT))


@query("orientation_suggestions")
def _(c):
    """Files that nobody has looked at yet, on their side where their number says so."""
    model = orientation.train(_upright(c).join(orientation.upright(c.files), "id", "left_semi"), fewest=1)
    turned = _upright(c).select("id", orientation.quarter_turns(F.col("image").cast("array<double>"), F.col("id") % 4).alias("image"))
    return orientation.suggestions(model, c.files, turned).select("id", "degrees", F.round("prob", 4).alias("prob"))


@query("density_cores", f"WITH {_density_sql('vectors')} SELECT id, round(core, 6) AS core FROM core JOIN p ON a = i", "vectors")
def _(c):
    return density.cores(density.points_of(c.vectors), clustering.MIN_CLUSTER).select(F.col("p").alias("id"), F.round("core", 6).alias("core"))


@query("density_tree", f"WITH {_density_sql('vectors')} SELECT round(w, 6) AS w, count(*) AS n FROM tree WHERE k > 0 GROUP BY 1", "vectors")
def _(c):
    tree = density.spanning_tree(checkpointed(density.points_of(c.vectors)), clustering.MIN_CLUSTER, block=64)
    return tree.groupBy(F.round("w", 6).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("cluster_full", f"WITH {_density_sql('vectors')} SELECT id, dense_rank() OVER (ORDER BY label) AS cluster_id FROM found", "vectors")
def _(c):
    return clustering.full(c.vectors)


@query(
    "cluster_incremental",
    f"""WITH {UNITS}, apart AS MATERIALIZED (SELECT u.id, c.cluster_id, sqrt(greatest(0, 2 - 2 * sum(u.x * c.x))) AS d FROM u JOIN c ON u.i = c.i GROUP BY u.id, c.cluster_id),
        near AS MATERIALIZED (SELECT id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) AS rn FROM apart) WHERE rn = 1 AND d < 0.9),
        left_over AS MATERIALIZED (SELECT id, embedding FROM vectors WHERE id NOT IN (SELECT id FROM near)), {_density_sql("left_over")},
        fm AS (SELECT label, u.i, avg(x) AS x FROM found JOIN u USING (id) GROUP BY ALL), fs AS (SELECT label, sqrt(sum(x * x)) AS s FROM fm GROUP BY label),
        fd AS (SELECT fm.label, c.cluster_id, sqrt(greatest(0, 2 - 2 * sum(fm.x / s * c.x))) AS d FROM fm JOIN fs USING (label) JOIN c ON c.i = fm.i GROUP BY fm.label, c.cluster_id),
        joined AS (SELECT label, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, cluster_id) AS rn FROM fd) WHERE rn = 1 AND d < 0.9),
        fresh AS (SELECT label, (SELECT max(cluster_id) FROM c) + row_number() OVER (ORDER BY label) AS cluster_id FROM fs WHERE label NOT IN (SELECT label FROM joined))
        SELECT id, cluster_id FROM near UNION ALL SELECT id, cluster_id FROM found JOIN (SELECT * FROM joined UNION ALL SELECT * FROM fresh) USING (label)""",
    "vectors",
)
def _(c):
    made = clustering.centroids(c.vectors, _members(c))
    return clustering.incremental(c.vectors, made, below=0.9)


@query(
    "stratified_sample",
    """WITH y AS (SELECT file_id, substr(taken_at, 1, 4) AS "year", md5('7:' || file_id) AS h FROM photo_meta WHERE taken_at IS NOT NULL)
        SELECT "year", file_id FROM (SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY h, file_id) AS rn FROM y) WHERE rn <= 100""",
    "photo_meta",
)
def _(c):
    from lumenfold.sources.sampling import by_year

    return by_year(c.photo_meta, samples=300, seed=7)
