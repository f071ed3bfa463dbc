"""Changes of the catalog, each a function from old snapshots to new ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import formats
from lumenfold.operators import clustering, people
from lumenfold.schema import FILE_CHILDREN


def replace_by_key(table: DataFrame, rows: DataFrame, key: str, keys: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """``table`` without the keys' old rows, with the new ones. ``keys`` may name more than ``rows`` has, to clear them. ``hint``: how to join the keys, if Spark isn't to choose."""
    gone = (keys if keys is not None else rows).select(F.col(key)).distinct()
    return table.join(gone.hint(hint) if hint else gone, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], insert: bool = False) -> DataFrame:
    """``table`` with the changes' columns where they have the key; with ``insert``, other changes as new rows."""
    new = changes.select(F.col(key).alias("u_key"), *[F.col(c).alias(f"u_{c}") for c in columns])
    rows = table.join(new, F.col(key) == F.col("u_key"), "left")
    hit = F.col("u_key").isNotNull()
    rows = rows.select(*[F.when(hit, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])
    if not insert:
        return rows
    fresh = changes.select(key, *columns).join(table.select(key), key, "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


def set_where(table: DataFrame, condition: Column, **values: object) -> DataFrame:
    """Columns set where a condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    for name, value in values.items():
        table = table.withColumn(name, F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)))
    return table


def set_flag(files: DataFrame, ids: DataFrame, flag: str, value: int = 1, hint: str | None = None) -> DataFrame:
    done = ids.select(F.col("id").alias("f_id")).distinct()
    done = done.hint(hint) if hint else done
    return files.join(done, F.col("id") == F.col("f_id"), "left").withColumn(flag, F.when(F.col("f_id").isNotNull(), value).otherwise(F.col(flag))).select(*files.columns)


def mark_missing(files: DataFrame, ids: DataFrame) -> DataFrame:
    return set_flag(files, ids, "missing")


def delete_files(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Files and all that hangs on them: children by file, vectors of faces and of frames."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    out = {}
    for name, key in {"files": "id", **FILE_CHILDREN}.items():
        if name in tables:
            out[name] = tables[name].join(gone, F.col(key) == F.col("gone"), "left_anti")
    for name, parent in {"vec_faces": "faces", "vec_clip_frames": "frames"}.items():
        if name in tables and parent in tables and "id" in tables[parent].columns:
            children = tables[parent].join(gone, F.col("file_id") == F.col("gone"), "left_semi").select(F.col("id").alias("child"))
            out[name] = tables[name].join(children, F.col("id") == F.col("child"), "left_anti")
    return out


def drop_where(tables: Mapping[str, DataFrame], condition: Column) -> dict[str, DataFrame]:
    """Delete the files that a condition names: small ones, videos, derivatives, a path."""
    return delete_files(tables, tables["files"].where(condition).select("id"))


def tombstone(files: DataFrame, row_id: int, error: str) -> DataFrame:
    return set_where(files, F.col("id") == row_id, decode_failed=1, decode_error=error.replace("\n", " ")[:500])


def clear_failures(files: DataFrame, substring: str | None = None) -> DataFrame:
    return set_where(files, P.failed() & P.path_like(substring), decode_failed=0, decode_error=F.lit(None).cast("string"))


def reset_duplicates(files: DataFrame) -> DataFrame:
    return files.withColumn("dup_of", F.lit(None).cast("bigint"))


def reset_turned(files: DataFrame, sizes: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Files whose stored sides differ from those their orientation gives: their boxes go, stages are open again."""
    real = sizes.select(F.col("id").alias("s_id"), F.col("width").alias("s_w"), F.col("height").alias("s_h"))
    odd = files.join(real, F.col("id") == F.col("s_id")).where((F.col("width") != F.col("s_w")) | (F.col("height") != F.col("s_h"))).select("id")
    marked = odd.select(F.col("id").alias("o_id"))
    hit = F.col("o_id").isNotNull()
    rows = files.join(marked, F.col("id") == F.col("o_id"), "left")
    for name in ("yolo_done", "faces_done", "clip_done", "width", "height"):
        rows = rows.withColumn(name, F.when(hit, 0).otherwise(F.col(name)))
    out = {"files": rows.select(*files.columns)}
    for name, key in {"detections": "file_id", "faces": "file_id", "vec_clip": "id"}.items():
        if name in tables:
            out[name] = tables[name].join(marked, F.col(key) == F.col("o_id"), "left_anti")
    return out


def fill_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Perceptual hashes for the queue; what has none gets the empty text, and isn't asked again."""
    new = hashes.select(F.col("id").alias("h_id"), F.col("phash").alias("h"))
    rows = files.join(new, F.col("id") == F.col("h_id"), "left")
    return rows.withColumn("phash", F.when(P.phash_queue(), F.coalesce("h", F.lit(""))).otherwise(F.col("phash"))).select(*files.columns)


def backfill_dates(files: DataFrame, meta: DataFrame, inferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inferred dates into the metadata, marked as such; rows are added for files without any."""
    changes = inferred.select("file_id", "taken_at").withColumn("date_inferred", F.lit(1))
    new_meta = update(meta, changes, "file_id", ["taken_at", "date_inferred"], insert=True)
    return set_flag(files, inferred.select(F.col("file_id").alias("id")), "meta_done"), new_meta


def geotag(meta: DataFrame, ids: Sequence[int] | DataFrame, lat: float, lon: float, city: str | None = None, region: str | None = None, country: str | None = None) -> DataFrame:
    """A place for files, by insert or update."""
    spark = meta.sparkSession
    rows = ids.select("file_id") if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "file_id long")
    values = {"lat": lat, "lon": lon, "city": city, "region": region, "country": country}
    kinds = dict(meta.dtypes)
    for name, value in values.items():
        rows = rows.withColumn(name, F.lit(value).cast(kinds[name]))
    return update(meta, rows, "file_id", list(values), insert=True)


def store_metadata(meta: DataFrame, files: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole rows of metadata replaced, as an extraction is the truth; inferred dates and tags by hand go with the old row."""
    rows = extracted.withColumn("date_inferred", F.lit(0))
    return replace_by_key(meta, rows, "file_id"), set_flag(files, extracted.select(F.col("file_id").alias("id")), "meta_done")


def rotate(files: DataFrame, row_id: int, delta: int) -> DataFrame:
    return set_where(files, F.col("id") == row_id, rotation=formats.turned(F.col("rotation"), delta))


def accept_rotation(files: DataFrame, row_id: int) -> DataFrame:
    hit = (F.col("id") == row_id) & F.col("rotation_suggested").isNotNull()
    return set_where(set_where(files, hit, rotation=F.col("rotation_suggested")), hit, rotation_suggested=F.lit(None).cast("int"), rotation_suggested_conf=F.lit(None).cast("double"))


def dismiss_rotation(files: DataFrame, row_id: int) -> DataFrame:
    return set_where(files, F.col("id") == row_id, rotation_suggested=F.lit(None).cast("int"), rotation_suggested_conf=F.lit(None).cast("double"))


def record_suggestions(files: DataFrame, found: DataFrame, least: float = 0.9) -> DataFrame:
    """``found``: id, degrees, prob. All are checked; turns with enough confidence become suggestions, and what has none loses an older one."""
    new = found.select(F.col("id").alias("r_id"), F.col("degrees").alias("r_d"), F.col("prob").alias("r_p"))
    rows = files.join(new, F.col("id") == F.col("r_id"), "left")
    sure = F.col("r_id").isNotNull() & (F.col("r_d") != 0) & (F.col("r_p") >= least)
    rows = rows.withColumn("rotation_checked", F.when(F.col("r_id").isNotNull(), 1).otherwise(F.col("rotation_checked")))
    rows = rows.withColumn("rotation_suggested", F.when(sure, F.col("r_d")).when(F.col("r_id").isNull(), F.col("rotation_suggested")).cast("int"))
    return rows.withColumn("rotation_suggested_conf", F.when(sure, F.col("r_p")).when(F.col("r_id").isNull(), F.col("rotation_suggested_conf"))).select(*files.columns)


# Persons and clusters: tables that are small beside the media.


def _next_id(table: DataFrame, column: str = "id") -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def find_person(persons: DataFrame, names: DataFrame, name: str) -> int | None:
    """By a primary name or any epoch's, without regard to case; the lowest id."""
    wanted = name.strip().lower()
    a = persons.where(F.lower("primary_name") == wanted).select("id")
    b = names.where(F.lower("name") == wanted).select(F.col("person_id").alias("id"))
    return a.unionByName(b).agg(F.min("id")).first()[0]


def create_person(persons: DataFrame, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """A person and an epoch without bounds; an existing one of that name is found instead."""
    found = find_person(persons, names, name)
    if found is not None:
        return persons, names, found
    spark, row_id = persons.sparkSession, _next_id(persons)
    person = spark.createDataFrame([(row_id, name.strip())], "id long, primary_name string")
    epoch = spark.createDataFrame([(_next_id(names), row_id, name.strip(), None, None)], "id long, person_id long, name string, start_date string, end_date string")
    return persons.unionByName(person, allowMissingColumns=True), names.unionByName(epoch, allowMissingColumns=True), row_id


def add_epoch(persons, names, faces_clusters, person_id: int, name: str, start: str | None, end: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A name with bounds. Another person of that name is merged in; a row of that name gets the new bounds."""
    other = find_person(persons, names, name)
    if other is not None and other != person_id:
        persons, names, faces_clusters = merge_persons(persons, names, faces_clusters, person_id, other)
    same = (F.col("person_id") == person_id) & (F.lower("name") == name.strip().lower())
    if names.where(same).isEmpty():
        row = names.sparkSession.createDataFrame(
            [(_next_id(names), person_id, name.strip(), start, end)], "id long, person_id long, name string, start_date string, end_date string"
        )
        return persons, names.unionByName(row, allowMissingColumns=True), faces_clusters
    return persons, set_where(names, same, start_date=F.lit(start).cast("string"), end_date=F.lit(end).cast("string")), faces_clusters


def delete_epoch(names: DataFrame, person_id: int, epoch_id: int) -> DataFrame:
    if names.where(F.col("person_id") == person_id).count() <= 1:
        raise ValueError("a person's last name stays")
    return names.where(~((F.col("person_id") == person_id) & (F.col("id") == epoch_id)))


def set_primary(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    return set_where(persons, F.col("id") == person_id, primary_name=name)


def merge_persons(persons, names, clusters, keep: int, drop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One person's names and clusters to another; names that both have stay once."""
    kept = names.where(F.col("person_id") == keep).select(F.lower("name").alias("k"))
    moved = names.where(F.col("person_id") == drop).join(kept, F.lower("name") == F.col("k"), "left_anti").withColumn("person_id", F.lit(keep).cast("bigint"))
    rest = names.where(F.col("person_id") != drop)
    return persons.where(F.col("id") != drop), rest.unionByName(moved), set_where(clusters, F.col("person_id") == drop, person_id=F.lit(keep).cast("bigint"))


def name_cluster(faces, clusters, persons, names, cluster_id: int, name: str) -> dict[str, DataFrame]:
    """A name for a cluster, its faces and a person. No name takes the old one away."""
    hit = F.col("cluster_id") == cluster_id
    if not name.strip():
        none = F.lit(None).cast("string")
        return {"faces": set_where(faces, hit, person_name=none), "face_clusters": set_where(clusters, hit, person_name=none, person_id=F.lit(None).cast("bigint"))}
    persons, names, person = create_person(persons, names, name)
    return {
        "persons": persons, "person_names": names, "faces": set_where(faces, hit, person_name=name.strip()),
        "face_clusters": set_where(clusters, hit, person_name=name.strip(), person_id=F.lit(person).cast("bigint")),
    }


def name_face(faces: DataFrame, face_id: int, name: str) -> DataFrame:
    return set_where(faces, F.col("id") == face_id, person_name=F.lit(name.strip() or None).cast("string"))


def hide_cluster(clusters: DataFrame, cluster_id: int, hidden: int = 1) -> DataFrame:
    return set_where(clusters, F.col("cluster_id") == cluster_id, hidden=hidden)


def merge_clusters(faces: DataFrame, clusters: DataFrame, keep: int, others: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Faces of clusters to one, with its name; person and centroid stay as they were."""
    name = clusters.where(F.col("cluster_id") == keep).select("person_name").first()
    hit = F.col("cluster_id").isin(list(others))
    moved = set_where(faces, hit, cluster_id=F.lit(keep).cast("bigint"))
    if name and name.person_name:
        moved = set_where(moved, F.col("cluster_id") == keep, person_name=name.person_name)
    return moved, clusters.where(~hit | (F.col("cluster_id") == keep))


def refresh_names(faces, meta, clusters, persons, names) -> DataFrame:
    """``faces`` with the name that each person had at the time."""
    found = people.resolve_names(faces, meta, clusters, persons, names).select(F.col("file_id").alias("n_file"), F.col("cluster_id").alias("n_cluster"), F.col("name").alias("n_name"))
    rows = faces.join(found, (F.col("file_id") == F.col("n_file")) & (F.col("cluster_id") == F.col("n_cluster")), "left")
    return rows.withColumn("person_name", F.coalesce("n_name", "person_name")).select(*faces.columns)


def backfill_persons(clusters: DataFrame, persons: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons for clusters' names from before there were persons, one for each name whatever its case."""
    known = persons.select(F.lower("primary_name").alias("k"))
    loose = clusters.where("person_id is null and person_name is not null").groupBy(F.lower("person_name").alias("k")).agg(F.min("person_name").alias("primary_name"))
    loose = loose.join(known, "k", "left_anti")
    from lumenfold.operators.scanning import with_ranks

    # A name's rank, from 1, is its place behind the persons and the names that are there.
    ranked = with_ranks(loose, "k")
    person, epoch = (F.col("rank").cast("bigint") + F.lit(_next_id(t) - 1) for t in (persons, names))
    persons = persons.unionByName(ranked.select(person.alias("id"), "primary_name"), allowMissingColumns=True)
    epochs = ranked.select(epoch.alias("id"), person.alias("person_id"), F.col("primary_name").alias("name"))
    names = names.unionByName(epochs, allowMissingColumns=True)
    ids = persons.groupBy(F.lower("primary_name").alias("k")).agg(F.min("id").alias("p"))
    rows = clusters.join(ids, F.lower("person_name") == F.col("k"), "left").withColumn("person_id", F.coalesce("person_id", "p")).select(*clusters.columns)
    return rows, persons, names


def write_clusters(faces: DataFrame, clusters: DataFrame, vectors: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    """After clustering: faces get their ids, touched centroids are new, empty clusters go, names pass on.

    ``assigned``: id of a face, cluster_id. A cluster without a name takes the commonest of its faces, and
    gives its name to faces that have none.
    """
    rows = update(faces, assigned, "id", ["cluster_id"])
    touched = assigned.select("cluster_id").distinct()
    members = rows.join(touched, "cluster_id", "left_semi").select("id", "cluster_id")
    made = clustering.centroids(vectors, members)
    old = clusters.join(touched, "cluster_id", "left_anti")
    kept = clusters.select("cluster_id", *[c for c in clusters.columns if c not in ("cluster_id", "centroid", "face_count")])
    fresh = made.join(kept, "cluster_id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))
    both = old.unionByName(fresh.withColumn("centroid", F.col("centroid").cast("array<float>")), allowMissingColumns=True)
    live = both.join(rows.select("cluster_id"), "cluster_id", "left_semi")
    votes = people.majority_names(rows).select(F.col("cluster_id").alias("v_id"), F.col("person_name").alias("v_name"))
    named = live.join(votes, F.col("cluster_id") == F.col("v_id"), "left").withColumn("person_name", F.coalesce("person_name", "v_name")).select(*live.columns)
    of = named.where("person_name is not null").select(F.col("cluster_id").alias("c_id"), F.col("person_name").alias("c_name"))
    rows = rows.join(of, F.col("cluster_id") == F.col("c_id"), "left").withColumn("person_name", F.coalesce("person_name", "c_name")).select(*faces.columns)
    return {"faces": rows, "face_clusters": named}


def put_frames(frames: DataFrame, vectors: DataFrame, file_ids: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A video's frames anew: old ones and their vectors go. ``new``: file_id, ts_sec, width, height; equal times come once."""
    gone = file_ids.select(F.col("file_id").alias("g")).distinct()
    old = frames.join(gone, F.col("file_id") == F.col("g"), "left_semi").select(F.col("id").alias("old_id"))
    kept = frames.join(gone, F.col("file_id") == F.col("g"), "left_anti")
    fresh = new.withColumn("ts_sec", F.round("ts_sec", 3)).dropDuplicates(["file_id", "ts_sec"])
    from lumenfold.operators.scanning import with_ranks

    fresh = with_ranks(fresh.withColumn("k", F.struct("file_id", "ts_sec")), "k").withColumn("id", F.col("rank") + F.lit(_next_id(frames) - 1))
    return kept.unionByName(fresh.select(*[c for c in frames.columns if c in fresh.columns]), allowMissingColumns=True), vectors.join(old, F.col("id") == F.col("old_id"), "left_anti")


def purge_orphans(vectors: DataFrame, parents: DataFrame) -> DataFrame:
    return vectors.join(parents.select("id"), "id", "left_semi")
