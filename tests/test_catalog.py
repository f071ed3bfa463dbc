import pytest
from pyspark.sql import functions as F

from lumenfold.catalog import Catalog, Conflict
from lumenfold.operators import clustering, duplicates, nearest, organise, people, places, scanning, text
from lumenfold.operators import transitions as X
from lumenfold.schema import conform, ddl


def files(spark, *rows):
    """Rows of dicts as a files table."""
    base = {"size": 10, "mtime": 1.0, "content_hash": "h", "kind": "image", "missing": 0, "too_small": 0}
    full = [{"id": i, **base, **r} for i, r in enumerate(rows, 1)]
    names = sorted({k for r in full for k in r})
    from lumenfold.schema import TABLES

    kinds = {n: k for n, k, _ in TABLES["files"]}
    data = [tuple(r.get(n) for n in names) for r in full]
    return conform(spark.createDataFrame(data, ", ".join(f"{n} {kinds[n]}" for n in names)), "files")


def meta(spark, *rows):
    from lumenfold.schema import TABLES

    kinds = {n: k for n, k, _ in TABLES["photo_meta"]}
    names = sorted({k for r in rows for k in r} | {"file_id"})
    return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names)), "photo_meta")


def test_store(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert c.version == 0 and c["files"].count() == 0
    c.commit({"files": files(spark, {"path": "/a.jpg"})})
    other = Catalog(spark, c.path)
    assert other["files"].count() == 1
    with c.transaction():
        c.commit({"files": files(spark, {"path": "/a.jpg"}, {"path": "/b.jpg"})})
        c.set_meta("k", "v")
        assert other.refresh()["files"].count() == 1
    assert c.version == 2 and c.get_meta("k") == "v" and c.get_meta("none", "d") == "d"
    with pytest.raises(Conflict):
        other.commit({"files": files(spark, {"path": "/z.jpg"})})
    with pytest.raises(ZeroDivisionError), c.transaction():
        c.set_meta("k", "w")
        1 / 0
    assert c.get_meta("k") == "v" and c.at(1)["files"].count() == 1
    c.set_meta("k", "x")
    assert c.vacuum(keep=1) > 0 and c["files"].count() == 2 and Catalog(spark, c.path).get_meta("k") == "x"


def test_conform(spark):
    df = conform(spark.createDataFrame([("1", "p", "e")], "id string, path string, extra string"), "files")
    row = df.first()
    assert row.id == 1 and row.missing == 0 and row.kind == "image" and row.extra == "e" and conform(df, "files").columns == df.columns


def test_scan_states(spark):
    known = files(
        spark, {"path": "/same"}, {"path": "/gone"}, {"path": "/changed"}, {"path": "/back", "missing": 1, "content_hash": "b"}, {"path": "/shrunk"},
        {"path": "/lost", "missing": 1, "content_hash": "moved"}, {"path": "/live", "content_hash": "twin"}, {"path": "/small", "too_small": 1},
    )
    rows = [
        ("/same", 10, 1.0, "h", 0), ("/changed", 11, 2.0, "n", 0), ("/back", 10, 1.0, "b", 0), ("/shrunk", 1, 2.0, "s", 1), ("/new place", 10, 3.0, "moved", 0),
        ("/copy", 10, 3.0, "twin", 0), ("/live", 10, 1.0, "twin", 0), ("/small", 10, 1.0, "", 0), ("/n1", 10, 1.0, "fresh", 0), ("/n2", 10, 1.0, "fresh", 0), ("/tiny", 1, 1.0, "", 1),
    ]
    listing = spark.createDataFrame([*rows, rows[0]], "path string, size long, mtime double, content_hash string, too_small int")
    found = scanning.classify(listing, known)
    assert {r.path: r.state for r in found.collect()} == {
        "/same": "unchanged", "/changed": "changed", "/back": "unchanged", "/shrunk": "changed_small", "/new place": "moved", "/copy": "dedup_skipped",
        "/live": "unchanged", "/small": "skipped_small", "/n1": "new", "/n2": "dedup_skipped", "/tiny": "new_small",
    }
    lost = scanning.prune_set(known, found)
    assert [r.path for r in lost.collect()] == ["/gone"]
    assert scanning.prune_set(known, found, ["/g", ""]).count() == 0
    after = {r.path: r for r in scanning.apply_scan(known, found, lost).collect()}
    assert after["/gone"].missing == 1 and after["/back"].missing == 0 and after["/new place"].id == 6 and after["/new place"].missing == 0
    assert after["/changed"].content_hash == "n" and after["/changed"].size == 11 and after["/shrunk"].too_small == 1
    assert sorted(r.id for r in after.values()) == list(range(1, 11)) and after["/tiny"].content_hash == ""
    again = scanning.classify(listing, scanning.apply_scan(known, found, lost))
    assert {r.state for r in again.collect()} <= {"unchanged", "skipped_small", "dedup_skipped"}


def test_apply_scan_makes_the_classes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(path):
        seen.add(1)
        return path

    known = conform(spark.createDataFrame([(1, "/a")], "id long, path string"), "files")
    rows = [(f"/n{i}", 1, 1.0, f"h{i}", 0, None, "new") for i in range(20)] + [("/a", 2, 2.0, "x", 0, 1, "changed")]
    found = spark.createDataFrame(rows, "path string, size long, mtime double, content_hash string, too_small int, file_id long, state string")
    after = scanning.apply_scan(known, found.withColumn("path", counted.asNondeterministic()("path"))).collect()
    assert len(after) == 21 and {r.content_hash for r in after if r.path == "/a"} == {"x"} and seen.value == 21


def test_near_groups(spark):
    rows = files(
        spark, {"path": "/A/IMG_1.JPG", "phash": "0000000000000000"}, {"path": "/B/IMG_1.JPG", "phash": "0000000000000003"},
        {"path": "/C/IMG_1.JPG", "phash": "ffffffffffffffff"}, {"path": "/A/IMG_2.JPG", "phash": "0000000000000001"}, {"path": "/D/img_1.jpg", "phash": "0000000000000000"},
    )
    assert {(r.id, r.group_id) for r in duplicates.near_groups(rows, 6).collect()} == {(1, 1), (2, 1), (5, 1)}
    assert duplicates.near_groups(rows.limit(0)).count() == 0


def test_keepers(spark):
    f = files(spark, {"path": "/long/a"}, {"path": "/b"}, {"path": "/c", "mtime": 9.0}, {"path": "/x", "content_hash": "one"})
    m = meta(spark, {"file_id": 1, "lat": 1.0}, {"file_id": 2, "taken_at": "2001-01-01"}, {"file_id": 3, "taken_at": ""})
    assert {r.keeper for r in duplicates.keepers(f, m).collect()} == {1}
    none = meta(spark, {"file_id": 9, "lat": None})
    pick = {rule: duplicates.keepers(f, none, rule=rule).first().keeper for rule in duplicates.KEEP_RULES}
    assert pick == {"shortest-path": 2, "longest-path": 1, "oldest": 1, "newest": 3}
    assert sorted(r.id for r in duplicates.mark_duplicates(f, m).where("dup_of = 1").collect()) == [2, 3]
    with pytest.raises(ValueError):
        duplicates.keepers(f, m, rule="best")


def test_live_pairs(spark):
    f = files(
        spark, {"path": "/a/IMG_1.HEIC"}, {"path": "/a/IMG_1.MOV"}, {"path": "/a/img_2.jpg"}, {"path": "/a/IMG_2.mp4"}, {"path": "/a/IMG_2.JPG"},
        {"path": "/b/IMG_1.MOV"}, {"path": "/a/IMG_1.mp4"},
    )
    assert {(r.video_id, r.still_id) for r in duplicates.live_pairs(f).collect()} == {(2, 1), (7, 1), (4, 5)}
    marked = {r.id: r for r in duplicates.mark_live(f).collect()}
    assert marked[1].live_video_id == 2 and marked[7].live_photo_of == 1 and marked[6].live_photo_of is None


def test_collate_and_export(spark):
    f = files(
        spark, {"path": "/s/a.jpg", "content_hash": "a" * 64}, {"path": "/s/u.jpg", "content_hash": "u" * 64}, {"path": "/c1/IMG_1.JPG", "content_hash": "1" * 64},
        {"path": "/c2/IMG_1.JPG", "content_hash": "2" * 64}, {"path": "/s/dup.jpg", "dup_of": 1}, {"path": "/s/gone.jpg", "missing": 1},
    )
    day = "2005-01-01 00:00:00"
    m = meta(
        spark, {"file_id": 1, "taken_at": "2003-04-24 10:00:00", "camera_model": "Apple iPhone 4"}, {"file_id": 3, "taken_at": day}, {"file_id": 4, "taken_at": day},
        {"file_id": 5, "taken_at": day}, {"file_id": 6, "taken_at": day},
    )
    plan = organise.collate_plan(f, m, "/out")
    assert {r.target for r in plan.collect()} == {
        "/out/2003/04/24/a.jpg", "/out/undated/u.jpg", "/out/2005/01/01/IMG_1-11111111.JPG", "/out/2005/01/01/IMG_1-22222222.JPG",
    }
    s = organise.plan_summary(plan).first()
    assert (s["files"], s["undated"], s["renamed"]) == (4, 1, 2)
    done = organise.repoint(f, plan)
    assert organise.collate_plan(done, m, "/out").count() == 0 and organise.collate_plan(done, m, "/out", recollate=True).count() == 4
    flat = organise.export_plan(f, m, "/e", camera="iphone", before="2012", flat=True).collect()
    assert [r.target for r in flat] == ["/e/a.jpg"]
    v = organise.verdict(f, m, "/c1/", "/c2/").first()
    assert v.verdict == "identical" and organise.verdict(f, m, "/zz/", "/yy/").first().verdict == "nothing keyed"


def test_names_over_time(spark):
    persons = spark.createDataFrame([(1, "Primary")], "id long, primary_name string")
    names = spark.createDataFrame(
        [(1, 1, "open", None, None), (2, 1, "since", "2010-01-01", None), (3, 1, "both", "2012-01-01", "2014-12-31"), (4, 1, "later", "2013-01-01", "2020-01-01")],
        "id long, person_id long, name string, start_date string, end_date string",
    )
    days = {1: "2009-06-01", 2: "2010-01-01 10:00:00", 3: "2012-05-05", 4: "2014-12-31", 5: None, 6: "2020-01-01", 7: "2020-01-02"}
    faces = spark.createDataFrame([(i, i, 5, None) for i in days], "id long, file_id long, cluster_id long, person_name string")
    m = meta(spark, *[{"file_id": i, "taken_at": d} for i, d in days.items()])
    clusters = spark.createDataFrame([(5, 1)], "cluster_id long, person_id long")
    found = {r.file_id: r.name for r in people.resolve_names(faces, m, clusters, persons, names).collect()}
    assert found == {1: "open", 2: "since", 3: "both", 4: "later", 5: "Primary", 6: "later", 7: "since"}
    assert X.refresh_names(faces, m, clusters, persons, names).where("person_name = 'later'").count() == 2


def test_persons(spark):
    persons = spark.createDataFrame([(1, "Ann")], "id long, primary_name string")
    names = spark.createDataFrame([(1, 1, "Ann", None, None)], "id long, person_id long, name string, start_date string, end_date string")
    clusters = spark.createDataFrame([(7, None, "Bob", 0), (8, None, "bob", 0)], "cluster_id long, person_id long, person_name string, hidden int")
    assert X.find_person(persons, names, " ann ") == 1 and X.create_person(persons, names, "ANN")[2] == 1
    persons, names, bob = X.create_person(persons, names, "Bob")
    assert bob == 2
    persons, names, clusters = X.add_epoch(persons, names, clusters, 1, "Bob", "2001-01-01", None)
    assert persons.count() == 1 and names.where("person_id = 1").count() == 2
    with pytest.raises(ValueError):
        X.delete_epoch(names.where("id = 1"), 1, 1)
    c, p, n = X.backfill_persons(clusters.withColumn("person_name", F.lit("Cy")), persons, names)
    assert p.count() == 2 and {r.person_id for r in c.collect()} == {2} and n.where("person_id = 2").count() == 1
    named = X.name_cluster(spark.createDataFrame([(1, 7, None)], "id long, cluster_id long, person_name string"), clusters, persons, names, 7, "Dee")
    assert named["faces"].first().person_name == "Dee" and named["persons"].count() == 2


def test_delete_cascade(spark):
    f = files(spark, {"path": "/a"}, {"path": "/b"})
    faces = spark.createDataFrame([(10, 1), (11, 2)], "id long, file_id long")
    vec = spark.createDataFrame([(1, [0.1]), (2, [0.2])], "id long, embedding array<float>")
    fvec = spark.createDataFrame([(10, [0.1]), (11, [0.2])], "id long, embedding array<float>")
    out = X.delete_files({"files": f, "faces": faces, "vec_clip": vec, "vec_faces": fvec}, spark.createDataFrame([(1,)], "id long"))
    assert {k: [r.id for r in v.collect()] for k, v in out.items()} == {"files": [2], "faces": [11], "vec_clip": [2], "vec_faces": [11]}
    assert clustering.orphans(fvec, out["faces"]).first().id == 10


def test_rotations_and_tags(spark):
    f = files(spark, {"path": "/a"}, {"path": "/b"})
    assert X.rotate(f, 1, -90).where("id = 1").first().rotation == 270
    found = spark.createDataFrame([(1, 90, 0.95), (2, 90, 0.5)], "id long, degrees int, prob double")
    marked = X.record_suggestions(f, found)
    assert {r.id: r.rotation_suggested for r in marked.collect()} == {1: 90, 2: None} and marked.where("rotation_checked = 1").count() == 2
    assert X.accept_rotation(marked, 1).where("id = 1").first().rotation == 90
    m = X.geotag(meta(spark, {"file_id": 1, "taken_at": "x"}), [1, 2], 0.0, 1.0, "C")
    assert {(r.file_id, r.lat, r.taken_at) for r in m.collect()} == {(1, 0.0, "x"), (2, 0.0, None)}
    filled = X.fill_hashes(f, spark.createDataFrame([(1, "ab")], "id long, phash string"))
    assert {r.id: r.phash for r in filled.collect()} == {1: "ab", 2: ""}


def test_text_queries():
    ok = {"a b": "and", "a OR b": "or", "a NOT b": "not", '"a b"': "phrase", "a*": "prefix", "(a OR b) c": "and", "Éa": "word"}
    assert {q: text.parse(q).kind for q in ok} == ok
    for bad in ("", '"open', "a OR", "(a", "a)", "NOT a", "*", "a b AND"):
        with pytest.raises(text.BadQuery):
            text.parse(bad)


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick, the fox!"), (3, "Ünïcode naïve"), (4, ""), (5, None)], "file_id long, text string")
    index = text.build(docs)
    ids = lambda q: sorted(r.file_id for r in text.search(index, q).collect())
    assert ids("quick fox") == [1, 2] and ids('"brown fox"') == [1] and ids('"quick fox"') == [] and ids("unic*") == [3] and ids("naive") == [3]
    assert ids("fox NOT brown") == [2] and ids('"open') == [] and ids("quick OR naive") == [1, 2, 3] and index.lengths.count() == 3


def test_density_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    x = np.concatenate([c + rng.normal(0, 0.02, (12, 8)) for c in centres] + [rng.normal(0, 1, (4, 8)) * 3])
    labels = clustering.density_clusters(x)
    assert [len(set(labels[12 * i : 12 * i + 12])) for i in range(3)] == [1, 1, 1] and len({labels[0], labels[12], labels[24]}) == 3
    order = rng.permutation(len(x))
    moved = clustering.density_clusters(x[order])
    assert {frozenset(order[moved == k].tolist()) for k in set(moved) - {-1}} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels) - {-1}}
    assert (clustering.density_clusters(x[:2]) == -1).all()


def test_clusters_written(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [float("nan"), 0.0])], "id long, embedding array<float>")
    clusters = spark.createDataFrame([(5, [1.0, 0.0], "Ann", 0), (6, [0.0, 0.0], None, 0)], "cluster_id long, centroid array<float>, person_name string, hidden int")
    near = clustering.assign(vec, clusters)
    assert {r.id: r.cluster_id for r in near.collect()} == {1: 5, 2: 5}
    faces = spark.createDataFrame([(i, None, None) for i in (1, 2, 3)], "id long, cluster_id long, person_name string")
    out = X.write_clusters(faces, clusters, vec, near.select("id", "cluster_id"))
    assert {r.id: r.person_name for r in out["faces"].collect()} == {1: "Ann", 2: "Ann", 3: None}
    assert [r.cluster_id for r in out["face_clusters"].collect()] == [5] and out["face_clusters"].first().face_count == 2


def test_reverse_geocode_everywhere(spark):
    """Poles, the date line, and points far from all, against all cities."""
    import math
    import random

    rng = random.Random(4)
    towns = [(f"c{i}", "r", "C", math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(40)] + [("pole", "r", "C", 90.0, 12.0), ("line", "r", "C", 0.0, 179.9), ("line", "r", "C", 0.0, -179.9)]
    spots = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(150)] + [(200, 89.9, -168.0), (201, -90.0, 0.0), (202, 0.0, 180.0), (203, 0.0, -180.0), (204, None, 1.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    cities = spark.createDataFrame(towns, "name string, region string, country string, lat double, lon double")
    points = spark.createDataFrame(spots, "id long, lat double, lon double")
    found = places.reverse_geocode(points, cities)
    want = {i: round(min(km(lat, lon, c[3], c[4]) for c in towns), 6) for i, lat, lon in spots if lat is not None}
    assert {r.id: round(r.km, 6) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert places.reverse_geocode(points, cities.limit(0)).count() == 0 and places.reverse_geocode(points.limit(0), cities).count() == 0


def test_reverse_geocode_far_and_near(spark):
    cities = spark.createDataFrame([("near", "n", "NN", 10.0, 179.5), ("far", None, "FF", -60.0, 0.0)], "name string, region string, country string, lat double, lon double")
    points = spark.createDataFrame([(1, 10.0, -179.9), (2, 85.0, 0.0), (3, None, 1.0)], "id long, lat double, lon double")
    assert {r.id: (r.city, r.region, r.country) for r in places.reverse_geocode(points, cities).collect()} == {1: ("near", "n", "NN"), 2: ("near", "n", "NN")}


def test_marking_twice_by_different_rules_hides_no_keeper(spark):
    files = spark.createDataFrame(
        [(1, "/a.jpg", "h", 10, 1.0, 0, 0, None, "image", "0f"), (2, "/bb.jpg", "h", 10, 2.0, 0, 0, None, "image", "0f"), (3, "/c.jpg", "h", 10, 0.5, 0, 0, None, "image", "0f")],
        "id long, path string, content_hash string, size long, mtime double, missing int, too_small int, dup_of long, kind string, phash string",
    )
    meta = spark.createDataFrame([], "file_id long, lat double, taken_at string")
    once = duplicates.mark_duplicates(files, meta, rule="shortest-path")
    assert {r.id: r.dup_of for r in once.collect()} == {1: None, 2: 1, 3: 1}
    for rule in ("newest", "oldest", "longest-path"):
        assert {r.id: r.dup_of for r in duplicates.mark_duplicates(once, meta, rule=rule).collect()} == {1: None, 2: 1, 3: 1}
    assert duplicates.groups(once).isEmpty() and duplicates.near_pairs(once).isEmpty() and duplicates.summary(once).first()["groups"] == 0
    more = once.unionByName(files.where("id = 3").withColumn("id", F.lit(4).cast("long")))
    assert {r.id: r.dup_of for r in duplicates.mark_duplicates(more, meta, rule="newest").collect()} == {1: None, 2: 1, 3: 1, 4: 1}


def test_nearest_centroids_whole_or_in_blocks(spark, monkeypatch):
    clusters = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(9)], "cluster_id long, centroid array<double>")
    rows = spark.createDataFrame([(i, [float(i % 11), 1.1, float(i % 5)]) for i in range(90)], "id long, embedding array<double>")

    def found():
        return {r.id: (r.cluster_id, round(r.distance, 9)) for r in clustering.assign(rows, clusters, 0.5).collect()}

    whole = found()
    monkeypatch.setattr(nearest, "DISTANCES", 20)
    assert found() == whole and len(whole) > 50
    monkeypatch.setattr(clustering, "MOST_CENTROID_BYTES", 40)
    assert found() == whole


def test_schema_has_all_tables():
    assert len(ddl("files").split(", ")) >= 28


def test_map_tiles_and_markers(spark):
    places_of = [(1, 0.0, 0.0), (2, 89.9, 180.0), (3, -90.0, -180.0), (4, 48.2, 16.37), (5, 48.2001, 16.3701), (6, 48.3, 16.5), (7, None, 1.0)]
    f = files(spark, *[{"path": f"/{i}.jpg"} for i, _, _ in places_of])
    m = meta(spark, *[{"file_id": i, "lat": lat, "lon": lon} for i, lat, lon in places_of])
    tiles = {(r.zoom, r.x, r.y): r for r in places.map_tiles(f, m, 14).collect()}
    assert tiles[0, 0, 0].n == 6 and tiles[0, 0, 0].first_id == 1 and (1, 1, 0) in tiles and tiles[14, 16383, 0].first_id == 2 and tiles[14, 0, 16383].first_id == 3
    assert all(sum(r.n for r in tiles.values() if r.zoom == z) == 6 for z in range(15))
    shown = places.map_markers(places.map_tiles(f, m, 14), 1, 2).collect()
    # All photos once: the quarter with four of them is shown by smaller tiles, as two at most go into one.
    assert sum(r.n for r in shown) == 6 and max(r.n for r in shown) == 2 and {r.first_id: r.zoom for r in shown if r.first_id in (2, 3)} == {2: 2, 3: 1}
    assert places.map_tiles(f.limit(0), m).count() == 0
