import gzip
import time

from pyspark.sql import functions as F

from lumenfold.catalog import Catalog
from lumenfold.schema import conform
from lumenfold.sources import checkpoint_log, exif, gazetteer, listing, stages
from lumenfold.streaming import incremental as inc


def put(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(n.encode())


def test_walk(spark, tmp_path):
    a = "L.photoslibrary"
    good = [f"{a}/originals/0/real.jpg", f"{a}/Masters/2005/master.jpg", "B.aplibrary/Masters/2011/orig.jpg", "my pictures/Previews/vacation.jpg", "surface0.jpg"]
    bad = [f"{a}/Previews/2014/prev.jpg", f"{a}/Thumbnails/t.jpg", f"{a}/resources/r.jpg", "B.aplibrary/Previews/2011/prev.jpg", "x_face0.jpg", ".hid/a.jpg", "a.txt"]
    put(tmp_path, *good, *bad)
    rows = listing.walk(spark, [str(tmp_path)])
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in rows.collect()) == sorted(good)
    hashed = listing.with_hashes(spark, rows, [str(tmp_path)])
    assert hashed.where("length(content_hash) = 64").count() == len(good)


def test_roots(spark, tmp_path):
    """A hidden root, a root that is a file, roots within roots, and what is left out below them."""
    put(tmp_path, ".photos/a.jpg", ".photos/deep/er/b.HEIC", ".photos/.cache/c.jpg", ".photos/.d.jpg", ".photos/deep/.e/f.jpg", "one.jpg", "one.txt", ".photos/my file%20 ü.jpg")
    (tmp_path / ".photos" / "loop").symlink_to(tmp_path / ".photos")
    root = str(tmp_path / ".photos")
    found = sorted(r.path for r in listing.walk(spark, [root, f"{root}/deep", f"file://{tmp_path}/one.jpg", str(tmp_path / "one.txt"), str(tmp_path / "none")]).collect())
    assert found == sorted([f"{root}/a.jpg", f"{root}/deep/er/b.HEIC", f"{root}/my file%20 ü.jpg", f"{tmp_path}/one.jpg"])
    row = listing.walk(spark, [root]).where("path like '%a.jpg'").first()
    assert row.size == len(".photos/a.jpg") and abs(row.mtime - (tmp_path / ".photos/a.jpg").stat().st_mtime) < 1e-6
    # A partition for each folder, and one for the root's own files.
    assert len(listing.MediaReader([root]).partitions()) == 2


def test_only_new_contents_are_read(spark, tmp_path, monkeypatch):
    put(tmp_path, "same.jpg", "changed.jpg", "new.jpg")
    rows = listing.walk(spark, [str(tmp_path)])
    known = rows.where("path not like '%new.jpg'").selectExpr("path", "if(path like '%changed.jpg', 1L, size) as size", "mtime", "'kept' as content_hash")
    import hashlib

    want = {"same.jpg": "kept", **{n: hashlib.sha256(n.encode()).hexdigest() for n in ("changed.jpg", "new.jpg")}}
    hashed = listing.with_hashes(spark, rows, [str(tmp_path)], known)
    assert {r.path.rpartition("/")[2]: r.content_hash for r in hashed.collect()} == want
    monkeypatch.setattr(listing, "CHUNK", 2)
    assert listing.content_hash(str(tmp_path / "new.jpg")) == want["new.jpg"] and listing.content_hash(str(tmp_path / "gone")) is None


def test_a_probe_that_hangs_does_not_hold_the_process():
    import subprocess
    import sys

    code = "import time; from lumenfold.sources.listing import reachable; assert not reachable('/x', 0.2, lambda: time.sleep(60))"
    began = time.time()
    assert subprocess.run([sys.executable, "-c", code], timeout=50).returncode == 0 and time.time() - began < 45


def test_what_is_appended_to_a_log_is_read(spark, tmp_path):
    records = spark.createDataFrame([(1.0, "start", 4, "x y"), (2.0, "done", 4, None), (3.0, "start", 5, None)], "ts double, event string, file_id long, args string").coalesce(1)
    checkpoint_log.append(records, str(tmp_path / "log"))
    log = checkpoint_log.read(spark, str(tmp_path / "log"))
    assert checkpoint_log.last_in_flight(log).first().file_id == 5 and log.where("event = 'start' and file_id = 4").first().args == "x y"


def test_a_model_with_too_few_results_fails_a_file_only(spark):
    def run(pdf):
        return [[("ok",)] for i in pdf["id"] if i != 3]

    stage = stages.Stage("s", "labels", "done", lambda: F.lit(True), "label string", run, columns=("id",))
    files = spark.createDataFrame([(i, 0) for i in range(1, 6)], "id long, done int")
    found = {r.file_id: (r.label, r.error) for r in stages.outputs(stage, files).collect()}
    assert {i for i, (label, _) in found.items() if label == "ok"} == {1, 2, 4, 5} and found[3][0] is None and found[3][1]


def test_reachable(tmp_path):
    assert listing.reachable(str(tmp_path)) and not listing.reachable(str(tmp_path / "none"))
    began = time.time()
    assert not listing.reachable("/x", 0.3, probe=lambda: time.sleep(3)) and time.time() - began < 2


def test_exif(spark, tmp_path):
    (tmp_path / "e.json").write_text("""[
        {"SourceFile": "/a", "EXIF:DateTimeOriginal": "0000:00:00 00:00:00", "EXIF:CreateDate": "2010:01:02 03:04:05", "EXIF:GPSLatitude": "10.5", "EXIF:GPSLatitudeRef": "South",
         "Composite:GPSLongitude": "-3.25", "EXIF:GPSLongitudeRef": "W", "EXIF:ISO": "many", "EXIF:FNumber": "1.8", "Composite:LensID": "L"},
        {"SourceFile": "/b", "QuickTime:MediaCreateDate": "2011:02:03 00:00:00"}]""")
    rows = {r.path: r for r in exif.rows(exif.read(spark, str(tmp_path / "e.json"))).collect()}
    a = rows["/a"]
    assert (a.taken_at, a.lat, a.lon, a.iso, a.aperture, a.lens) == ("2010-01-02 03:04:05", -10.5, -3.25, None, 1.8, "L")
    assert rows["/b"].taken_at == "2011-02-03 00:00:00" and rows["/b"].lat is None


def test_gazetteer(spark, tmp_path):
    with gzip.open(tmp_path / "l.tsv.gz", "wt") as f:
        f.write("Wrigley Field\t41.95\t-87.66\tstadium\t30\nbroken\tx\n")
    rows = gazetteer.landmarks(spark, str(tmp_path / "l.tsv.gz"))
    assert [r.name for r in rows.collect()] == ["Wrigley Field"]
    found = spark.createDataFrame(
        [("Q1", "A", "k1", 1, "Point(1.5 -2)", 9), ("Q1", "A", "k0", 0, "Point(1.5 -2)", 9), ("Q2", "B", "k0", 0, "nowhere", 9), ("Q3", "C", "k0", 0, "Point(1 2)", 1)],
        "qid string, name string, kind string, kind_no int, point string, sitelinks long",
    )
    best = gazetteer.from_points(found).collect()
    assert [(r.name, r.kind, r.lat, r.lon) for r in best] == [("A", "k0", -2.0, 1.5)]
    gazetteer.write(gazetteer.from_points(found), str(tmp_path / "out"))
    assert gazetteer.landmarks(spark, str(tmp_path / "out")).count() == 1


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text("1.0 start 7 /a b.jpg\n2.0 stage 7 yolo\n3.0 done 7\n4.0 start 8 /c.jpg\nnonsense\n5.0 mem x rss=1\n6.0 start 9 /d\n7.0 done 9\n")
    log = checkpoint_log.read(spark, str(tmp_path / "log"))
    assert checkpoint_log.last_in_flight(log).first().file_id == 8
    assert log.where("event = 'start' and file_id = 7").first().args == "/a b.jpg"
    assert checkpoint_log.tail(log, 2).count() == 2


def listed(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, size long, mtime double, content_hash string, too_small int")


def test_ingest_stages_and_refresh(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    rows = [(f"/lib/{i}.jpg", 10 + i, 1.0, f"hash{i}", 0) for i in range(12)]
    assert inc.ingest(c, listed(spark, *rows)) == {"new": 12}
    assert inc.ingest(c, listed(spark, *rows[:10]), prune=True) == {"unchanged": 10, "pruned": 2}
    assert c["files"].where("missing = 1").count() == 2
    assert inc.run_stage(c, stages.DETECT, limit=4) == 10 and c["files"].where("yolo_done = 1").count() == 4
    report = inc.refresh([
        inc.Phase("detect", lambda: inc.run_stage(c, stages.DETECT)), inc.Phase("embed", lambda: inc.run_stage(c, stages.EMBED)),
        inc.Phase("odd", lambda: 1 / 0, needed=False), inc.Phase("read", lambda: inc.run_stage(c, stages.READ)),
    ])
    assert report.code == 1 and report.done == ["detect", "embed", "read"]
    assert c["vec_clip"].count() == 10 and c["ocr_text"].count() == 10
    before = c["detections"].count()
    assert inc.run_stage(c, stages.DETECT) == 0 and c["detections"].count() == before


def test_stage_isolates_failures(spark, tmp_path):
    def picky(pdf):
        if (pdf["content_hash"] == "hash3").any():
            raise ValueError("bad\nfile")
        return stages.fake_detector(pdf)

    c = Catalog(spark, f"file://{tmp_path}/cat")
    inc.ingest(c, listed(spark, *[(f"/lib/{i}.jpg", 10, 1.0, f"hash{i}", 0) for i in range(6)]))
    stage = stages.Stage("detect", "detections", "yolo_done", stages.DETECT.needs, stages.DETECT.schema, picky)
    inc.run_stage(c, stage)
    bad = c["files"].where("decode_failed = 1").collect()
    assert [(r.content_hash, r.decode_error) for r in bad] == [("hash3", "bad file")] and c["files"].where("yolo_done = 1").count() == 5


def test_babysit(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    inc.ingest(c, listed(spark, *[(f"/lib/{i}.jpg", 10, 1.0, f"hash{i}", 0) for i in range(3)]))
    crashes = [2, 3]

    def work():
        if crashes:
            raise RuntimeError("codec")

    assert inc.babysit(c, work, lambda: crashes.pop(0)).code == 0
    assert c["files"].where("decode_failed = 1").count() == 2

    def never():
        raise RuntimeError("again")

    assert inc.babysit(c, never, lambda: 1).code == 2


def test_streams(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    spark.createDataFrame([("2024-01-01 00:10:00", "start", 1, "")], "ts string, event string, file_id long, args string").write.json(src)
    counted = inc.log_counts(inc.log_stream(spark, src))
    assert counted.isStreaming
    inc.available_now(inc.log_stream(spark, src), out, cp)
    inc.available_now(inc.log_stream(spark, src), out, cp)
    assert spark.read.parquet(out).count() == 1
    seen = []
    inc.each_batch(inc.log_stream(spark, src), str(tmp_path / "cp2"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == 1
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert inc.sessions(events).count() == 2


def test_lock(spark, tmp_path):
    import pytest

    with inc.Lock(spark, f"file://{tmp_path}/lock"), pytest.raises(Exception), inc.Lock(spark, f"file://{tmp_path}/lock"):
        pass
    with inc.Lock(spark, f"file://{tmp_path}/lock"):
        pass


def test_new_rows(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r.id for r in inc.new_rows(a, b, "id").collect()) == [3, 4]
    assert conform(spark.createDataFrame([(1,)], "id int"), "files").count() == 1
