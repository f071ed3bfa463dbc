"""The refresh as a graph of phases: what is done is passed over, also after a crash in any phase."""

import shutil

import pytest
from pyspark.sql import functions as F

from lumenfold.__main__ import main, refresh_phases
from lumenfold.catalog import Catalog
from lumenfold.streaming import incremental as inc


class Killed(BaseException):
    """As a kill: nothing in between catches it."""


def library(tmp_path):
    lib = tmp_path / "lib"
    for name in ("2004/10/25/a.jpg", "2004/10/25/b.jpg", "x/copy of a.jpg", "y/z/IMG.jpg", "y/w/IMG.jpg", "y/v/IMG.jpg"):
        p = lib / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"same" if name.endswith("a.jpg") else name.encode())
    return lib


def prepared(spark, tmp_path, lib, name):
    """A scanned catalog with hashes: b and z/IMG look alike, w/IMG is two bits from z/IMG, v/IMG is far."""
    cat = f"file://{tmp_path}/{name}"
    main([cat, "scan", str(lib)])
    c = Catalog(spark, cat)
    end = lambda s: F.col("path").endswith(s)
    look = F.when(end("b.jpg") | end("z/IMG.jpg"), "00ff00ff00ff00ff").when(end("w/IMG.jpg"), "00ff00ff00ff00fc").when(end("v/IMG.jpg"), "ffffffff00000000")
    c.commit({"files": c["files"].withColumn("phash", look)})
    # The copies' target is outside of the scanned root, and each catalog's own.
    c.set_meta("collate_target", f"{tmp_path}/out-{name}")
    return c


def outcome(c, name):
    rows = c["files"].select(F.regexp_replace("path", f"out-{name}", "out").alias("path"), "dup_of", "missing", "yolo_done", "clip_done", "ocr_done").collect()
    return sorted(tuple(map(str, r)) for r in rows), {t: c[t].count() for t in ("detections", "vec_clip", "ocr_text", "faces")}


def test_crashes_in_every_phase(spark, tmp_path):
    lib = library(tmp_path)
    whole = prepared(spark, tmp_path, lib, "whole")
    shutil.copytree(tmp_path / "whole", tmp_path / "struck")
    c = Catalog(spark, f"file://{tmp_path}/struck")
    c.set_meta("collate_target", f"{tmp_path}/out-struck")
    first = inc.refresh([p for p in refresh_phases(whole, fake=True) if p.name != "rescan"], whole)
    names = [p.name for p in refresh_phases(whole, fake=True)]
    assert names == ["rescan", "detect", "embed", "dedupe", "look", "near", "collate", "cluster", "read"]
    assert first.done == names[1:] and not first.failed and first.code == 0
    kept = whole["files"].where("dup_of is null and missing = 0")
    assert kept.count() == 3 and kept.where("phash = 'ffffffff00000000'").count() == 1

    for at, name in enumerate(("detect", "dedupe", "look", "near", "collate")):
        (phase,) = [p for p in refresh_phases(c, fake=True) if p.name == name]
        real = phase.run

        def dies(real=real, after=at % 2):
            if after:
                real()
            raise Killed

        phase.run = dies
        with pytest.raises(Killed):
            inc.refresh([phase], c)
        c = Catalog(spark, c.path)  # as a new process would
        assert inc.refresh([p for p in refresh_phases(c, fake=True) if p.name == name], c).done == [name]
    inc.refresh([p for p in refresh_phases(c, fake=True) if p.name != "rescan"], c)
    assert outcome(c, "struck") == outcome(whole, "whole")
    # Nothing is left to do once all have read what the others left.
    calm = inc.refresh([p for p in refresh_phases(c, fake=True) if p.name != "rescan"], c)
    assert calm.done == [] and calm.unchanged == names[1:]
    # Another distance is another phase to run.
    assert inc.refresh([p for p in refresh_phases(c, near=3, fake=True) if p.name == "near"], c).done == ["near"]


def test_held_and_failed(spark, tmp_path):
    def bad():
        raise SystemExit("no root can be reached")

    ran = []
    phases = [inc.Phase("a", bad, False), inc.Phase("b", lambda: ran.append("b"), False, after=("a",)), inc.Phase("c", lambda: ran.append("c"), False, after=("b",)), inc.Phase("d", lambda: ran.append("d"), False)]
    report = inc.refresh(phases)
    assert report.failed == {"a": "no root can be reached"} and report.held == ["b", "c"] and ran == ["d"] and report.code == 1


def test_command(spark, tmp_path):
    cat = f"file://{tmp_path}/cat"
    main([cat, "scan", str(library(tmp_path))])
    with pytest.raises(SystemExit) as done:
        main([cat, "refresh", "--near", "5"])
    assert done.value.code == 0 and Catalog(spark, cat).get_meta("phase near").startswith("5;")
    with inc.Lock(spark, f"{cat}/refresh.lock"), pytest.raises(SystemExit) as held:
        main([cat, "refresh"])
    assert held.value.code == 2
