import json

import pytest

from lumenfold.__main__ import COMMANDS, main
from lumenfold.sources import copying


def test_copy(tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    target = tmp_path / "out" / "x" / "a"
    assert copying.copy_one(str(tmp_path / "a"), str(target)) == ("copied", 3) and target.read_bytes() == b"one"
    assert copying.copy_one(str(tmp_path / "a"), str(target))[0] == "there"
    target.write_bytes(b"two")
    assert copying.copy_one(str(tmp_path / "a"), str(target))[0].startswith("other")
    assert copying.copy_one(str(tmp_path / "none"), str(target))[0].startswith("failed")
    assert [p.name for p in target.parent.iterdir()] == ["a"]


def test_commands(spark, tmp_path, capsys):
    lib, cat = tmp_path / "lib", f"file://{tmp_path}/cat"
    for name in ("2004/10/25/a.jpg", "2004/10/25/b.jpg", "copy/a2.jpg", "clip.mov", "clip.jpg", "old/2005-01-02 x.jpg"):
        p = lib / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"same" if name in ("2004/10/25/a.jpg", "copy/a2.jpg") else name.encode())
    run = lambda *a: (main([cat, *map(str, a)]), capsys.readouterr().out)[1]
    assert "'new': 5" in run("scan", lib) and "'unchanged': 5" in run("rescan", "--prune")
    assert run("stats").startswith("5\t") and run("find-live-photos").strip() == "1"
    run("index", "--fake")
    (tmp_path / "exif.json").write_text(json.dumps([{"SourceFile": str(p)} for p in lib.rglob("*.*")]))
    assert run("metadata", tmp_path / "exif.json").strip() == "5"
    run("backfill-dates", "--apply")
    assert "2004-10-25" in run("timeline") and "0\t0" in run("find-duplicates")
    assert "copied\t5" in run("collate", "--target", tmp_path / "out", "--apply") and (tmp_path / "out/2004/10/25").is_dir()
    assert "copied" in run("export", tmp_path / "ex", "--flat", "--apply")
    assert "0 files" in run("drop-small") and "1 files" in run("drop-videos", "--apply")
    run("skip", "b.jpg")
    assert "skipped by hand" in run("list-failures")
    run("clear-failures")
    assert run("list-failures").startswith("0")
    assert run("set-collate-target", "/x").strip() == "/x" and "nothing" in run("compare-roots", "/no/", "/nope/")
    assert run("search", "--like", 1).count("\n") >= 1 and run("people") == "" and "vec_clip 0" in run("purge-orphans")
    with pytest.raises(SystemExit):
        run("skip", "not there at all")
    assert int(run("vacuum")) > 0 and len(COMMANDS) > 25
