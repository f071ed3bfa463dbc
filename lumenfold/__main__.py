"""python -m lumenfold CATALOG COMMAND ...: a thin command line over a catalog's folder.

Commands that change or delete show what they would do, and do it with --apply.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.catalog import Catalog
from lumenfold.operators import cameras, clustering, duplicates, orientation, organise, people, scanning, search, stats, text, textindex, timeline
from lumenfold.operators import transitions as X
from lumenfold.session import checkpointed, get_session, stored
from lumenfold.sources import checkpoint_log, copying, exif, listing, sampling, stages
from lumenfold.streaming import incremental

COMMANDS: dict[str, tuple[Callable, list[tuple[tuple, dict]]]] = {}


def option(*names: str, **how) -> tuple[tuple, dict]:
    return names, how


APPLY = option("--apply", action="store_true")
LIMIT = option("--limit", type=int, default=20)


def command(name: str, *options: tuple[tuple, dict]):
    def add(f: Callable) -> Callable:
        COMMANDS[name] = (f, list(options))
        return f

    return add


def show(frame: DataFrame, limit: int = 50) -> None:
    for row in frame.limit(limit).collect():
        print("\t".join("" if v is None else str(v) for v in row))


def _tables(cat: Catalog) -> dict[str, DataFrame]:
    return {n: cat[n] for n in ("files", "photo_meta", "detections", "faces", "frames", "ocr_text", "vec_clip", "vec_faces", "vec_clip_frames")}


def _delete(cat: Catalog, condition, apply: bool) -> None:
    gone = cat["files"].where(condition).select("id", "path")
    print(f"{gone.count()} files")
    show(gone.orderBy("id"), 20)
    if apply:
        cat.commit(X.drop_where(_tables(cat), condition))


@command("init")
def _(cat, a):
    print(f"commit {cat.version}")


@command("stats")
def _(cat, a):
    show(stats.library(cat["files"]))
    show(stats.date_range(cat["photo_meta"]))
    show(stats.top_cameras(cat["photo_meta"]))


def _scan(cat: Catalog, roots: list[str], prune: bool) -> None:
    good = [r for r in roots if listing.reachable(r)]
    skipped = tuple(r for r in roots if r not in good)
    if not good:
        sys.exit("no root can be reached")
    rows = stored(listing.with_hashes(cat.spark, listing.walk(cat.spark, good), good, cat["files"].select("path", "size", "mtime", "content_hash")))
    print(incremental.ingest(cat, rows, prune, skipped))
    now = cat.spark.createDataFrame([(r,) for r in good], "path string").withColumn("last_scanned_at", F.unix_timestamp().cast("double"))
    cat.commit({"scan_roots": X.replace_by_key(cat["scan_roots"], now, "path")})


@command("scan", option("roots", nargs="+"), option("--prune", action="store_true"))
def _(cat, a):
    _scan(cat, a.roots, a.prune)


@command("rescan", option("--prune", action="store_true"))
def _(cat, a):
    _scan(cat, [r.path for r in cat["scan_roots"].collect()], a.prune)


@command("drop-small", option("--min-pixels", type=int, default=320), APPLY)
def _(cat, a):
    _delete(cat, P.small(a.min_pixels), a.apply)


@command("drop-videos", APPLY)
def _(cat, a):
    _delete(cat, P.is_video_path(), a.apply)


@command("cleanup-thumbnails", APPLY)
def _(cat, a):
    _delete(cat, P.thumbnail_junk(), a.apply)


@command("prune-path", option("substring"), APPLY)
def _(cat, a):
    _delete(cat, P.path_like(a.substring), a.apply)


def _near(cat: Catalog, within: int, keep: str, apply: bool, limit: int = 0) -> None:
    found = stored(duplicates.near_groups(cat["files"], within))
    show(found.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group_id"), limit)
    if apply:
        named = cat["files"].join(found, "id").withColumn("content_hash", F.col("group_id").cast("string"))
        dup = duplicates.keepers(named, cat["photo_meta"], rule=keep).where("id <> keeper").withColumnRenamed("keeper", "dup_of")
        cat.commit({"files": X.update(cat["files"], dup, "id", ["dup_of"])})


@command(
    "find-duplicates", option("--by", choices=["bytes", "look"], default="bytes"), option("--near", type=int), option("--keep", choices=duplicates.KEEP_RULES, default="shortest-path"),
    option("--reset", action="store_true"), APPLY, LIMIT,
)
def _(cat, a):
    by = "phash" if a.by == "look" else "content_hash"
    if a.reset:
        cat.commit({"files": X.reset_duplicates(cat["files"])})
    elif a.near is not None:
        _near(cat, a.near, a.keep, a.apply, a.limit)
    else:
        show(duplicates.summary(cat["files"], by))
        show(duplicates.groups(cat["files"], by).orderBy(F.desc("n"), "key"), a.limit)
        if a.apply:
            cat.commit({"files": duplicates.mark_duplicates(cat["files"], cat["photo_meta"], by, a.keep)})


@command("find-live-photos")
def _(cat, a):
    cat.commit({"files": duplicates.mark_live(cat["files"])})
    print(cat["files"].where("live_photo_of is not null").count())


@command("list-videos")
def _(cat, a):
    show(stats.video_states(cat["files"].select("path"), cat["files"]))


@command("check-missing", APPLY, LIMIT)
def _(cat, a):
    roots = [r.path for r in cat["scan_roots"].collect() if listing.reachable(r.path)]
    gone = stored(scanning.check_missing(cat["files"].where(P.under_roots(roots)) if roots else cat["files"].where("false"), listing.walk(cat.spark, roots)))
    show(gone, a.limit)
    if a.apply:
        cat.commit({"files": X.mark_missing(cat["files"], gone)})


@command("list-failures", LIMIT)
def _(cat, a):
    show(stats.failure_total(cat["files"]))
    show(stats.failures(cat["files"], a.limit), a.limit)


@command("clear-failures", option("--path"))
def _(cat, a):
    cat.commit({"files": X.clear_failures(cat["files"], a.path)})


@command("skip", option("target"), option("--reason", default="skipped by hand"))
def _(cat, a):
    row = scanning.resolve_target(cat["files"], a.target).first()
    if row is None:
        sys.exit("no such file")
    cat.commit({"files": X.tombstone(cat["files"], row.id, a.reason)})


@command("diagnose", option("target"))
def _(cat, a):
    row = scanning.resolve_target(cat["files"], a.target).first()
    if row is None:
        sys.exit("no such file")
    show(timeline.with_meta(cat["files"], cat["photo_meta"]).where(F.col("id") == row.id))
    show(duplicates.siblings(cat["files"], row.id))


@command("purge-orphans", APPLY)
def _(cat, a):
    for table, parent in (("vec_clip", "files"), ("vec_faces", "faces"), ("vec_clip_frames", "frames")):
        print(table, clustering.orphans(cat[table], cat[parent]).count())
        if a.apply:
            cat.commit({table: X.purge_orphans(cat[table], cat[parent])})


@command("compare-roots", option("a"), option("b"), option("--key", choices=["exif", "phash", "taken", "name"], default="exif"), option("--exclude"), LIMIT)
def _(cat, a):
    show(organise.verdict(cat["files"], cat["photo_meta"], a.a, a.b, a.key, a.exclude))
    show(organise.compare(cat["files"], cat["photo_meta"], a.a, a.b, a.key, a.exclude).where("side <> 'both'").orderBy("key"), a.limit)


@command("backfill-dates", option("--redo", action="store_true"), option("--path"), APPLY, LIMIT)
def _(cat, a):
    found = stored(organise.backfill(cat["files"], cat["photo_meta"], a.redo, a.path))
    show(found.groupBy(F.substring("taken_at", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year"))
    if a.apply:
        files, meta = X.backfill_dates(cat["files"], cat["photo_meta"], found)
        cat.commit({"files": files, "photo_meta": meta})


def _carry_out(plan: DataFrame) -> DataFrame:
    done = stored(copying.carry_out(plan))
    show(done.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
    return done.where("status in ('copied', 'there')")


@command("set-collate-target", option("target", nargs="?"))
def _(cat, a):
    if a.target is not None:
        cat.set_meta("collate_target", a.target)
    print(cat.get_meta("collate_target", ""))


def _collate(cat: Catalog, target: str, undated: str = "undated", again: bool = False, apply: bool = True, repoint: bool = True) -> None:
    plan = checkpointed(organise.collate_plan(cat["files"], cat["photo_meta"], target, undated, again))
    show(organise.plan_summary(plan, undated))
    if apply:
        done = _carry_out(plan)
        if repoint:
            cat.commit({"files": organise.repoint(cat["files"], done)})


@command("collate", option("--target"), option("--undated", default="undated"), option("--recollate", action="store_true"), option("--no-repoint", action="store_true"), APPLY)
def _(cat, a):
    target = a.target or cat.get_meta("collate_target") or sys.exit("no target")
    _collate(cat, target, a.undated, a.recollate, a.apply, not a.no_repoint)


@command(
    "export", option("target"), option("--camera"), option("--before"), option("--after"), option("--person"), option("--flat", action="store_true"), APPLY
)
def _(cat, a):
    plan = checkpointed(organise.export_plan(cat["files"], cat["photo_meta"], a.target, a.camera, a.before, a.after, a.person, cat["faces"], a.flat))
    show(organise.plan_summary(plan))
    if a.apply:
        _carry_out(plan)


@command("index", option("--fake", action="store_true", help="stages whose results are functions of a file's hash"), option("--limit", type=int))
def _(cat, a):
    if not a.fake:
        sys.exit("models are plug-ins: make stages of lumenfold.sources.stages.Stage and call streaming.incremental.run_stage")
    for stage in (stages.DETECT, stages.EMBED, stages.READ):
        print(stage.name, incremental.run_stage(cat, stage, a.limit))


@command("metadata", option("json", help="output of an EXIF reader, an array of objects"))
def _(cat, a):
    ids = cat["files"].select(F.col("id").alias("file_id"), F.col("path").alias("f_path"))
    found = exif.rows(exif.read(cat.spark, a.json)).join(ids, F.col("path") == F.col("f_path")).drop("path", "f_path")
    meta, files = X.store_metadata(cat["photo_meta"], cat["files"], found)
    cat.commit({"photo_meta": meta, "files": files})
    print(found.count())


def _cluster(cat: Catalog, full: bool = False, min_size: int = clustering.MIN_CLUSTER) -> None:
    vectors = cat["vec_faces"]
    if full:
        found = clustering.full(vectors, min_size)
    else:
        found = clustering.incremental(vectors.join(cat["faces"].where("cluster_id is null").select("id"), "id", "left_semi"), cat["face_clusters"], min_size)
    cat.commit(X.write_clusters(cat["faces"], cat["face_clusters"], vectors, checkpointed(found)))
    cat.commit({"faces": X.refresh_names(cat["faces"], cat["photo_meta"], cat["face_clusters"], cat["persons"], cat["person_names"])})


@command("cluster-faces", option("--full", action="store_true"), option("--min-size", type=int, default=clustering.MIN_CLUSTER))
def _(cat, a):
    _cluster(cat, a.full, a.min_size)


IMAGES = option("images", help="a Parquet table of id and image: small grey squares, rows one after the other")


def _model_of(cat: Catalog) -> str:
    return f"{cat.path}/models/orientation"


@command("train-orientation", IMAGES, option("--samples", type=int, default=orientation.SAMPLES), option("--fewest", type=int, default=orientation.FEWEST))
def _(cat, a):
    images = cat.spark.read.parquet(a.images)
    good = orientation.upright(cat["files"])
    dated = cat["photo_meta"].join(good.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    chosen = sampling.top_up(sampling.by_year(dated, a.samples, 0), good.select(F.col("id").alias("file_id"), F.lit(None).cast("string").alias("taken_at")), a.samples, 0)
    model = orientation.train(images.join(chosen.select(F.col("file_id").alias("id")), "id", "left_semi"), fewest=a.fewest)
    orientation.save(model, _model_of(cat))
    show(orientation.quality(model, images.join(good, "id", "left_semi").join(chosen.select(F.col("file_id").alias("id")), "id", "left_anti")).orderBy("least"))


def _suggest(cat: Catalog, images: str, least: float = orientation.LEAST, camera: str | None = None, redo: bool = False) -> None:
    model = orientation.load(cat.spark, _model_of(cat)) or sys.exit("no model yet: train-orientation")
    files = cat["files"]
    if camera:
        files = files.join(cat["photo_meta"].where(F.col("camera_model").ilike(f"%{camera}%")).select(F.col("file_id").alias("id")), "id", "left_semi")
    found = stored(orientation.suggestions(model, files, cat.spark.read.parquet(images), redo))
    cat.commit({"files": X.record_suggestions(cat["files"], found, least)})
    print(found.count(), found.where((F.col("degrees") != 0) & (F.col("prob") >= least)).count())


@command("suggest-rotations", IMAGES, option("--min-conf", type=float, default=orientation.LEAST), option("--camera"), option("--redo", action="store_true"))
def _(cat, a):
    _suggest(cat, a.images, a.min_conf, a.camera, a.redo)


@command("ocr", option("--fake", action="store_true"), option("--limit", type=int))
def _(cat, a):
    if not a.fake:
        sys.exit("models are plug-ins: make a stage of lumenfold.sources.stages.Stage and call streaming.incremental.run_stage")
    print(incremental.run_stage(cat, stages.READ, a.limit))


@command("babysit-index", option("log", help="a folder of run logs, as last-crash reads them"), option("--fake", action="store_true"))
def _(cat, a):
    if not a.fake:
        sys.exit("models are plug-ins: call streaming.incremental.babysit with stages of your own")

    def in_flight() -> int | None:
        row = checkpoint_log.last_in_flight(checkpoint_log.read(cat.spark, a.log)).first()
        return row.file_id if row else None

    report = incremental.babysit(cat, lambda: [incremental.run_stage(cat, s) for s in (stages.DETECT, stages.EMBED)], in_flight)
    print(report)
    sys.exit(report.code)


@command(
    "search", option("--text", default=""), option("--like", type=int, help="the vector of this file"), option("--label", default=""), option("--person", default=""),
    option("--cluster", type=int), option("--camera", default=""), option("--country", default=""), option("-k", type=int, default=20),
)
def _(cat, a):
    vector = cat["vec_clip"].where(F.col("id") == a.like).first() if a.like is not None else None
    request = search.Request(a.text, vector.embedding if vector else None, a.label, a.person, a.cluster, a.camera, a.country, a.k)
    found = search.run(cat, request, _text_index(cat) if a.text else None)
    if found is not None:
        show(found, a.k)


def _text_index(cat) -> text.Index:
    """The catalog's stored index, with what changed since it was last asked."""
    stored = textindex.StoredIndex(cat.spark, f"{cat.path}/text-index")
    stored.sync(cat["ocr_text"].select("file_id", "text"))
    return stored.index()


@command("timeline", option("--page", type=int, default=0), option("--year"), option("--months"))
def _(cat, a):
    show(timeline.page(cat["files"], cat["photo_meta"], a.page, year=a.year, months=P.parse_months(a.months)), timeline.PAGE)


@command("cameras")
def _(cat, a):
    show(cameras.summary(cat["files"], cat["photo_meta"]).orderBy(F.desc("n"), "camera_model"))
    show(cameras.lens_groups(cat["files"], cat["photo_meta"]).select("camera_model", "label", "n"))


@command("people")
def _(cat, a):
    show(people.counts(cat["faces"]))


@command("last-crash", option("log"), option("--tail", type=int, default=50))
def _(cat, a):
    log = checkpoint_log.read(cat.spark, a.log)
    show(checkpoint_log.last_in_flight(log))
    show(checkpoint_log.tail(log, a.tail).orderBy("line_no"), a.tail)


HIDING = ("id", "path", "content_hash", "phash", "size", "missing", "too_small", "dup_of", "live_photo_of")


def refresh_phases(cat: Catalog, near: int = duplicates.NEAR, fake: bool = False, images: str | None = None) -> list[incremental.Phase]:
    """Scan, indexing, duplicates by bytes, by look and nearly so, copies to the target, clusters, text, turns; each incremental.

    Copies wait for the duplicates, as what isn't hidden yet would be copied. Turns need a trained model and its pictures.
    """

    def marked(by: str) -> None:
        cat.commit({"files": duplicates.mark_duplicates(cat["files"], cat["photo_meta"], by)})

    def stage(s: stages.Stage) -> incremental.Phase:
        reads = {"files": ("id", "path", "content_hash", s.flag, "missing", "decode_failed", "too_small", "kind", "dup_of", "live_photo_of")}
        return incremental.Phase(s.name, lambda: incremental.run_stage(cat, s), False, reads)

    hiding = {"files": HIDING, "photo_meta": ("file_id", "taken_at", "lat", "lon")}
    roots = [r.path for r in cat["scan_roots"].collect()]
    phases = [incremental.Phase("rescan", lambda: _scan(cat, roots, True), False)] if roots else []
    phases += [stage(s) for s in (stages.DETECT, stages.EMBED) if fake]
    phases += [
        incremental.Phase("dedupe", lambda: marked("content_hash"), False, hiding),
        incremental.Phase("look", lambda: marked("phash"), False, hiding),
        incremental.Phase("near", lambda: _near(cat, near, "shortest-path", True), False, hiding, how=str(near)),
    ]
    target = cat.get_meta("collate_target", "")
    if target:
        phases.append(incremental.Phase("collate", lambda: _collate(cat, target), False, hiding, after=("dedupe", "look", "near"), how=target))
    faces = {"vec_faces": ("id", "embedding"), "faces": ("id", "cluster_id", "person_name"), "person_names": ("person_id", "name", "start_date", "end_date"), "photo_meta": ("file_id", "taken_at")}
    phases.append(incremental.Phase("cluster", lambda: _cluster(cat), False, faces))
    phases += [stage(stages.READ)] if fake else []
    if images and orientation.load(cat.spark, _model_of(cat)) is not None:
        phases.append(incremental.Phase("turns", lambda: _suggest(cat, images), False, {"files": ("id", "rotation", "rotation_checked", *HIDING[2:])}, how=images))
    return phases


@command("refresh", option("--fake", action="store_true"), option("--near", type=int, default=duplicates.NEAR), option("--images"))
def _(cat, a):
    try:
        with incremental.Lock(cat.spark, f"{cat.path}/refresh.lock"):
            report = incremental.refresh(refresh_phases(cat, a.near, a.fake, a.images), cat)
    except incremental.Locked:
        sys.exit(2)
    print(report)
    sys.exit(report.code)


@command("vacuum", option("--keep", type=int, default=2))
def _(cat, a):
    print(cat.vacuum(a.keep))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m lumenfold", description=__doc__)
    parser.add_argument("catalog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for names, how in options:
            sub.add_argument(*names, **how)
    args = parser.parse_args(argv)
    COMMANDS[args.command][0](Catalog(get_session(), args.catalog), args)


if __name__ == "__main__":
    main()
