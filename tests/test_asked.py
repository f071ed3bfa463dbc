"""Links of searches, places that are asked for, names of countries, roots in force: against plain Python."""

import json
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import geo
from lumenfold.operators import places, search


def test_links(spark):
    values = ["a b", "Ü&=?/", "*~._-", "", None, "100%+", "\u4e2d\u6587"]
    rows = [(i, v, values[-1 - i], i if i % 2 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, label string, text string, cluster int")
    got = {r.i: r.link for r in df.select("i", search.link({"label": F.col("label"), "text": F.col("text"), "cluster": F.col("cluster")}, 20).alias("link")).collect()}
    for i, label, text, cluster in rows:
        given = [(k, v) for k, v in (("text", text), ("label", label), ("cluster", cluster)) if v not in (None, "")]
        assert got[i] == ("?" + urlencode([*given, ("k", 20)]) if given else "")
    assert [r[0] for r in df.where("i = 4").select(search.link({"label": F.col("label")})).collect()] == [""]
    with pytest.raises(ValueError):
        search.link({"colour": F.col("label")})


def test_places_asked_for(spark):
    asked = ["Paris, France", "paris fr", "fr", "New York, United States", "united states", "Saint-Denis, xx", "  Bath ,, UK ", "", None, "york, south  korea", "a b korea", "Rome It"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    got = {r.i: (r.p.name, r.p.country) for r in rows.select("i", geo.place_and_country(F.col("q"), {"FR", "IT"}).alias("p")).collect()}
    assert got == {i: geo.parse_place(q, {"FR", "IT"}) for i, q in enumerate(asked)}
    none = rows.select("i", geo.place_and_country(F.col("q")).alias("p")).collect()
    assert {r.i: (r.p.name, r.p.country) for r in none} == {i: geo.parse_place(q) for i, q in enumerate(asked)}


def test_names_of_countries(spark):
    rows = spark.createDataFrame([(1, "FR"), (2, "XX"), (3, None), (4, "FR")], "id int, country string")
    names = spark.createDataFrame([("FR", "France"), ("FR", "Gaul"), ("DE", "Germany")], "code string, name string")
    got = {r.id: r.country_name for r in places.with_country_names(rows, names).collect()}
    assert got == {1: "France", 2: "XX", 3: None, 4: "France"}


def test_roots_in_force(spark):
    live = ["/b", "/a", "/c"]
    stored = ['["/a", "/b"]', '["/gone", "/c"]', '["/gone"]', "[", None, "{}", "[]"]
    rows = spark.createDataFrame(list(enumerate(stored)), "i int, s string").withColumn("live", F.array(*[F.lit(x) for x in live]))
    got = {r.i: r.f for r in rows.select("i", P.roots_in_force(F.col("s"), F.col("live")).alias("f")).collect()}
    for i, s in enumerate(stored):
        try:
            kept = json.loads(s) if isinstance(json.loads(s), list) else []
        except (TypeError, ValueError):
            kept = []
        assert got[i] == (P.effective_roots(kept, live) or live)


def catalog(spark, places_of):
    from lumenfold.schema import conform

    files = spark.createDataFrame([(i, f"/p{i}.jpg") for i in places_of], "id long, path string").withColumn("missing", F.lit(0))
    meta = spark.createDataFrame([(i, *p) for i, p in places_of.items()], "file_id long, lat double, lon double")
    return conform(files, "files"), conform(meta, "photo_meta")


@pytest.mark.parametrize("lat, lon, radius", [(48.85, 2.35, 1500), (0.0, 179.0, 300), (89.0, 10.0, 400), (-60.0, -179.5, 2500), (10.0, 20.0, 12000), (0.0, 0.0, 30000)])
def test_nearby_is_the_whole_circle(spark, lat, lon, radius):
    """Places just within and just beyond the rim in all directions."""
    import math

    def km(a, b):
        p, q = math.radians(lat), math.radians(a)
        s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - lon) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(s)))

    spots = {}
    for k in range(72):
        for share in (0.3, 0.999999, 1.000001):
            a, d, p = 2 * math.pi * k / 72, min(radius * share / 6371.0, math.pi), math.radians(lat)
            y = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))
            x = math.radians(lon) + math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(y))
            spots[len(spots) + 1] = (math.degrees(y), (math.degrees(x) + 180) % 360 - 180)
    got = {r.id for r in places.nearby(*catalog(spark, spots), lat, lon, radius).collect()}
    assert got == {i for i, p in spots.items() if km(*p) <= radius} and len(got) >= 144


def test_equal_ranks_come_by_id(spark, monkeypatch):
    """Sums that differ in their last bits are one rank."""
    from lumenfold.operators import text

    docs = spark.createDataFrame([(i, "one two three") for i in (1, 2, 3)], "file_id long, text string")
    hits = spark.createDataFrame([(1, -0.3), (2, -0.1 - 0.2), (3, -0.3)], "file_id long, rank double")
    monkeypatch.setattr(text, "search", lambda index, query: hits)
    files, meta = catalog(spark, {i: (0.0, 0.0) for i in (1, 2, 3)})
    found = search.by_text(files, meta, text.build(docs), "one two three", 2)
    assert [r.id for r in found.collect()] == [1, 2]


def test_a_stage_sorts_no_rows_to_join_what_it_did(spark):
    from lumenfold.sources import stages

    files = spark.createDataFrame(
        [(i, f"/a/{i}", f"{i:064x}", 0, 0, None, i % 2, 0, None) for i in range(40)],
        "id long, path string, content_hash string, missing int, too_small int, live_photo_of long, yolo_done int, decode_failed int, decode_error string",
    )
    table = spark.createDataFrame([(i, "old", 0.5, 0.0, 0.0, 0.0, 0.0) for i in range(40)], f"file_id long, {stages.DETECT.schema}")
    now, rows = stages.apply(stages.DETECT, files, table)
    for frame in (now, rows):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert now.where("yolo_done = 1").count() == 40
    assert {r.file_id for r in rows.where("label = 'old'").collect()} == set(range(1, 40, 2))


def test_components_end_when_all_edges_are_stars(spark):
    import random

    from lumenfold.operators import components

    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 30)]
    root = {x: x for e in edges for x in e}

    def least(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((least(a), least(b)))
        root[b] = a
    want = {x: least(x) for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.connected_components(frame, "a", "b").collect()} == want
    # Stars need no round.
    star = frame.where("a = 2000")
    assert components.connected_components(star, "a", "b", max_rounds=0).count() == 30
    assert components.connected_components(frame.limit(0), "a", "b").count() == 0
