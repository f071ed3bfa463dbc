import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import bits, dates, formats, geo, paths, vectors

DATED = {
    "/Volumes/photo/Photos Library.photoslibrary/2004/10/25/DSCN0284.JPG": "2004-10-25 12:00:00",
    "/lib/2005/8/4/x.jpg": "2005-08-04 12:00:00",
    "/x/Shimogyo-Ku, Kyoto - Sugiebisucho, August 4, 2005/IMG_4857.JPG": "2005-08-04 12:00:00",
    "/x/December 20, 2010/P1000845.JPG": "2010-12-20 12:00:00",
    "/x/March 27, 2004/IMG.jpg": "2004-03-27 12:00:00",
    "/x/Jan 3 2007/a.jpg": "2007-01-03 12:00:00",
    "/x/IMG_20040825_143000.jpg": "2004-08-25 14:30:00",
    "/x/PXL_20211105.jpg": "2021-11-05 12:00:00",
    "/x/Screenshot 2019-05-13.png": "2019-05-13 12:00:00",
    "/x/2013-07-04 party.jpg": "2013-07-04 12:00:00",
    "/photos/2005/08/IMG.jpg": "2005-08-01 12:00:00",
    "/x/IMG_20040825_143007.jpg": "2004-08-25 14:30:07",
    "/x/IMG_20040825_253007.jpg": "2004-08-25 12:00:00",
    "/x/IMG_20040825_143060.jpg": "2004-08-25 12:00:00",
    "/x/IMG_20040825-1430.jpg": "2004-08-25 14:30:00",
    "/x/20041399 and 20040825.jpg": "2004-08-25 12:00:00",
    "/Volumes/photo/Camera/1347491616193.jpg": "2012-09-12 23:13:36",
    "/x/Sept. 5th, 2011/a.jpg": "2011-09-05 12:00:00",
    "/x/Foo 2011 and May 2012/a.jpg": "2012-05-01 12:00:00",
    "/x/2004/02/30/a.jpg": "2004-02-01 12:00:00",
    **dict.fromkeys([
        "/x/IMG_1234.JPG", "/x/IMG_12345678.jpg", "/x/DSC00089.JPG", "/x/99999999.jpg", "/x/20043299.jpg", "/random/vacation/photo.jpg",
        "/x/1889/01/01/old.jpg", "/x/9999999999999.jpg", "/x/1234567890.jpg", "", None,
    ]),
}


def test_infer_date(spark):
    rows = spark.createDataFrame([(p,) for p in DATED], "path string").select("path", dates.infer_date(F.col("path")).alias("d")).collect()
    assert {r.path: r.d for r in rows} == DATED


def test_months_and_roots():
    assert P.parse_months("3, 11,x,3,13,0, 7") == ["03", "11", "07"]
    assert P.parse_months(None) == []
    assert P.effective_roots(["/a", "/b"], ["/c", "/b", "/a"]) == ["/a", "/b"]
    assert P.effective_roots(["/x", "/y", "/z"], ["/p", "/q"]) == []
    assert P.effective_roots([], ["/a"]) == [] and P.effective_roots(["/a"], []) == []
    assert P.roots_to_save(["/a", "/b"], ["/a", "/b"]) == [] and P.roots_to_save(["/a"], ["/a", "/b"]) == ["/a"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bits(spark):
    r = one(spark, bits.bits_of(F.lit("ffffffffffffffff")), bits.bits_of(F.lit("8000000000000000")), bits.bits_of(F.lit("zz")), bits.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")))
    assert list(r) == [-1, -(1 << 63), None, 64]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=20))
def test_bands_hold_near_values(pairs):
    def band(x, i, n):
        low, high = i * 64 // n, (i + 1) * 64 // n
        return x >> low & (1 << (high - low)) - 1

    for a, b in pairs:
        n = (a ^ b).bit_count() + 1
        if n <= 13:
            assert any(band(a, i, 13) == band(b, i, 13) for i in range(13))


def test_haversine(spark):
    def km(*p):
        return one(spark, geo.haversine_km(*[F.lit(float(x)) for x in p]))[0]

    assert km(10, 20, 10, 20) == 0
    assert km(0, 0, 0, 180) == pytest.approx(math.pi * 6371, rel=1e-9)
    assert km(90, 0, 90, 77) == pytest.approx(0, abs=1e-6)
    assert km(0, 179.5, 0, -179.5) == pytest.approx(111.19, abs=0.1)
    (a, b), (c, d) = geo.degree_box(90, 0, 10)
    assert a < 90 < b and d - c > 360


def test_place_names(spark):
    assert geo.parse_place("Paris, France") == ("paris", "FR")
    assert geo.parse_place("cape town south africa") == ("cape town", "ZA")
    assert geo.parse_place("springfield xx") == ("springfield xx", None)
    assert geo.parse_place("springfield us") == ("springfield", "US")
    assert geo.parse_place("bern ch", {"CH"}) == ("bern", "CH")
    assert geo.parse_place("  ") == ("", None)
    r = one(spark, *[geo.name_score(F.lit(n), "notre dame") for n in ("Notre-Dame", "Notre-Dame de Paris", "La Notre Dame", "Notre Ville", "Paris")])
    assert list(r) == [100, 60, 30, 10, None]


def test_frames(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (0.5,), (60.0,), (61.0,), (3600.0,), (7200.0,), (40000.0,)], "d double")
    found = [r.f for r in rows.select(formats.frame_schedule(F.col("d")).alias("f")).collect()]
    assert found[0] == found[1] == [1.0] and found[2] == [0.0]
    assert len(found[3]) == 60 and found[4][-1] == 60.0 and len(found[5]) == 414 and max(map(len, found)) <= 600
    assert len(found[7]) == 600


def test_boxes_and_turns(spark):
    r = one(spark, formats.turned(F.lit(0), -90), formats.class_degrees(F.lit(3)), formats.best_class(F.array(*[F.lit(x) for x in (0.0, 10.0, 0.0, 0.0)])))
    assert r[0] == 270 and r[1] == 270 and r[2]["class"] == 1 and r[2]["degrees"] == 90 and 0.9 < r[2]["prob"] <= 1
    b = one(spark, formats.turn_box(F.lit(90), F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)), formats.turn_box(F.lit(360), F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)))
    assert [round(x, 6) for x in b[0]] == [0.4, 0.1, 0.4, 0.3] and list(b[1]) == [0.1, 0.2, 0.3, 0.4]
    c = one(spark, formats.crop_rect(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.5), F.lit(100), F.lit(80)))[0]
    assert list(c) == [0, 0, 70, 56]
    d = one(spark, formats.downscaled(F.lit(10000), F.lit(10000)))[0]
    assert d.width == 4096 and one(spark, formats.downscaled(F.lit(10), F.lit(20)))[0].height == 20
    assert one(spark, formats.clock(F.lit(75.9)), formats.human_bytes(F.lit(5 * 1024**3)))[:] == ("1:15", "5.0 GB")


def test_paths(spark):
    r = one(spark, *[f(F.lit("/a/b.c/IMG.one.JPG")) for f in (paths.basename, paths.directory, paths.stem, paths.extension)])
    assert list(r) == ["IMG.one.JPG", "/a/b.c", "IMG.one", ".jpg"]
    assert one(spark, paths.stem(F.lit("/a/.hidden")), paths.extension(F.lit("/a/.hidden")))[:] == (".hidden", "")
    assert one(spark, paths.date_folder(F.lit("2003-04")), paths.date_folder(F.lit(None).cast("string")), paths.date_folder(F.lit("2003-04-24 10:00:00")))[:] == (
        "undated", "undated", "2003/04/24",
    )
    assert one(spark, paths.clean_error(F.lit("a\nb"), 2))[0] == "a "


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, vectors.unit(v), vectors.unit(F.array(F.lit(0.0), F.lit(float("nan")))), vectors.l2(v, v))
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0


def test_perceptual_hash(spark):
    import numpy as np

    from lumenfold.functions import bits

    rng = np.random.default_rng(0)
    image = rng.random((32, 32)).cumsum(axis=0).cumsum(axis=1)

    def plainly(x):
        n = len(x)
        low = [sum(x[r][c] * np.cos(np.pi * u * (2 * r + 1) / (2 * n)) * np.cos(np.pi * v * (2 * c + 1) / (2 * n)) for r in range(n) for c in range(n)) for u in range(8) for v in range(8)]
        return f"{int(''.join('1' if w > np.median(low) else '0' for w in low), 2):016x}"

    large = np.kron(image, np.ones((2, 2)))
    rows = [(1, image), (2, image * 3 + 20), (3, large), (4, rng.random((8, 8))), (5, rng.random((4, 4))), (6, np.full((8, 8), np.nan)), (7, None), (8, rng.random((32, 32)))]
    frame = spark.createDataFrame([(i, None if x is None else [float(v) for v in x.ravel()]) for i, x in rows], "id long, image array<double>")
    got = {r.id: r.h for r in frame.select("id", bits.perceptual_hash(F.col("image")).alias("h")).collect()}
    assert all(got[i] == plainly(x) for i, x in rows if i in (1, 2, 3, 4, 8)) and got[5] is got[6] is got[7] is None
    apart = lambda a, b: (int(got[a], 16) ^ int(got[b], 16)).bit_count()
    assert apart(1, 2) <= 1 and apart(1, 3) <= 4 and apart(1, 8) > 12


def test_first_readings_agree_with_all(spark):
    """The leftmost reading by a pattern is what going through all neighbours finds, or it says nothing."""
    import random

    rng = random.Random(7)
    marks = ["_", "-", "__", ".", " ", "", "x", "/"]
    numbers = ["20010203", "19991301", "200102030405", "20010203040506", "20010203246060", "1200", "120000", "2500", "12345", "2001", "02", "3", "31", "1999", "99", "2036", "20010230"]
    paths = []
    for _ in range(4000):
        usual = rng.choice(["/", "_", "-", "."])
        paths.append("/" + "".join(rng.choice(numbers) + (usual if rng.random() < 0.8 else rng.choice(marks)) for _ in range(rng.randrange(1, 6))) + rng.choice(["a.jpg", "/b.jpg", ".jpg"]))
    name = dates.basename(F.col("p"))
    runs, folders = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), F.split("p", "/")
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = frame.select(
        "p",
        dates._first_run(name).alias("a"), dates._readings(runs, 3, dates._run).alias("a_all"),
        dates._first_marked(name).alias("b"), dates._readings(runs, 5, dates._marked).alias("b_all"),
        dates._first_folders(F.col("p"), 3).alias("c"), dates._readings(folders, 4, dates._folders_day, first=1).alias("c_all"),
        dates._first_folders(F.col("p"), 2).alias("d"), dates._readings(folders, 3, dates._folders_month, first=1).alias("d_all"),
    ).collect()
    for k in "abcd":
        assert sum(r[k] is not None for r in rows) > 2, k
        assert [(k, r.p, r[k], r[f"{k}_all"]) for r in rows if r[k] is not None and r[k] != r[f"{k}_all"]] == []


def test_sizes_round_halves_to_even(spark):
    """As the program and SQL print them; 156.25 MB is what one size of the tables comes to."""
    sizes = [0, 1023, 1280, 1792, 1024 * 1024 - 1, 163840000, 163840001, 5 * 1024**3 + 1024**3 // 4, 3 * 1024**5 + 1024**5 // 4 * 3, 2**53]
    units = ["B", "KB", "MB", "GB", "TB", "PB"]

    def plain(n):
        i = max([k for k in range(1, 6) if n >= 1024**k], default=0)
        return f"{n / 1024**i:.1f} {units[i]}" if i else f"{n} B"

    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.human_bytes(F.col("n")).alias("s")).collect()
    assert [(r.n, r.s) for r in rows] == [(n, plain(n)) for n in sizes]


def test_minutes_of_far_years_have_no_sign(spark):
    r = one(spark, *[formats.local_minute(F.lit(float(x))) for x in (0, 253402300799, 253402300800, 899999900000)])
    assert list(r) == ["1970-01-01 00:00", "9999-12-31 23:59", "10000-01-01 00:00", "30489-11-10 12:13"]
