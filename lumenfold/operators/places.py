"""Places: near, on the map, in boxes of a grid, by name; and photos that lack one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import predicates as P
from lumenfold.functions import geo as G
from lumenfold.operators.timeline import with_meta
from lumenfold.session import checkpointed

#: Cubes in which a nearest city is looked for have sides so many times as long the next time.
WIDER = 4
#: The smallest tiles of a map: 2**14 a side, some 2 km.
MOST_ZOOM = 14
#: Where a square map ends.
MOST_LAT = 85.05112878


def nearby(files: DataFrame, meta: DataFrame, lat: float, lon: float, radius_km: float = 5.0, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Visible photos in a radius, the nearest first. The box is tested first: scans can skip by it."""
    box = G.circle_box(lat, lon, radius_km)
    near = meta.where(P.in_box(*box)).withColumn("km", G.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("km") <= radius_km)
    rows = files.where(P.visible()).join(near, F.col("id") == F.col("file_id")).select("id", "path", "lat", "lon", "km")
    if limit is None:
        return rows
    rows = rows.orderBy("km", "id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def map_points(files: DataFrame, meta: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    return with_meta(files, meta, "inner").where(P.geolocated() & P.under_roots(roots)).select("id", "content_hash", "lat", "lon", "taken_at")


def map_grid(files: DataFrame, meta: DataFrame, size: float = 10.0) -> DataFrame:
    """Photos in each cell of a grid, for a map that is zoomed out."""
    rows = with_meta(files, meta, "inner").where(P.geolocated())
    y, x = G.grid_cell(F.col("lat"), F.col("lon"), size)
    return rows.groupBy(y.alias("cell_lat"), x.alias("cell_lon")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of a place in the square map with 2**zoom tiles a side; beyond its edges (MOST_LAT) the outermost."""
    n = 1 << zoom
    y = F.radians(F.greatest(F.lit(-MOST_LAT), F.least(F.lit(MOST_LAT), lat)))
    across, down = (lon + 180.0) / 360.0, (1.0 - F.log(F.tan(y) + 1.0 / F.cos(y)) / math.pi) / 2.0
    return tuple(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n))).cast("int") for v in (across, down))


def map_tiles(files: DataFrame, meta: DataFrame, most: int = MOST_ZOOM) -> DataFrame:
    """Photos in every tile of every zoom up to ``most``: ``zoom``, ``x``, ``y``, ``n``, the middle of their places, and the first id.

    Photos are counted once, in the smallest tiles; larger ones are sums of those.
    """
    rows = with_meta(files, meta, "inner").where(P.geolocated())
    x, y = _tile(F.col("lat"), F.col("lon"), most)
    sums = (F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("id").alias("first_id"))
    smallest = rows.groupBy(x.alias("x"), y.alias("y")).agg(*sums).withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(most))))
    up = [F.expr(f"shiftright({c}, {most} - zoom)").alias(c) for c in "xy"]
    tiles = smallest.groupBy("zoom", *up).agg(F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("first_id").alias("first_id"))
    return tiles.select("zoom", "x", "y", "n", (F.col("lat") / F.col("n")).alias("lat"), (F.col("lon") / F.col("n")).alias("lon"), "first_id")


def map_markers(tiles: DataFrame, zoom: int, largest: int = 1000, most: int = MOST_ZOOM) -> DataFrame:
    """What a map shows at ``zoom``: its tiles, and of a tile with more than ``largest`` photos the tiles within it, down to the smallest."""
    of = tiles.select((F.col("zoom") + 1).alias("zoom"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("n").alias("parent"))
    below = tiles.where(F.col("zoom") >= zoom).withColumn("px", F.shiftright("x", 1)).withColumn("py", F.shiftright("y", 1))
    shown = below.join(of, ["zoom", "px", "py"], "left").where(
        ((F.col("zoom") == zoom) | (F.col("parent") > largest)) & ((F.col("n") <= largest) | (F.col("zoom") == most))
    )
    return shown.select("zoom", "x", "y", "n", "lat", "lon", "first_id")


def untagged_count(files: DataFrame, meta: DataFrame) -> DataFrame:
    return with_meta(files, meta).where(P.untagged()).agg(F.count(F.lit(1)).alias("n"))


def same_day(files: DataFrame, meta: DataFrame, row_id: int) -> DataFrame:
    """Other untagged photos of the day of one photo."""
    day = meta.where(F.col("file_id") == row_id).select(F.substring("taken_at", 1, 10).alias("day"))
    rows = with_meta(files, meta, "inner").where(P.untagged() & (F.col("id") != row_id)).withColumn("day", F.substring("taken_at", 1, 10))
    return rows.join(F.broadcast(day), "day").select("id", "taken_at")  # one day


def by_ids(files: DataFrame, meta: DataFrame, ids: list[int]) -> DataFrame:
    return with_meta(files, meta).where(F.col("id").isin(ids)).select("id", "path", "taken_at", "lat", "lon")


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The place on a sphere of radius one, where there are no poles and no date line."""
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _cell(xyz: list[Column], side: float, step: Sequence[int] = (0, 0, 0)) -> Column:
    return F.struct(*[(F.floor(v / side) + d).cast("int").alias(n) for n, v, d in zip("xyz", xyz, step)])


def reverse_geocode(points: DataFrame, cities: DataFrame) -> DataFrame:
    """The nearest city of every point: ``id``, ``city``, ``region``, ``country``, ``km``; of equally near ones the first by name. Points without a place are left out.

    Distinct coordinates only are looked up. Space is cut into cubes: a point looks in its cube and the 26 around it, and a city within a cube's side is
    the answer, as all that is no farther is among these. The others look again in cubes with sides WIDER times as long, until a cube holds the globe.
    """
    rows = points.where("lat is not null and lon is not null")
    left = checkpointed(rows.select("lat", "lon").distinct())
    named = cities.select(F.struct(F.col("name").alias("city"), "region", "country").alias("place"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    # In radii of the globe: twice as far as cities would stand apart if they were evenly spread.
    side, found = min(2.0, 2 * math.sqrt(4 * math.pi / max(1, cities.count()))), []
    while True:
        here = _on_sphere(F.col("c_lat"), F.col("c_lon"))
        around = named.withColumn("cell", F.explode(F.array(*[_cell(here, side, step) for step in product((-1, 0, 1), repeat=3)])))
        met = left.withColumn("cell", _cell(_on_sphere(F.col("lat"), F.col("lon")), side)).join(around, "cell")
        best = met.groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), F.col("place"))).alias("b"))
        # The straight way through the sphere is what cubes measure.
        straight = 2 * F.sin(F.col("b.km") / (2 * G.EARTH_KM))
        found.append(checkpointed(best.where(straight <= side * (1 - 1e-9)) if side < 2 else best))
        left = checkpointed(left.join(found[-1], ["lat", "lon"], "left_anti"))
        if side >= 2 or left.isEmpty():
            break
        side *= WIDER
    return rows.join(reduce(DataFrame.unionByName, found), ["lat", "lon"]).select("id", "b.place.*", F.col("b.km").alias("km"))


def with_country_names(rows: DataFrame, names: DataFrame, column: str = "country") -> DataFrame:
    """``rows`` with ``country_name``: the name of a code, or the code itself where ``names`` (code, name) has none."""
    known = names.groupBy(F.col("code").alias("known_code")).agg(F.min("name").alias("known_name"))
    found = rows.join(known, F.col(column) == F.col("known_code"), "left")
    return found.select(*rows.columns, F.coalesce("known_name", column).alias("country_name"))


def place_search(query: str, cities: DataFrame, landmarks: DataFrame, limit: int = 8, codes: set[str] = frozenset()) -> DataFrame:
    """Cities and landmarks by name, the best match first, then the most important. A country at the end narrows cities."""
    wanted, country = G.parse_place(query, codes)
    empty = cities.where("false")
    if not wanted:
        wanted, cities, landmarks = "-", empty, landmarks.where("false")
    c = cities.where(F.col("country") == country) if country else cities
    both = c.select(
        "name", "region", "country", "lat", "lon", G.name_score(F.col("name"), wanted).alias("score"),
        F.least(F.lit(1.0), F.col("population") / 1e6).alias("importance"), F.lit(0).alias("source"),
    ).unionByName(
        landmarks.select(
            "name", F.col("kind").alias("region"), F.lit("").alias("country"), "lat", "lon", G.name_score(F.col("name"), wanted).alias("score"),
            F.least(F.lit(1.0), F.col("sitelinks") / 40.0).alias("importance"), F.lit(1).alias("source"),
        )
    )
    return both.where("score is not null").orderBy(F.desc("score"), F.desc("importance"), "source", "name", "lat", "lon").limit(limit).drop("source")
