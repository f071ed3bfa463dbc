"""Distances on the globe, boxes, and ranks of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DEGREE_KM = 111.32

#: Names of countries, and the two letters that they stand for.
COUNTRY_ALIASES = {
    "usa": "US", "us": "US", "united states": "US", "america": "US", "uk": "GB", "united kingdom": "GB", "britain": "GB",
    "england": "GB", "scotland": "GB", "wales": "GB", "france": "FR", "germany": "DE", "deutschland": "DE", "italy": "IT",
    "spain": "ES", "espana": "ES", "portugal": "PT", "netherlands": "NL", "holland": "NL", "belgium": "BE", "switzerland": "CH",
    "austria": "AT", "ireland": "IE", "greece": "GR", "poland": "PL", "sweden": "SE", "norway": "NO", "denmark": "DK",
    "finland": "FI", "iceland": "IS", "canada": "CA", "mexico": "MX", "brazil": "BR", "argentina": "AR", "chile": "CL",
    "peru": "PE", "colombia": "CO", "japan": "JP", "china": "CN", "india": "IN", "thailand": "TH", "vietnam": "VN",
    "korea": "KR", "south korea": "KR", "australia": "AU", "new zealand": "NZ", "russia": "RU", "turkey": "TR", "egypt": "EG",
    "morocco": "MA", "south africa": "ZA", "kenya": "KE", "israel": "IL", "czech republic": "CZ", "czechia": "CZ",
    "hungary": "HU", "croatia": "HR", "philippines": "PH", "indonesia": "ID", "malaysia": "MY", "singapore": "SG",
}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degree_box(lat: float, lon: float, radius_km: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Ranges of latitude and longitude as the program that this mirrors takes them; they leave out places at the rim of large circles (:func:`circle_box`)."""
    import math

    d_lat = radius_km / DEGREE_KM
    d_lon = radius_km / (DEGREE_KM * max(math.cos(math.radians(lat)), 1e-6))
    return (lat - d_lat, lat + d_lat), (lon - d_lon, lon + d_lon)


def circle_box(lat: float, lon: float, radius_km: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Ranges that hold every place within the radius by :func:`haversine_km`; where the circle holds a pole or crosses the date line, all longitudes."""
    import math

    angle = radius_km / EARTH_KM * (1 + 1e-9) + 1e-9
    d_lat = math.degrees(angle)
    # Meridians touch the circle nearer to the pole than its middle.
    wide = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
    d_lon = math.degrees(math.asin(wide)) if wide < 1 and abs(lat) + d_lat < 90 else math.inf
    if lon - d_lon < -180 or lon + d_lon > 180:
        d_lon = math.inf
    return (lat - d_lat, lat + d_lat), (lon - d_lon, lon + d_lon)


def parse_place(query: str | None, codes: set[str] = frozenset()) -> tuple[str, str | None]:
    """The name asked for, and the country of its last one or two words."""
    words = (query or "").strip().lower().replace(",", " ").split()
    country = None
    for n in (2, 1):
        if len(words) > n:
            last = " ".join(words[-n:])
            country = COUNTRY_ALIASES.get(last) or (last.upper() if n == 1 and len(last) == 2 and last.upper() in codes else None)
            if country:
                words = words[:-n]
                break
    return " ".join(words).replace("-", " ").strip(), country


def place_and_country(query: Column, codes: set[str] = frozenset()) -> Column:
    """:func:`parse_place` for a column: ``name`` and ``country``. Words are parted by ASCII blanks and commas; null is an empty query."""
    words = F.filter(F.split(F.lower(F.replace(F.coalesce(query, F.lit("")), F.lit(","), F.lit(" "))), r"\s+"), lambda w: w != "")
    n = F.size(words)
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    last = F.when(n > 1, F.try_element_at(words, F.lit(-1)))
    two = F.try_element_at(aliases, F.when(n > 2, F.concat_ws(" ", F.try_element_at(words, F.lit(-2)), last)))
    code = F.when((F.length(last) == 2) & F.upper(last).isin(sorted(codes)), F.upper(last))
    one = F.coalesce(F.try_element_at(aliases, last), code)
    used = F.when(two.isNotNull(), 2).when(one.isNotNull(), 1).otherwise(0)
    name = F.trim(F.replace(F.concat_ws(" ", F.slice(words, F.lit(1), n - used)), F.lit("-"), F.lit(" ")))
    return F.struct(name.alias("name"), F.coalesce(two, one).alias("country"))


def name_score(name: Column, wanted: str) -> Column:
    """100 for the name, 60 for its beginning, 30 for a part, 10 for the first word's beginning, else null. Hyphens are blanks."""
    plain = F.replace(F.lower(name), F.lit("-"), F.lit(" "))
    return (
        F.when(plain == wanted, 100)
        .when(plain.startswith(wanted), 60)
        .when(plain.contains(wanted), 30)
        .when(plain.startswith(wanted.split()[0]), 10)
    )


def grid_cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size).cast("bigint"), F.floor(lon / size).cast("bigint")
