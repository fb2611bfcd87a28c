"""Coordinates, boxes and polygons, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta.functions.numbers import rounded_to

# fixed value: the form of two coordinates
PAIR = r"^(-?\d{1,3}(?:\.\d+)?)\s*[, ]\s*(-?\d{1,3}(?:\.\d+)?)$"
NEARBY = 0.015


def coordinates(query: Column) -> Column:
    """struct(lon, lat) of a text of two numbers, or NULL.

    A negative number and one above 100 are taken in either order; no other
    pair is a place.
    """
    text = F.trim(query)
    a, b = (F.regexp_extract(text, PAIR, i).try_cast("double") for i in (1, 2))
    place = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    return F.when((a < 0) & (b > 100), place(b, a)).when((a > 100) & (b < 0), place(a, b))


def within_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def nearby_box(lon: Column, lat: Column, delta: float = NEARBY) -> tuple[Column, Column, Column, Column]:
    return lon - delta, lat - delta, lon + delta, lat + delta


def corners(west: Column, south: Column, east: Column, north: Column) -> Column:
    """NW, NE, SE, SW as arrays of lon and lat."""
    return F.array(F.array(west, north), F.array(east, north), F.array(east, south), F.array(west, south))


def centre(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    return (west + east) / 2, (south + north) / 2


def grid_key(lon: Column, lat: Column, digits: int = 3) -> Column:
    return F.concat_ws(":", F.format_string(f"%.{digits}f", rounded_to(lon, digits)), F.format_string(f"%.{digits}f", rounded_to(lat, digits)))


def crossings(lon: Column, lat: Column, ring: Column) -> Column:
    """How many sides of a closed ring (array of struct(x, y)) a ray to the east meets."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        over = (p["y"] > lat) != (q["y"] > lat)
        return F.when(over, lon < (q["x"] - p["x"]) * (lat - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(F.lit(False))

    return F.when(n > 0, F.size(F.filter(sides, crosses))).otherwise(0)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, by ray casting."""
    return crossings(lon, lat, ring) % 2 == 1


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether an odd number of rings encloses a point."""
    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(lon, lat, r)) % 2 == 1


NEAR_ZOOM = 10.5


def lookup_point(detail: Column, feature: Column, marker: Column, zoom: Column, box: Column, middle: Column) -> Column:
    """The place to look at: of the open detail, the chosen feature, the marker, then the box's centre from afar or the map's centre.

    Places are struct<lon, lat>; box is struct<west, south, east, north>.
    """
    lon, lat = centre(box["west"], box["south"], box["east"], box["north"])
    return F.coalesce(detail, feature, marker, F.when(zoom < NEAR_ZOOM, F.struct(lon.alias("lon"), lat.alias("lat"))).otherwise(middle))
