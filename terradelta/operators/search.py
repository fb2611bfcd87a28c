"""Search over coordinates, region ids and places, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.functions.labels import behaviour_label, first_of, place_title, trimmed_lower
from terradelta.functions.places import coordinates, within_box
from terradelta.operators.quadtree import MOST, Quadtree
from terradelta.session import small_or_not, stored

PER_SOURCE, IN_ALL, REMOTE, REMOTE_LENGTH = 5, 8, 4, 3
# fixed values: places known without a service
PLACES = [
    ("Wonthaggi", "VIC 3995", 145.591, -38.606),
    ("Inverloch", "VIC 3996", 145.729, -38.633),
    ("Cowes", "VIC 3922", 145.239, -38.452),
    ("San Remo", "VIC 3925", 145.377, -38.521),
    ("Phillip Island", "Bass Coast, VIC", 145.231, -38.487),
    ("Grantville", "VIC 3984", 145.531, -38.407),
    ("Corinella", "VIC 3984", 145.428, -38.414),
    ("Cape Paterson", "VIC 3995", 145.616, -38.672),
    ("Rhyll", "VIC 3923", 145.299, -38.463),
    ("Bass Coast", "Victoria, Australia", 145.56, -38.51),
]
RESULT = ["source", "ord", "name", "detail", "lon", "lat"]


def gazetteer(spark) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "ord long, name string, detail string, lon double, lat double")


def search(query: str, regions: DataFrame, places: DataFrame, remote: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(source, ord, name, detail, lon, lat): at most IN_ALL rows.

    regions(ord, feature_id, behaviour, lon, lat) and places(ord, name, detail,
    lon, lat) keep their order and give PER_SOURCE rows each, taken by a top-k
    that each task starts on its own rows.  remote, a place table inside box,
    is asked only for longer texts that are no coordinates.  Nothing is taken
    as a pattern: % and _ are themselves.
    """
    spark = regions.sparkSession
    text = trimmed_lower(F.lit(query))
    asked = F.length(text) > 0
    point = spark.range(1).select(coordinates(F.lit(query)).alias("p")).where("p is not null")
    point = point.select(F.lit(0).alias("source"), F.lit(0).cast("long").alias("ord"), F.lit("Coordinate").alias("name"), F.format_string("%.5f, %.5f", "p.lat", "p.lon").alias("detail"), "p.lon", "p.lat")
    ids = regions.where(asked & F.startswith(F.lower("feature_id"), text)).orderBy("ord").limit(PER_SOURCE)
    ids = ids.select(F.lit(1).alias("source"), "ord", F.col("feature_id").alias("name"), behaviour_label(F.col("behaviour")).alias("detail"), "lon", "lat")
    own = places.where(asked & F.contains(F.lower(F.concat_ws(" ", "name", "detail")), text)).orderBy("ord").limit(PER_SOURCE).select(F.lit(2).alias("source"), *RESULT[1:])
    found = point.where(asked).unionByName(ids).unionByName(own)
    if remote is not None:
        more = remote.where((F.length(text) >= REMOTE_LENGTH) & coordinates(F.lit(query)).isNull() & F.contains(F.lower("name"), text))
        if box is not None:
            more = more.where(within_box(F.col("lon"), F.col("lat"), *map(F.lit, box)))
        found = found.unionByName(more.orderBy("ord").limit(REMOTE).select(F.lit(3).alias("source"), *RESULT[1:]))
    return found.orderBy("source", "ord").limit(IN_ALL)


def nearest_places(points: DataFrame, places: DataFrame, most: int = MOST) -> DataFrame:
    """(point_id, ord, gap): the nearest place of each point, by squared distance, the least ord of equals.

    points: (point_id, lon, lat); places: (ord, lon, lat).  Points of one spot are
    looked up once.
    """
    best = small_or_not(nearest_of_spots(points, places, most), "nearest-spots")
    return points.join(best, ["lon", "lat"]).select("point_id", "ord", "gap")


def nearest_of_spots(points: DataFrame, places: DataFrame, most: int = MOST) -> DataFrame:
    """(lon, lat, ord, gap): the nearest place of each spot where points(lon, lat) lie.

    Places lie in the leaves of a quadtree of their own, few in each.  A place in
    or beside a spot's leaf tells how far the nearest can be at most; all leaves
    that meet the box of that distance, and no others, are then searched, so the
    result is exact.  Spots are dealt out with them, and each keeps the best of
    every leaf before the last exchange.  Few places are sent to all tasks instead,
    so that no leaf gathers the spots of a whole region in one.
    """
    known = places.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy("lon", "lat").agg(F.min("ord").alias("ord"))
    known, _ = stored(known.select("ord", "lon", "lat"), "nearest-known")
    spots, _ = stored(points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat").distinct(), "nearest-of")
    tree = Quadtree(known, most)
    gap = lambda x, y: (F.col(x) - F.col("lon")) * (F.col(x) - F.col("lon")) + (F.col(y) - F.col("lat")) * (F.col(y) - F.col("lat"))
    own = tree.of_points(spots, F.struct("lon", "lat"))
    reach = F.sqrt(gap("leaf_lon", "leaf_lat")) * (1 + 1e-9) + 1e-12
    boxes = own.where("leaf_lon is not null").select("lon", "lat", (F.col("lon") - reach).alias("w"), (F.col("lon") + reach).alias("e"), (F.col("lat") - reach).alias("s"), (F.col("lat") + reach).alias("n"))
    asked = tree.meeting(boxes)
    shops = tree.of_points(known, F.col("ord")).select("ord", F.col("lon").alias("x"), F.col("lat").alias("y"), "level", "gx", "gy", "salt")
    met = asked.join(small_or_not(shops, "nearest-shops"), ["level", "gx", "gy", "salt"]).select("lon", "lat", gap("x", "y").alias("gap"), "ord")
    best = met.groupBy("lon", "lat").agg(F.min(F.struct("gap", "ord")).alias("b"))
    return best.select("lon", "lat", "b.ord", "b.gap")


def reverse_nearest(points: DataFrame, addresses: DataFrame) -> DataFrame:
    """(feature_id, title, locality) of points(feature_id, feature_type, lon, lat), from the nearest address.

    addresses: (ord, display_name, town, village, city, municipality, county, lon, lat).
    Spots get their locality before they meet the points, so an address that is
    the nearest of many points is met once for each spot.
    """
    locality = first_of(*map(F.col, ("town", "village", "city", "municipality", "county")), F.get(F.split("display_name", ","), F.lit(0)))
    near = nearest_of_spots(points, addresses).select("lon", "lat", "ord").join(addresses.drop("lon", "lat"), "ord")
    near = small_or_not(near.select("lon", "lat", locality.alias("locality")), "nearest-named")
    d = points.select("feature_id", "feature_type", "lon", "lat").join(near, ["lon", "lat"])
    return d.select("feature_id", place_title(F.col("feature_type"), F.col("locality")).alias("title"), "locality")
