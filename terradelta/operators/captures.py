"""Captures: duplicates, the top of each stack, the nearest in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions.dates import capture_date, capture_kind, day_distance, middle_of
from terradelta.functions.labels import first_of
from terradelta.functions.places import NEARBY, nearby_box, within_box
from terradelta.plans.params import Thresholds

NO_RESOLUTION = 9999.0


SALTS = 16


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last one, with the place of the first.

    One sort of the rows, in which a key is dealt to SALTS tasks at most, so
    that a key of a third of all rows is not in one task; then one of what these
    leave, which is SALTS rows a key.
    """
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    first = [f"first_{c}" for c in order]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    d = salted.select(*keys, *order, *rest, *[F.first(c).over(w).alias(f) for c, f in zip(order, first, strict=True)], F.lead(F.lit(1)).over(w).alias("_more")).where("_more is null")
    least = F.min(F.struct(*first)).over(Window.partitionBy(*keys))
    d = d.withColumn("_f", least).withColumn("_more", F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order))).where("_more is null")
    return d.select(*keys, *[c for c in rows.columns if c not in keys], *[F.col(f"_f.{f}").alias(f) for f in first])


def top_of(rows: DataFrame, keys: list[str], draw: Column, resolution: Column, tie: list[str]) -> DataFrame:
    """The row drawn last of each key, the finest of equals; nothing steps in if its date is bad."""
    fine = F.when(F.coalesce(resolution, F.lit(0.0)) == 0, F.lit(NO_RESOLUTION)).otherwise(resolution)
    d = rows.groupBy(*keys).agg(F.min(F.struct((-F.coalesce(draw, F.lit(0))).alias("d"), fine.alias("r"), F.struct(*tie).alias("t"), F.struct(*rows.columns).alias("row"))).alias("b"))
    return d.select("b.row.*")


def top_dated(rows: DataFrame, keys: list[str], draw: Column, resolution: Column, date_text: str, tie: list[str]) -> DataFrame:
    """top_of, with its day; a key whose top row has no valid date gives none."""
    return top_of(rows, keys, draw, resolution, tie).withColumn("day", capture_date(F.col(date_text))).where("day is not null")


def identify(requests: DataFrame, snapshot: DataFrame, delta: float = NEARBY) -> DataFrame:
    """The capture on top at each requested point: (request_id, day, resolution, provider), for those that have one.

    requests: (request_id, user_id, seq, lon, lat); only the latest of a user counts.
    snapshot: (lon, lat, object_id, src_date, resolution, draw, description, name);
    captures within delta of the point are candidates, equal ones count once.
    Both sides are dealt to squares of twice delta, so the join is on equal squares.
    """
    last = requests.groupBy("user_id").agg(F.max(F.struct("seq", "request_id", "lon", "lat")).alias("r")).select("r.*")
    size = 2 * delta
    at = lambda c: F.floor(c / size).cast("long")
    west, south, east, north = nearby_box(F.col("lon"), F.col("lat"), delta)
    near = last.withColumns({"west": west, "south": south, "east": east, "north": north})
    near = near.withColumn("gx", F.explode(F.sequence(at(F.col("west")), at(F.col("east"))))).withColumn("gy", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))
    shots = snapshot.select(F.col("lon").alias("x"), F.col("lat").alias("y"), "object_id", "src_date", "resolution", "draw", "description", "name").withColumns({"gx": at(F.col("x")), "gy": at(F.col("y"))})
    d = near.join(shots, ["gx", "gy"]).where(within_box(F.col("x"), F.col("y"), *map(F.col, ("west", "south", "east", "north"))))
    d = d.dropDuplicates(["request_id", "object_id", "src_date", "resolution", "description"])
    top = top_dated(d, ["request_id"], F.col("draw"), F.col("resolution"), "src_date", ["object_id", "src_date", "description"])
    return top.select("request_id", "day", "resolution", first_of(F.col("description"), F.col("name")).alias("provider"))


def _chosen(d: DataFrame, key: str, days: int) -> DataFrame:
    """d(key, year, b struct<distance, fine, capture_id, day>) as a table."""
    available = F.coalesce(F.col("b.distance") <= days, F.lit(False))
    kind = F.when(available, capture_kind(F.col("b.day"), F.col("year"), F.lit(False)))
    return d.select(key, "year", F.col("b.day").alias("nearest_day"), F.col("b.distance").alias("distance_days"), available.alias("available"), F.when(available, F.col("b.capture_id")).alias("capture_id"), kind.alias("kind"))


def _daily(captures: DataFrame, key: str) -> DataFrame:
    """The best capture of each key and day: the finest, a missing resolution last, then the least id."""
    fine = F.struct(F.coalesce("resolution", F.lit(float("inf"))).alias("fine"), F.col("capture_id").alias("capture_id"))
    return captures.where("day is not null").groupBy(key, "day").agg(F.min(fine).alias("c"))


def nearest(targets: DataFrame, captures: DataFrame, key: str, days: int = Thresholds.capture_days) -> DataFrame:
    """targets(key, year) each with its nearest capture(key, day, resolution, capture_id).

    The finest of equally near ones, a missing resolution last, then the least
    id.  Every target stays: the nearest day is told even if it is too far, and
    available says whether it is near enough.  Captures are first reduced to one
    per key and day, so a key gives at most its days times its targets as pairs.
    """
    d = targets.join(_daily(captures, key), key, "left").withColumn("distance", day_distance(F.col("day"), F.col("year")))
    pick = F.struct(F.col("distance").alias("distance"), F.col("c.fine").alias("fine"), F.col("c.capture_id").alias("capture_id"), F.col("day").alias("day"))
    return _chosen(d.groupBy(key, "year").agg(F.min(F.when(F.col("day").isNotNull(), pick)).alias("b")), key, days)


def nearest_sorted(targets: DataFrame, captures: DataFrame, key: str, days: int = Thresholds.capture_days) -> DataFrame:
    """The same without pairs: one sort of each key's targets and days.

    The last day with a capture before and the first after each target are the
    only candidates.  A key has as many rows as it has days and targets.
    """
    t = targets.select(key, middle_of(F.col("year")).alias("at"), "year", F.expr("cast(null as struct<day:date,c:struct<fine:double,capture_id:bigint>>)").alias("shot"))
    c = _daily(captures, key).select(key, F.col("day").alias("at"), F.lit(None).cast("int").alias("year"), F.struct("day", F.struct(F.col("c.fine").cast("double").alias("fine"), F.col("c.capture_id").cast("bigint").alias("capture_id")).alias("c")).alias("shot"))
    both = t.unionByName(c)
    w = Window.partitionBy(key).orderBy("at", F.col("year").isNotNull())
    on = Window.unboundedPreceding, 0
    ahead = Window.partitionBy(key).orderBy("at", F.col("year").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    d = both.withColumn("before", F.last("shot", ignorenulls=True).over(w.rowsBetween(*on))).withColumn("after", F.first("shot", ignorenulls=True).over(ahead))
    pick = lambda s: F.when(F.col(s).isNotNull(), F.struct(day_distance(F.col(f"{s}.day"), F.col("year")).alias("distance"), F.col(f"{s}.c.fine").alias("fine"), F.col(f"{s}.c.capture_id").alias("capture_id"), F.col(f"{s}.day").alias("day")))
    return _chosen(d.where("year is not null").select(key, "year", F.least(pick("before"), pick("after")).alias("b")), key, days)
