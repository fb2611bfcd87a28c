"""Filtering, counting and summarising regions, and finding what holds a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.labels import behaviour_colour, behaviour_label, interval_label, shard_of, zero_padded
from terradelta.functions.places import in_ring, in_rings
from terradelta.operators.quadtree import MOST, Quadtree
from terradelta.plans.params import ENDPOINT, INTERVALS, RegionFilter
from terradelta.session import small_or_not, stored, use_checkpoints


def select_regions(regions: DataFrame, f: RegionFilter = RegionFilter()) -> DataFrame:
    return regions.where(f.conditions())


def count_regions(regions: DataFrame, f: RegionFilter = RegionFilter()) -> DataFrame:
    """How many pass, of how many, by type."""
    ok = f.predicate()
    cold = F.col("feature_type").eqNullSafe(F.lit("coldspot_patch"))
    return regions.agg(F.count_if(ok).alias("shown"), F.count_if(ok & ~cold).alias("hot"), F.count_if(ok & cold).alias("cold"), F.count("*").alias("total"))


def behaviour_counts(regions: DataFrame) -> DataFrame:
    d = regions.groupBy("behaviour").agg(F.count("*").alias("regions"))
    return d.select("behaviour", behaviour_label(F.col("behaviour")).alias("label"), behaviour_colour(F.col("behaviour")).alias("colour"), "regions")


def evidence_counts(regions: DataFrame) -> DataFrame:
    """Regions with each signal and with all of them, in one pass."""
    has = {k: F.coalesce(F.col(c), F.lit(False)) for k, c in (("embedding", "embedding_signal"), ("dea", "dea_signal"), ("ndvi", "ndvi_signal"))}
    return regions.agg(*[F.count_if(c).alias(k) for k, c in has.items()], F.count_if(has["embedding"] & has["dea"] & has["ndvi"]).alias("all_three"))


def stacked_intervals(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interval, change, hotspot) from the columns change_<iv> and hotspot_<iv>, by one scan."""
    rows = F.array(*[F.struct(F.lit(i).alias("interval"), F.col(f"change_{i}").alias("change"), F.col(f"hotspot_{i}").alias("hotspot")) for i in INTERVALS])
    return wide.select(*keys, F.inline(rows))


def wide_intervals(long: DataFrame, keys: list[str]) -> DataFrame:
    """Back to one row; the list of intervals is given, so no extra job looks for it."""
    return long.groupBy(*keys).pivot("interval", list(INTERVALS)).agg(F.first("change"))


def with_details(regions: DataFrame, details: DataFrame, order: str = "ord") -> DataFrame:
    """regions with their details, where there are any; of details of one id the last counts."""
    rest = [c for c in details.columns if c != "feature_id"]
    last = details.groupBy("feature_id").agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("d"))
    return regions.join(last.select("feature_id", *[F.col(f"d.{c}").alias(c) for c in rest if c != order]), "feature_id", "left")


def hectares(area_m2: Column) -> Column:
    return area_m2 / 10000


def metric(details: DataFrame, interval: str) -> DataFrame:
    """(feature_id, change, strong_fraction, change_label, fraction_label) of one period, or from the first to the last year."""
    whole = interval == ENDPOINT
    change = "endpoint_change_mean" if whole else f"annual_change_{interval}"
    strong = "endpoint_hotspot_fraction" if whole else f"annual_hotspot_{interval}_fraction"
    label = F.lit("Start-to-end change") if whole else F.concat(F.lit("Change "), interval_label(F.lit(interval)))
    fraction = F.lit("Area with strong change" if whole else "Area with strong change this period")
    return details.select("feature_id", F.col(change).alias("change"), F.col(strong).alias("strong_fraction"), label.alias("change_label"), fraction.alias("fraction_label"))


def with_overlay(rows: DataFrame, overlays: DataFrame) -> DataFrame:
    """rows(interval, ...) with the path of each interval's overlay; overlays(interval, overlay) has a row per interval."""
    return rows.join(F.broadcast(overlays), "interval", "left")


def with_shard(regions: DataFrame, size: int = 1000) -> DataFrame:
    d = regions.withColumn("shard", shard_of(F.col("feature_id"), size))
    return d.withColumn("shard_file", F.concat(F.lit("regions_"), zero_padded(F.col("shard")), F.lit(".json")))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count("*").alias("points"))


def hit(points: DataFrame, areas: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point_id, area_id): the least area that holds each point.

    areas: (area_id, ring array<struct<x,y>>).  Both sides are dealt to grid
    cells of the given size, areas to every cell their box meets, so the join is
    on equal cells; the box and the ray test follow.
    """
    box = areas.select("area_id", "ring", F.array_min(F.transform("ring", lambda p: p["x"])).alias("w"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("e"), F.array_min(F.transform("ring", lambda p: p["y"])).alias("s"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("n"))
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    tiles = box.withColumn("gx", F.explode(F.sequence(at(F.col("w")), at(F.col("e"))))).withColumn("gy", F.explode(F.sequence(at(F.col("s")), at(F.col("n")))))
    d = points.withColumn("gx", at(F.col("lon"))).withColumn("gy", at(F.col("lat"))).join(tiles, ["gx", "gy"])
    d = d.where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    d = d.where(in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    return d.groupBy("point_id").agg(F.min("area_id").alias("area_id"))


def hit_top(points: DataFrame, areas: DataFrame, most: int = MOST) -> DataFrame:
    """(point_id, area_id, draw): the area drawn last of those that hold each point, the least id of equals.

    points: (point_id, lon, lat); areas: (area_id, draw, rings array<array<struct<x,y>>>).
    An area is what an odd number of its rings encloses, so later rings cut holes
    or add islands.  Points of one place are tested once, and of areas with the
    same rings only the one on top.  The squares of the join follow the places:
    where these are dense, squares are small, so a crowded part costs as many tests
    as it has different places times different shapes there, in many tasks.
    """
    where = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("point_id", "lon", "lat")
    spots, _ = stored(where.select("lon", "lat").distinct(), "hit-spots")  # equal places have one answer
    best = areas.groupBy("rings").agg(F.max(F.struct("draw", (-F.col("area_id")).alias("a"))).alias("b"))  # of equal shapes one is on top of the others
    best = best.select("b", "rings")
    tree = Quadtree(spots, most)
    ends = lambda axis: F.transform(F.flatten("rings"), lambda p: p[axis])
    boxes = best.select("b", "rings", F.array_min(ends("x")).alias("w"), F.array_max(ends("x")).alias("e"), F.array_min(ends("y")).alias("s"), F.array_max(ends("y")).alias("n"))
    tiles = tree.meeting(boxes.where("w is not null"))
    d = tree.of_points(spots, F.struct("lon", "lat")).join(tiles, ["level", "gx", "gy", "salt"])
    d = d.where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    d = d.where(in_rings(F.col("lon"), F.col("lat"), F.col("rings")))
    top = small_or_not(d.groupBy("lon", "lat").agg(F.max("b").alias("t")), "hit-top")
    each = where.join(top, ["lon", "lat"]).groupBy("point_id").agg(F.max("t").alias("t"))
    return each.select("point_id", (-F.col("t.a")).alias("area_id"), F.col("t.draw").alias("draw"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Edges between grid cells (cell_id, x, y) of one state that share a side."""
    moved = cells.select("state", F.col("cell_id").alias("other"), F.inline(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (0, 1))])))
    return cells.join(moved, ["state", "x", "y"]).select(F.least("cell_id", "other").alias("a"), F.greatest("cell_id", "other").alias("b"))


def patches(cells: DataFrame, rounds: int = 50) -> DataFrame:
    """(cell_id, patch): connected cells of one state carry their least id.

    Labels spread along edges and jump to the label of their label, so the
    rounds grow with the logarithm of a patch's width; each round is written by
    checkpoint().  A round at least halves the longest way to a least id, so 50 rounds
    are enough for 2**50 cells.
    """
    use_checkpoints(cells.sparkSession)
    edges = neighbours(cells)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = cells.select("cell_id", F.col("cell_id").alias("patch")).checkpoint()
    for _ in range(rounds):
        near = both.join(label, F.col("b") == F.col("cell_id")).groupBy("a").agg(F.min("patch").alias("m"))
        new = label.join(near, F.col("cell_id") == F.col("a"), "left").select("cell_id", F.col("patch").alias("old"), F.least("patch", F.coalesce("m", "patch")).alias("patch"))
        jump = new.select(F.col("cell_id").alias("k"), F.col("patch").alias("further"))
        new = new.join(jump, F.col("patch") == F.col("k")).select("cell_id", "old", F.col("further").alias("patch")).checkpoint()
        label = new.select("cell_id", "patch")
        if new.where("patch <> old").isEmpty():
            return label
    raise RuntimeError("patches did not settle")
