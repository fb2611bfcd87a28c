"""Counts of regions kept ready for every setting of the filters, and the choice between them and a scan.

The cube has a row for each type, behaviour, direction, pair of signals and step
of the area slider, with the number of regions of at least that area (running
sums), so a setting reads one row of each group.  Its size is that of the
settings, whatever the number of regions.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.operators.regions import count_regions
from terradelta.plans.params import AREA_STEP, AREA_TOP, RegionFilter

SIGNALS = ("dea_signal", "ndvi_signal")
GROUP = ("feature_type", "behaviour", "ndvi_direction", *SIGNALS)


def cube(regions: DataFrame) -> DataFrame:
    """(feature_type, behaviour, ndvi_direction, dea_signal, ndvi_signal, step, regions)."""
    top = round(AREA_TOP / AREA_STEP)
    area = F.coalesce("area_ha", F.lit(0.0))
    step = F.when(F.isnan(area) | (area >= AREA_TOP), top).otherwise(F.greatest(F.floor(area / AREA_STEP), F.lit(0))).cast("int")
    kind = F.when(F.col("feature_type").eqNullSafe(F.lit("coldspot_patch")), "coldspot_patch").otherwise("hotspot_patch")
    signals = [F.coalesce(s, F.lit(False)).alias(s) for s in SIGNALS]
    exact = regions.groupBy(kind.alias("feature_type"), "behaviour", "ndvi_direction", *signals, step.alias("step")).agg(F.count("*").alias("n"))
    return exact.select(*GROUP, F.explode(F.sequence(F.lit(0), F.col("step"))).alias("step"), "n").groupBy(*GROUP, "step").agg(F.sum("n").alias("regions"))


def fits(f: RegionFilter) -> bool:
    """Whether the cube can answer: no single period, an area that is a step of the slider, known signals."""
    steps = f.min_area / AREA_STEP
    return not (f.active_only and f.interval != "endpoint") and steps == int(steps) and f.min_area <= AREA_TOP and set(f.evidence) <= set(SIGNALS)


def from_cube(cube: DataFrame, f: RegionFilter) -> DataFrame:
    """count_regions() from the cube alone."""
    ok = replace(f, min_area=0.0).predicate() & (F.col("step") == round(max(f.min_area, 0) / AREA_STEP))
    cold = F.col("feature_type") == "coldspot_patch"
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("regions"))), F.lit(0)).alias
    return cube.agg(count(ok)("shown"), count(ok & ~cold)("hot"), count(ok & cold)("cold"), count(F.col("step") == 0)("total"))


def counted(regions: DataFrame, cube: DataFrame, f: RegionFilter) -> DataFrame:
    """count_regions(), from the cube where it can answer, else by a scan; source tells which."""
    ready = fits(f)
    d = from_cube(cube, f) if ready else count_regions(regions, f)
    return d.withColumn("source", F.lit("summary" if ready else "scan"))


def for_settings(cube: DataFrame, settings: DataFrame) -> DataFrame:
    """(setting, shown) of many settings in one pass over the cube.

    settings: (setting, hotspots, coldspots, behaviour, direction, step, dea,
    ndvi, every), null behaviour or direction for all; dea and ndvi tell which
    signals are asked for and every whether both must be there.  The join is on
    equal steps.
    """
    c = cube.select(*GROUP, F.col("step").alias("at"), "regions")
    asked = [(F.col("dea"), F.col("dea_signal")), (F.col("ndvi"), F.col("ndvi_signal"))]
    n = reduce(add, [a.cast("int") for a, _ in asked])
    has = reduce(add, [(a & s).cast("int") for a, s in asked])
    cold = F.col("feature_type") == "coldspot_patch"
    same = lambda own, x: F.col(x).isNull() | (F.col(own) == F.col(x))
    ok = F.when(cold, F.col("coldspots")).otherwise(F.col("hotspots")) & same("behaviour", "wanted") & same("ndvi_direction", "direction")
    ok = ok & ((n == 0) | F.when(F.col("every"), has == n).otherwise(has > 0))
    d = settings.withColumnRenamed("behaviour", "wanted").join(c, F.col("step") == F.col("at"), "left")
    return d.groupBy("setting").agg(F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), F.col("regions"))), F.lit(0)).alias("shown"))
