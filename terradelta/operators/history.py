"""Yearly classes and greenness of each region: transitions, outcomes, events, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions.labels import detailed_class, interval_label, interval_short, land_headline, ndvi_action
from terradelta.functions.numbers import percent_text
from terradelta.plans.params import INTERVALS, Thresholds


def dominant(cells: DataFrame, keys: list[str], column: str = "class", t: Thresholds = Thresholds(), sums: tuple[str, ...] = ()) -> DataFrame:
    """The two most frequent classes of each group with their shares; ties by name.

    The second one counts as present from the secondary share on.  cells is
    aggregated once, with sums of other columns and the number of rows on the way.
    """
    counts = cells.groupBy(*keys, column).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in sums])
    has = F.col(column).isNotNull()
    pair = F.when(has, F.struct((-F.col("n")).alias("m"), F.col(column).alias("c")))
    d = counts.groupBy(*keys).agg(F.sum(F.when(has, F.col("n"))).alias("total"), F.sum("n").alias("rows"), *[F.sum(x).alias(x) for x in sums], F.sort_array(F.collect_list(pair)).alias("s"))  # as long as there are classes
    d = d.where(F.size("s") > 0)
    top, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    share = -second["m"] / F.col("total")
    more = ["rows", *sums] if sums else []
    return d.select(*keys, top["c"].alias("class"), (-top["m"] / F.col("total")).alias("class_share"), second["c"].alias("secondary"), share.alias("secondary_share"), F.coalesce(share >= t.secondary, F.lit(False)).alias("secondary_shown"), *more)


def annual(region_year: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The yearly table of each region: classes with shares, what else is there, what changed.

    region_year: (feature_id, year, class, class_share, secondary,
    secondary_share, detail_class, detail_share, ndvi_mean).
    """
    d = transitions(region_year, t)
    shown = F.coalesce(F.col("secondary_share") >= t.secondary, F.lit(False))
    return d.select(
        "feature_id",
        "year",
        "class",
        "class_share",
        detailed_class(F.col("detail_class")).alias("detail"),
        "detail_share",
        F.when(shown, F.concat(F.lit("Also present: "), F.col("secondary"), F.lit(" ("), percent_text(F.col("secondary_share")), F.lit(")"))).alias("also"),
        F.when(F.col("land_changed"), F.lit("Land-cover change")).alias("land_event"),
        F.when(F.col("ndvi_event"), F.concat(F.lit("Vegetation change from "), F.col("previous_year").cast("string"))).alias("ndvi_event"),
        "ndvi_mean",
    )


def transitions(region_year: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """region_year(feature_id, year, class, ndvi_mean) with what changed from the year before."""
    w = Window.partitionBy("feature_id").orderBy("year")
    before, ndvi = F.lag("class").over(w), F.lag("ndvi_mean").over(w)
    d = region_year.withColumn("previous_year", F.lag("year").over(w))
    first = F.col("previous_year").isNull()
    d = d.withColumn("land_changed", ~first & ~before.eqNullSafe(F.col("class"))).withColumn("ndvi_step", F.col("ndvi_mean") - ndvi)
    return d.withColumn("ndvi_event", F.coalesce(F.abs("ndvi_step") >= t.ndvi, F.lit(False)))


def outcomes(changes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per region: whether it stayed, returned or moved, and its greenness from end to end."""
    d = changes.groupBy("feature_id").agg(
        F.min_by("class", "year").alias("first_class"),
        F.max_by("class", "year").alias("last_class"),
        F.bool_or("land_changed").alias("changed"),
        F.min(F.when(F.col("land_changed"), F.col("year"))).alias("first_change_year"),
        F.count_if("land_changed").alias("n_changes"),
        F.count_if("ndvi_event").alias("n_ndvi_events"),
        (F.max_by("ndvi_mean", "year") - F.min_by("ndvi_mean", "year")).alias("ndvi_change"),
    )
    same = F.col("first_class").eqNullSafe(F.col("last_class"))
    d = d.withColumn("outcome", F.when(~F.col("changed"), "stayed").when(same, "returned").otherwise("moved"))
    d = d.withColumn("headline", land_headline(F.col("outcome"), F.col("first_class"), F.col("last_class")))
    direction = F.when(F.col("ndvi_change") >= t.ndvi, "greening").when(F.col("ndvi_change") <= -t.ndvi, "browning").when(F.col("ndvi_change").isNotNull(), "stable")
    return d.withColumn("ndvi_direction", direction).withColumn("ndvi_action", ndvi_action(F.col("ndvi_change")))


def timeline(wide: DataFrame, region_year: DataFrame, key: str = "feature_id") -> DataFrame:
    """A row per region and interval: labels, change, strong share, greenness of its end year.

    wide: regions with a column for each interval.  A region's years become one
    row of columns, so regions are joined once each and unfold afterwards.
    """
    ends = {iv: int(iv.split("_")[1]) for iv in INTERVALS}
    years = region_year.groupBy(key).agg(*[F.max(F.when(F.col("year") == y, F.col("ndvi_mean"))).alias(f"_ndvi_{iv}") for iv, y in ends.items()])
    rows = F.array(*[F.struct(F.lit(iv).alias("interval"), F.col(f"change_{iv}").alias("change"), F.col(f"hotspot_{iv}").alias("hotspot"), F.col(f"_ndvi_{iv}").alias("ndvi_mean")) for iv in INTERVALS])
    d = wide.join(years, key, "left").select("feature_id", F.inline(rows))
    return d.select("feature_id", "interval", interval_label(F.col("interval")).alias("label"), interval_short(F.col("interval")).alias("short_label"), "change", "hotspot", "ndvi_mean")
