"""Series for charts: domains, positions, ramps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions.numbers import CHANGE_STOPS, OPACITY_STOPS, finite, padded_domain, ramp, ramp_bucket

# fixed values: the chart's frame
LEFT, RIGHT, TOP, BOTTOM, WIDTH, HEIGHT = 31, 8, 9, 21, 350, 116


def domain(series: DataFrame, key: str, value: str) -> DataFrame:
    d = series.withColumn("v", finite(F.col(value))).groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("points"))
    low, high = padded_domain(F.col("low"), F.col("high"))
    return d.where("points > 0").select(key, "low", "high", "points", low.alias("axis_low"), high.alias("axis_high"))


def placed(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """x by place in the series, y by value; missing values keep their place but give no point."""
    w = Window.partitionBy(key)
    d = series.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    d = d.join(domain(series, key, value), key)
    x = LEFT + F.col("at") * (WIDTH - LEFT - RIGHT) / F.greatest(F.lit(1), F.col("n") - 1)
    span = F.col("axis_high") - F.col("axis_low")
    y = TOP + (F.col("axis_high") - finite(F.col(value))) / F.when(span == 0, 1.0).otherwise(span) * (HEIGHT - TOP - BOTTOM)
    return d.select(key, order, x.alias("x"), y.alias("y")).where("y is not null")


def painted(rows: DataFrame, change: str, hotspot: str) -> DataFrame:
    """Bucket of the colour ramp and opacity; missing counts as 0, cold areas have their own opacity."""
    cold = F.col("feature_type").eqNullSafe(F.lit("coldspot_patch"))
    opacity = F.when(cold, F.lit(0.42)).otherwise(ramp(F.coalesce(hotspot, F.lit(0.0)), OPACITY_STOPS))
    return rows.withColumn("bucket", F.when(cold, F.lit(-1)).otherwise(ramp_bucket(F.coalesce(change, F.lit(0.0)), CHANGE_STOPS))).withColumn("opacity", opacity)


def neighbours(series: DataFrame, key: str, order: str) -> DataFrame:
    """The step before and after each row; the ends step to themselves."""
    w = Window.partitionBy(key).orderBy(order)
    return series.withColumn("previous", F.coalesce(F.lag(order).over(w), order)).withColumn("next", F.coalesce(F.lead(order).over(w), order))
