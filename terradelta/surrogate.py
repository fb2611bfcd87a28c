"""Stand-ins built from the star-schema test tables.

The published data is not part of any checkout, so these tables play its parts
and exercise the semantics only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.plans.params import INTERVALS

STRONG = 1.41  # unit vectors of the test data are about that far apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.floor(F.col("vec_id") / 8).cast("long")
    return table(spark, sf_dir, "embeddings").select((cell % 10).alias("region_id"), cell.alias("cell_id"), (2017 + F.col("vec_id") % 8).cast("int").alias("year"), "embedding")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cold = F.col("c_mktsegment") == "HOUSEHOLD"
    behaviour = F.when(cold, "low_change_reference").otherwise(F.element_at(F.array(F.lit("repeated_change"), F.lit("mixed_change"), F.lit("mostly_single_period_change")), (k % 3 + 1).cast("int")))
    direction = F.element_at(F.array(F.lit("greening"), F.lit("browning"), F.lit("stable")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    wide = [c for i, iv in enumerate(INTERVALS) for c in (((k * 11 + 5 * i) % 100 / 100.0).alias(f"change_{iv}"), ((k * 7 + 13 * i) % 20 / 100.0).alias(f"hotspot_{iv}"))]
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("feature_id"),
        k.alias("ord"),
        F.when(cold, "coldspot_patch").otherwise("hotspot_patch").alias("feature_type"),
        behaviour.alias("behaviour"),
        (F.greatest("c_acctbal", F.lit(0.0)) / 400).alias("area_ha"),
        direction.alias("ndvi_direction"),
        (~cold).alias("embedding_signal"),
        (k % 2 == 0).alias("dea_signal"),
        F.when(k % 11 != 0, k % 3 == 0).alias("ndvi_signal"),
        (145.2 + k % 600 / 1000.0).alias("lon"),
        (-38.7 + k % 350 / 1000.0).alias("lat"),
        *wide,
    )


def class_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("class"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def greenness(cents: Column, rows: Column) -> Column:
    """Mean price as a share of 500,000, to the millionth; whole numbers, so that it is the same everywhere."""
    return F.floor((2 * cents + 50 * rows).cast("decimal(30,0)") / (100 * rows).cast("decimal(20,0)")).cast("long") / 1e6


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("region"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("resolution"), F.col("o_orderkey").alias("capture_id"))
