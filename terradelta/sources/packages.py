"""JSON packages: features, sharded details, releases, metadata.

Schemas are explicit, so nothing is inferred by a second scan, and malformed
files fail at once.  Details are stored by shard; a lookup adds the literal
shard of its id, which prunes all other folders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.functions.labels import shard_of
from terradelta.plans.params import INTERVALS

SHARD_SIZE = 1000
REGION = "feature_id string, feature_type string, behaviour string, area_ha double, lat double, lon double, ndvi_direction string, dea_signal boolean, ndvi_signal boolean, " + ", ".join(f"change_{i} double, hotspot_{i} double" for i in INTERVALS)
REGION_YEAR = "ndvi_mean double, ndvi_change_event boolean, dea_level3 string, dea_level3_share double, dea_level3_secondary string, dea_level3_secondary_share double, dea_level4 string, dea_level4_share double"
DETAIL = (
    "feature_id string, feature_type string, region_behaviour string, lat double, lon double, area_m2 double, endpoint_change_mean double, endpoint_hotspot_fraction double, "
    + ", ".join(f"annual_change_{i} double, annual_hotspot_{i}_fraction double" for i in INTERVALS)
    + ", repeat_change_coverage double, mean_hotspot_intervals double, maximum_hotspot_intervals int, variance_mean double, slope_mean double, cumulative_change_mean double, strongest_change_interval string, overall_activity string, year_to_year_pattern string, change_intensity_trend string, embedding_change_signal boolean, dea_transition_signal boolean, ndvi_change_signal boolean, dea_level3_changed boolean, dea_level3_first_change_year int, ndvi_endpoint_change double, ndvi_direction string"
    + f", annual_context map<string, struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', REGION_YEAR)}>>"
)
CATALOGUE = "maximum_capture_distance_days int, years map<string, array<int>>, releases map<string, struct<release_date: date, metadata_service: string>>"


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Properties of a feature collection, and its geometry as JSON text.

    A file that is no collection fails; a property of the wrong type ("true"
    for true) is missing.
    """
    f = json_object(spark, path, "features array<struct<geometry: string, properties: string>>")
    f = f.select(F.explode("features").alias("f")).select(F.from_json("f.properties", REGION).alias("p"), "f.geometry")
    return f.select("p.*", "geometry")


def details(spark: SparkSession, path: str) -> DataFrame:
    """Region details of one or many shard files: an object of records by id, made rows."""
    inner = re.sub(r"^(\w+) |, (\w+) (?=[a-z])", lambda m: f"{m[1]}:" if m[1] else f", {m[2]}:", DETAIL)
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{inner}>>", {"mode": "FAILFAST"})).alias("key", "d"))
    return rows.select("key", "d.*").withColumn("feature_id", F.coalesce("feature_id", "key")).drop("key")


def write_details(details: DataFrame, path: str, size: int = SHARD_SIZE) -> None:
    sharded = details.withColumn("shard", shard_of(F.col("feature_id"), size))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def stored_details(spark: SparkSession, path: str) -> DataFrame:
    """The sharded details; Spark remembers the list of folders, as callers would remember shards."""
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, by: str = "feature_id", buckets: int = 16) -> DataFrame:
    """df as a table at path whose rows are dealt to buckets by a key and sorted by it.

    Tables with equal buckets of a key are joined and grouped by it without
    an exchange, as often as they are read: what a memo of shards is for.
    """
    df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def shard_number(feature_id: str, size: int = SHARD_SIZE) -> int | None:
    digits = re.sub("[^0-9]", "", feature_id)
    return (int(digits) - 1) // size if digits else None


def detail(stored: DataFrame, feature_id: str, size: int = SHARD_SIZE) -> DataFrame:
    """The record of one id; the shard's literal prunes the scan."""
    shard = shard_number(feature_id, size)
    return stored.where((F.col("shard") == shard) & (F.col("feature_id") == feature_id)) if shard is not None else stored.limit(0)


def context(details: DataFrame) -> DataFrame:
    """One row per region and year from the nested yearly context."""
    rows = details.select("feature_id", F.explode("annual_context").alias("year", "c"))
    return rows.select("feature_id", F.col("year").cast("int").alias("year"), "c.*")


def candidates(catalogue: DataFrame) -> DataFrame:
    """(year, ordinal, release_num, release_date, metadata_service) of releases that have a service."""
    years = catalogue.select(F.explode("years").alias("year", "nums")).select(F.col("year").cast("int").alias("year"), F.posexplode("nums").alias("ordinal", "release_num"))
    releases = catalogue.select(F.explode("releases").alias("id", "r")).select(F.col("id").cast("int").alias("release_num"), "r.*")
    return years.join(releases.where("metadata_service <> ''"), "release_num").select("year", "ordinal", "release_num", "release_date", "metadata_service")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).format(kind).save(path)
