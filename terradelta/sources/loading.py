"""Loading collections by a manifest: all files or none, and what is broken in a table of its own.

The manifest names the files that belong together.  Every file is judged apart
from the others: it may be missing, be no collection, or hold broken features,
each of which is kept with its file, its place and the reason.  A load is taken
whole or not at all; what was wrong can be read either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.sources.packages import REGION

NUMBERS = ("area_ha", "lat", "lon")


def opened(manifest: DataFrame, path: str, depth: int = 1) -> DataFrame:
    """(file, found, collection, features) of each file of manifest(file) below path; a file has a row.

    A file is called by its own name, or with depth=2 by that of its folder.
    """
    text = manifest.sparkSession.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    text = text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth).alias("file"), F.from_json("value", "type string, features array<string>").alias("c"))
    d = manifest.select("file").distinct().join(text.withColumn("found", F.lit(True)), "file", "left")
    whole = F.coalesce(F.col("c.type") == "FeatureCollection", F.lit(False)) & F.col("c.features").isNotNull()
    return d.select("file", F.coalesce("found", F.lit(False)).alias("found"), whole.alias("collection"), F.when(whole, F.col("c.features")).alias("features"))


def records(files: DataFrame) -> DataFrame:
    """(file, place, reason, raw, record): every feature; reason is null if it is sound, else the first that holds."""
    f = files.select("file", F.posexplode("features").alias("place", "raw"))
    p = F.get_json_object("raw", "$.properties")
    value = lambda c: F.get_json_object(p, f"$.{c}")
    reason = F.when(p.isNull(), "no properties").when(F.coalesce(value("feature_id"), F.lit("")) == "", "no feature_id")
    for c in NUMBERS:
        reason = reason.when(value(c).isNotNull() & value(c).try_cast("double").isNull(), f"{c} is no number")
    return f.select("file", F.col("place").cast("long").alias("place"), reason.alias("reason"), "raw", F.from_json(p, REGION).alias("record"))


def report(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, status, records, broken) of each file of the manifest: ok, missing, no collection, or broken records."""
    n = found.groupBy("file").agg(F.count("*").alias("records"), F.count("reason").alias("broken"))
    d = files.drop("features").join(n, "file", "left").na.fill(0, ["records", "broken"])
    status = F.when(~F.col("found"), "missing").when(~F.col("collection"), "no collection").when(F.col("broken") > 0, "broken records").otherwise("ok")
    return d.select("file", status.alias("status"), "records", "broken")


def broken(found: DataFrame) -> DataFrame:
    return found.where("reason is not null").select("file", "place", "reason", "raw")


def sound(found: DataFrame) -> DataFrame:
    """The records of the features that are sound, whatever became of the others."""
    return found.where("reason is null").select("file", "record.*")


def all_or_none(found: DataFrame, told: DataFrame) -> DataFrame:
    """sound(), or no row at all unless every file of the report is ok."""
    bad = told.where("status <> 'ok'").limit(1).agg(F.count("*").alias("_bad"))  # one row
    return sound(found).join(F.broadcast(bad)).where("_bad = 0").drop("_bad")
