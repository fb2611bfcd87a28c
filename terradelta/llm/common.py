"""Helpers that the training-data operators share.

Everything that outlives one job is written as Parquet below the session's
``spark.checkpoint.dir``, which the driver and all executors share, so that a
lost executor costs a re-read and never a recomputation from the start.
"""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: White space between words, for split().
GAP = "[\\x20\\x09-\\x0D]+"
#: A table of at most so many bytes on disk and so many rows may be broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 24 << 20, 2_000_000


#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever the driver found it.

    Also makes Arrow batches smaller than by default: texts are long.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    package = Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not package.is_dir():
        return
    where = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="terradelta-")), "terradelta.zip")
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(where)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only if none is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="terradelta-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, where: str) -> None:
    try:
        fs, path = _path(spark, where)
        fs.delete(path, True)
    except Exception as e:  # the session may have ended; the folder is scratch
        logging.getLogger(__name__).info("%s stays: %s", where, e)


def stored_bytes(spark: SparkSession, where: str) -> int:
    fs, path = _path(spark, where)
    return int(fs.getContentSummary(path).getLength())


_made: list[tuple[str, str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new place in the shared folder, emptied at the driver's end, or by sweep() if it isn't kept."""
    where = f"{shared_dir(spark)}/terradelta/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    if not keep:
        _made.append((spark.sparkContext.applicationId, where))
    return where


def sweep(spark: SparkSession) -> None:
    """Remove this application's scratch tables; only for callers whose earlier results are all written."""
    for made in [m for m in _made if m[0] == spark.sparkContext.applicationId]:
        remove(spark, made[1])
        _made.remove(made)


def stored(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back; its place comes second."""
    spark = df.sparkSession
    where = scratch(spark, name, keep)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where), where


def small_or_not(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Store df; mark it for a broadcast only if what was written is below limit, in rows too.

    A larger table keeps the ordinary join, whose skewed partitions Spark splits.
    """
    back, where = stored(df, name)
    small = stored_bytes(df.sparkSession, where) <= limit and back.count() <= BROADCAST_ROWS  # the count reads footers
    return F.broadcast(back) if small else back


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge list; root is the component's least node.

    Alternates large-star and small-star steps, each one aggregation per node;
    hubs are combined before they are shuffled.  Every round is stored.
    """
    link = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    link, _ = stored(link.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-cc")
    before = None
    for _ in range(rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        link, _ = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-cc")
        now = link.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    roots = link.select(F.col("v").alias("node")).distinct()
    return link.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))).distinct()
