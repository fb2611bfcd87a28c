"""Session settings for runs outside a cluster that brings its own."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many bytes on disk and so many rows may be broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="terradelta-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _remove(spark: SparkSession, where: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as e:  # the session may have ended; the folder is scratch
        logging.getLogger(__name__).info("%s stays: %s", where, e)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, emptied at the driver's end."""
    where = f"{shared_dir(spark)}/terradelta/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, where)
    return where


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back; its place comes second."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def small_or_not(df: DataFrame, name: str) -> DataFrame:
    """Store df; mark it for a broadcast only if what was written is small, in bytes and in rows."""
    back, where = stored(df, name)
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(back) if size <= BROADCAST_BYTES and back.count() <= BROADCAST_ROWS else back


def session(master: str = "local[*]", app: str = "terradelta", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
