"""Streams that stop and go on: arrivals, restartable runs, idempotent results.

A job has a folder of its own below the shared one: its checkpoint (offsets and
state) and its results, a folder for each micro-batch.  A run works off all that
has arrived and ends; the next one goes on where it ended.  A batch that fails
and is run again overwrites its own folder, so nothing is there twice, and a
reader always sees whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one run for each partition of the state.  A partition costs a set of files for each operator and batch, however few rows it has.
STATE_ROWS = 200_000


def state_partitions(spark: SparkSession, rows: int) -> int:
    """How many partitions the state of a job with so many rows a run gets: as many as there are cores or more, not above the setting."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS)))


@contextmanager
def _partitions(spark: SparkSession, n: int) -> Iterator[None]:
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All files of a folder as a stream, those that are there at the start of a run in one batch."""
    return spark.readStream.schema(like.schema).parquet(path)


def _writer(where: str) -> Callable[[DataFrame, int], None]:
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/results/batch={number}")

    return keep


def advance(stream: DataFrame, where: str, mode: str = "append", keep: Callable[[DataFrame, int], None] | None = None, partitions: int | None = None) -> None:
    """Work off what has arrived since the job's last run; the first run settles the partitions of the state."""
    q = stream.writeStream.foreachBatch(keep or _writer(where)).outputMode(mode)
    q = q.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if partitions is None:
        q.start().awaitTermination()
        return
    with _partitions(stream.sparkSession, partitions):  # a query keeps the settings it starts with
        running = q.start()
    running.awaitTermination()


def results(spark: SparkSession, where: str) -> DataFrame:
    """All rows of all batches, with the batch's number."""
    return spark.read.parquet(f"{where}/results")


def last_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an update stream, and how many there were; a key has a row per batch."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    d = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"), F.count("*").alias("revisions"))
    return d.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "revisions")


def parts_by_time(events: DataFrame, time: str, n: int) -> list[DataFrame]:
    """events in n stretches of equal time, as they would arrive; a null time comes with the first."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    at = F.coalesce(F.floor((us - F.lit(low or 0)) * n / F.lit((high or 0) - (low or 0) + 1)), F.lit(0))
    return [events.where(at == k) for k in range(n)]


def replay(spark: SparkSession, where: str, inputs: dict[str, list[DataFrame]], build: Callable[..., DataFrame], mode: str = "append") -> DataFrame:
    """The results of a job whose inputs arrive part by part, with a run after each.

    Each run is a query of its own that knows nothing but the job's folder.
    build gets a stream for each input, by name.
    """
    n = max(map(len, inputs.values()))
    largest = max(sum(parts[k].count() for parts in inputs.values() if k < len(parts)) for k in range(n))
    partitions = state_partitions(spark, largest)
    for k in range(n):
        for name, parts in inputs.items():
            if k < len(parts):
                parts[k].write.mode("append").parquet(f"{where}/in/{name}")
        advance(build(**{name: stream_of(spark, f"{where}/in/{name}", parts[0]) for name, parts in inputs.items()}), where, mode, partitions=partitions)
    return results(spark, where)


def closing(events: DataFrame, time: str, **values) -> DataFrame:
    """A row a year after the last one, by which all watermarks pass the events before it."""
    last = events.agg(F.max(time).alias("m")).select((F.col("m") + F.expr("interval 365 days")).alias(time), *[F.lit(v).alias(c) for c, v in values.items()])
    return last.select(*[(F.col(c) if c == time or c in values else F.lit(None)).cast(kind).alias(c) for c, kind in events.dtypes])
