"""What the application does with timers, on event streams and on tables.

Streams carry a watermark, so state is bounded by the keys of the delay.
events: (event_id, ts, user_id, event_type, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "1 hour"


def stream_of(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced_stream(events: DataFrame, gap: str = GAP, late: str = GAP) -> DataFrame:
    """One row per closed session of a user: its end and its last event (append mode)."""
    d = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    d = d.agg(F.count("*").alias("n_events"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return d.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def debounced(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """The same over a table: sessions by the gaps to the event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros(F.col("ts")) - F.unix_micros(F.lag("ts").over(w)) >= gap_seconds * 1_000_000, F.lit(True))
    d = timed(events).withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w))
    d = d.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return d.select("user_id", "started", F.col("last.ts").alias("last_ts"), "n_events", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Only the newest request of each key counts; for tables and, in update mode, for streams."""
    d = events.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.count("*").alias("requests"))
    return d.select(*keys, F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"), "requests")


def results(events: DataFrame, late: str = GAP, window: str = "1 day") -> DataFrame:
    """Counts by window and type: provisional in update mode, final in append mode."""
    d = timed(events).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return d.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def without_stale(events: DataFrame, late: str = GAP) -> DataFrame:
    """Repeated requests of one id are dropped as long as they may still come."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def fresh_answers(requests: DataFrame, answers: DataFrame, within: str = "20 minutes", late: str = GAP) -> DataFrame:
    """(user_id, event_id, ts, answered): answers whose request was still its user's newest when they came.

    requests: (event_id, user_id, ts); answers: (event_id, answered).  An answer
    that takes longer than within is given up.  Two joins of streams: each answer
    meets its request, then the user's later requests up to the answer's time;
    what met none is fresh, which is known once the watermark has passed the
    answer.  Both sides of both joins are bounded in time, so state is, too.
    """
    r = timed(requests).select("event_id", "user_id", "ts").withWatermark("ts", late)
    a = answers.select(F.col("event_id").alias("answer_to"), F.col("answered").cast("timestamp").alias("answered")).withWatermark("answered", late)
    limit = F.expr(f"interval {within}")
    met = r.join(a, (F.col("event_id") == F.col("answer_to")) & (F.col("answered") >= F.col("ts")) & (F.col("answered") <= F.col("ts") + limit))
    met = met.select("user_id", "event_id", F.unix_micros("ts").alias("at"), "answered")  # one time of events for the next join
    newer = timed(requests).select(F.col("user_id").alias("by"), F.col("event_id").alias("newer_id"), F.col("ts").alias("asked")).withWatermark("asked", late)
    asked = F.unix_micros("asked")
    later = (asked > F.col("at")) | ((asked == F.col("at")) & (F.col("newer_id") > F.col("event_id")))
    on = (F.col("user_id") == F.col("by")) & later & (F.col("asked") <= F.col("answered")) & (F.col("asked") >= F.col("answered") - limit)
    return met.join(newer, on, "left_outer").where("newer_id is null").select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "answered")


def newest(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The same for a table: one row per key, the newest."""
    return requests.groupBy(key).agg(F.max(order).alias(order))
