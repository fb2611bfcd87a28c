"""Named queries over event streams: events arrive in parts, every part is a run of its own from the job's checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from terradelta import surrogate as s
from terradelta.catalog import SESSIONS, query
from terradelta.functions.numbers import rounded_to
from terradelta.session import scratch
from terradelta.streaming import interactions, jobs

PARTS = 3
#: The part in which an event arrives, as jobs.parts_by_time cuts them.
ARRIVED = f"""
with m as (select min(epoch_us(ts)) low, max(epoch_us(ts)) high from events),
p as (select events.*, floor((epoch_us(ts) - low) * {PARTS} / (high - low + 1))::bigint part from events, m)
"""


def _arrivals(spark, d):
    """The events in parts by time; the last part closes all windows."""
    e = s.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    parts = jobs.parts_by_time(e, "ts", PARTS)
    return [*parts[:-1], parts[-1].unionByName(jobs.closing(e, "ts", event_id=-1, user_id=-1))]


@query(SESSIONS + "select user_id, count(*) n_events, epoch_us(min(ts))::bigint started_us, max_by(event_id, (ts, event_id)) event_id, max_by(event_type, (ts, event_id)) event_type from n group by user_id, session")
def stream_sessions(spark, d):
    """The last event of every session, given out once its gap has passed."""
    r = jobs.replay(spark, scratch(spark, "sessions"), {"events": _arrivals(spark, d)}, interactions.debounced_stream)
    return r.where("event_id >= 0").select("user_id", "n_events", F.unix_micros("started").alias("started_us"), "event_id", "event_type")


@query(ARRIVED + "select user_id, event_type, max_by(event_id, (ts, event_id)) event_id, round(max_by(value, (ts, event_id)), 6) as value, count(*) requests, count(distinct part) revisions from p group by user_id, event_type")
def stream_latest(spark, d):
    """The newest request of every user and type, told anew in each run that brings one."""
    r = jobs.replay(spark, scratch(spark, "latest"), {"events": _arrivals(spark, d)}, lambda events: interactions.latest(interactions.timed(events), ["user_id", "event_type"]), "update")
    last = jobs.last_states(r, ["user_id", "event_type"]).where("event_id >= 0")
    return last.select("user_id", "event_type", "event_id", rounded_to(F.col("value"), 6).alias("value"), "requests", "revisions")


@query(ARRIVED + "select epoch_us(date_trunc('day', ts))::bigint day_us, event_type, count(*) n, round(sum(value), 4) total, count(distinct part) revisions from p group by all")
def stream_results(spark, d):
    """Daily counts, provisional until the last run that changes them."""
    r = jobs.replay(spark, scratch(spark, "results"), {"events": _arrivals(spark, d)}, interactions.results, "update")
    last = jobs.last_states(r, ["day", "event_type"]).where("event_type is not null")
    return last.select(F.unix_micros("day").alias("day_us"), "event_type", "n", rounded_to(F.col("total"), 4).alias("total"), "revisions")


@query("select event_id, user_id, event_type from events")
def stream_repeats(spark, d):
    """Every event is sent again ten minutes later, often in a later run, and counts once."""
    e = s.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    twice = e.unionByName(e.withColumn("ts", F.col("ts") + F.expr("interval 10 minutes")))
    r = jobs.replay(spark, scratch(spark, "repeats"), {"events": jobs.parts_by_time(twice, "ts", PARTS)}, interactions.without_stale)
    return r.select("event_id", "user_id", "event_type")


@query(
    """with a as (select event_id, ts + interval 1 second * (event_id * 7919 % 1500) answered from events)
select r.user_id, r.event_id, epoch_us(a.answered)::bigint answered_us from events r join a using (event_id) where a.answered <= r.ts + interval 20 minutes
and not exists (select 1 from events n where n.user_id = r.user_id and (n.ts, n.event_id) > (r.ts, r.event_id) and n.ts <= a.answered)"""
)
def stream_fresh_answers(spark, d):
    """Answers that came in time and before their user asked again; answers take up to 25 minutes and arrive in runs of their own."""
    parts = _arrivals(spark, d)
    e = s.table(spark, d, "events").select("event_id", "ts")
    a = e.select("event_id", (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 7919 % 1500)).alias("answered"))
    sent = jobs.parts_by_time(a, "answered", PARTS)
    answers = [*sent[:-1], sent[-1].unionByName(jobs.closing(a, "answered", event_id=-1))]
    r = jobs.replay(spark, scratch(spark, "answers"), {"requests": parts, "answers": answers}, interactions.fresh_answers)
    return r.where("event_id >= 0").select("user_id", "event_id", F.unix_micros("answered").alias("answered_us"))
