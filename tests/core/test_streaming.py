from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terradelta.streaming import interactions as i
from terradelta.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows():
    start = datetime(2024, 1, 1)
    return [(k, start + timedelta(minutes=k * 17 + (k % 5 == 0) * 60), k % 3, "view" if k % 2 else "click", float(k)) for k in range(200)]


def run(spark, tmp_path, name, mode, build):
    spark.createDataFrame(rows(), SCHEMA).repartition(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = build(i.stream_of(spark, f"{tmp_path}/in", SCHEMA))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_closed_sessions_equal_the_table(spark, tmp_path):
    table = {(r.user_id, r.started): (r.n_events, r.event_id) for r in i.debounced(spark.createDataFrame(rows(), SCHEMA)).collect()}
    got = run(spark, tmp_path, "sessions", "append", i.debounced_stream)
    assert got and all(table[r.user_id, r.started] == (r.n_events, r.event_id) for r in got) and len(got) < len(table)


def test_latest_and_results(spark, tmp_path):
    events = spark.createDataFrame(rows(), SCHEMA)
    want = sorted(map(tuple, i.latest(events, ["user_id"]).collect()))
    assert sorted(map(tuple, run(spark, tmp_path, "latest", "update", lambda s: i.latest(s, ["user_id"])))) == want
    days = {(r.day, r.event_type): r.n for r in i.results(events).collect()}
    final = run(spark, tmp_path, "days", "append", i.results)
    assert final and all(days[r.day, r.event_type] == r.n for r in final)


def test_repeats_are_dropped(spark, tmp_path):
    got = run(spark, tmp_path, "once", "append", lambda s: i.without_stale(s.union(s.where(F.col("event_id") % 2 == 0))))
    assert len(got) == len({r.event_id for r in got}) == 200


def test_a_failed_batch_is_run_again_from_the_checkpoint(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    events = spark.createDataFrame(rows(), SCHEMA)
    parts = jobs.parts_by_time(events, "ts", 3)
    job, source = f"{tmp_path}/job", f"{tmp_path}/in"

    def fails_after_writing(batch, number):
        jobs._writer(job)(batch, number)
        raise RuntimeError("the driver is lost")

    for k, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        build = lambda: i.debounced_stream(jobs.stream_of(spark, source, events))
        if k == 1:
            with pytest.raises(StreamingQueryException):
                jobs.advance(build(), job, keep=fails_after_writing)
        jobs.advance(build(), job)
    jobs.advance(build(), job)  # nothing new has arrived
    table = {(r.user_id, r.started): (r.n_events, r.event_id) for r in i.debounced(events).collect()}
    got = jobs.results(spark, job).collect()
    assert len({(r.user_id, r.started) for r in got}) == len(got) > 20
    assert all(table[r.user_id, r.started] == (r.n_events, r.event_id) for r in got)
    assert len({r.batch for r in got}) > 1


def test_updates_keep_their_last_state(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("b", 2, None)], "k string, batch int, v int")
    assert sorted(map(tuple, jobs.last_states(d, ["k"]).collect())) == [("a", 7, 2), ("b", None, 1)]


def test_empty_and_null_times(spark):
    d = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1)), (3, datetime(2024, 1, 2))], "id long, ts timestamp")
    assert [[r.id for r in p.collect()] for p in jobs.parts_by_time(d, "ts", 2)] == [[1, 2], [3]]
    assert [p.count() for p in jobs.parts_by_time(d.limit(0), "ts", 2)] == [0, 0]


def test_only_the_answer_of_the_newest_request_stays(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    requests = [(1, 7, at(0)), (2, 7, at(5)), (3, 8, at(1)), (4, 7, at(40)), (5, 9, at(50)), (6, 9, at(50)), (-1, -1, at(6000))]
    answers = [(1, at(6)), (2, at(8)), (3, at(2)), (4, at(75)), (5, at(51)), (6, at(52)), (99, at(3)), (-1, at(6000))]
    r = spark.createDataFrame(requests, "event_id long, user_id long, ts timestamp")
    a = spark.createDataFrame(answers, "event_id long, answered timestamp")
    got = jobs.replay(spark, f"{tmp_path}/job", {"requests": jobs.parts_by_time(r, "ts", 2), "answers": jobs.parts_by_time(a, "answered", 2)}, i.fresh_answers).collect()
    assert sorted(x.event_id for x in got if x.event_id > 0) == [2, 3, 6]  # 1 and 5 are overtaken, 4 took too long, 99 was never asked


def test_state_has_as_many_partitions_as_its_rows_need(spark, tmp_path, monkeypatch):
    import os

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    events = spark.createDataFrame(rows(), SCHEMA)
    parts = jobs.parts_by_time(events, "ts", 2)
    told = []
    try:
        spark.conf.set(key, 17)
        for name in ("few", "many"):
            got = jobs.replay(spark, f"{tmp_path}/{name}", {"events": parts}, i.debounced_stream).collect()
            told.append(sorted((r.user_id, r.started, r.n_events, r.event_id) for r in got))
            n = len([p for p in os.listdir(f"{tmp_path}/{name}/checkpoint/state/0") if p.isdigit()])
            assert n == (spark.sparkContext.defaultParallelism if name == "few" else -(-max(p.count() for p in parts) // 10))
            assert spark.conf.get(key) == "17"
            monkeypatch.setattr(jobs, "STATE_ROWS", 10)
        assert jobs.state_partitions(spark, 10**9) == 17
    finally:
        spark.conf.set(key, before)
    assert told[0] == told[1] and told[0]
