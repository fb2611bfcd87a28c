"""State by year, tables by bucket and loads by manifest, on hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from terradelta.operators import change, regions, yearly
from terradelta.plans.params import Thresholds
from terradelta.sources import loading, packages

CELLS = "region_id long, cell_id long, year int, embedding array<float>"


def test_state_by_year_equals_all_years_at_once(spark):
    rows = [(c % 2, c, y, [float((c * y) % 7), float((c + y) % 5)]) for c in range(6) for y in range(2017, 2023) if (c, y) not in ((1, 2019), (2, 2017), (3, 2022))]
    rows = [r if r[1:3] != (4, 2020) else (*r[:3], None) for r in rows]
    cells = spark.createDataFrame(rows, CELLS)
    t = Thresholds(strong_change=3.0)
    state = yearly.nothing_yet(spark)
    for year in range(2017, 2023):
        state = yearly.advanced(state, cells.where(F.col("year") == year), t)
    got = {r.region_id: r for r in yearly.region_stats(state, t).collect()}
    want = {r.region_id: r for r in change.region_stats(change.intervals(cells).where("change is not null"), t).collect()}
    assert set(got) == set(want) == {0, 1}
    for k in got:
        for c in want[k].asDict():
            a, b = got[k][c], want[k][c]
            assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (k, c, a, b)


def test_buckets_of_parts_are_added(spark):
    values = [(1, 2020, i / 1000 + 0.0005) for i in range(1000)] + [(1, 2020, None), (1, 2020, math.nan)]
    d = spark.createDataFrame(values, "region_id long, end_year int, change double")
    one, two = yearly.bucket_counts(d.where("change < 0.3")), yearly.bucket_counts(d.where("change >= 0.3 or change is null"))
    r = yearly.thresholds(one.unionByName(two), ["end_year"]).first()
    assert r.n == 1000 and abs(r.threshold - 0.9495) < 1e-9 and r.rank_error == 0.001
    assert yearly.thresholds(yearly.bucket_counts(d.limit(0)), ["end_year"]).collect() == []


def test_no_exchange_between_bucketed_tables(spark, tmp_path):
    a = spark.createDataFrame([(f"r{i}", i % 3) for i in range(50)], "feature_id string, behaviour int")
    b = spark.createDataFrame([(f"r{i}", i, float(i)) for i in range(0, 50, 2)] + [("r4", 99, 9.0)], "feature_id string, ord int, area_m2 double")
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"drop table if exists {name}")
    ta, tb = packages.write_bucketed(a, "bucketed_a", f"{tmp_path}/a", buckets=4), packages.write_bucketed(b, "bucketed_b", f"{tmp_path}/b", buckets=4)
    d = regions.with_details(ta.hint("merge"), tb)
    got = {r.feature_id: r.area_m2 for r in d.collect()}
    assert len(got) == 50 and got["r4"] == 9.0 and got["r2"] == 2.0 and got["r1"] is None
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"drop table {name}")


@pytest.fixture
def files(tmp_path):
    feature = lambda **p: {"type": "Feature", "properties": p}
    write = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x))
    write("a.json", {"type": "FeatureCollection", "features": [feature(feature_id="r1", area_ha=2.5), feature(feature_id="r2")]})
    write("b.json", {"type": "FeatureCollection", "features": [feature(feature_id="r3", area_ha="wide"), {"type": "Feature"}, feature(area_ha=1), feature(feature_id="r4", lat=1.0)]})
    write("c.json", '{"type": "FeatureCollection", "features": [{"ty')
    write("e.json", {"type": "FeatureCollection", "features": []})
    return tmp_path


def test_each_file_is_judged_apart(spark, files):
    manifest = spark.createDataFrame([(f,) for f in ("a.json", "b.json", "c.json", "d.json", "e.json")], "file string")
    opened = loading.opened(manifest, str(files))
    found = loading.records(opened)
    told = loading.report(opened, found)
    assert sorted(map(tuple, told.collect())) == [("a.json", "ok", 2, 0), ("b.json", "broken records", 4, 3), ("c.json", "no collection", 0, 0), ("d.json", "missing", 0, 0), ("e.json", "ok", 0, 0)]
    assert sorted((r.file, r.place, r.reason) for r in loading.broken(found).collect()) == [("b.json", 0, "area_ha is no number"), ("b.json", 1, "no properties"), ("b.json", 2, "no feature_id")]
    assert sorted((r.feature_id, r.area_ha) for r in loading.sound(found).collect()) == [("r1", 2.5), ("r2", None), ("r4", None)]
    assert loading.all_or_none(found, told).collect() == []


def test_all_files_or_none(spark, files):
    opened = loading.opened(spark.createDataFrame([("a.json",), ("e.json",)], "file string"), str(files))
    found = loading.records(opened)
    assert sorted(r.feature_id for r in loading.all_or_none(found, loading.report(opened, found)).collect()) == ["r1", "r2"]


def test_cell_with_one_change_has_no_slope(spark):
    rows = [(r, r * 10 + c, y, [float(y % 3 + c), 1.0]) for r in (0, 1) for c in (0, 1) for y in range(2017, 2021) if (r, c) != (1, 1) or y < 2019]
    cells = spark.createDataFrame(rows, CELLS)
    want = {r.region_id: r.slope_mean for r in change.region_stats(change.intervals(cells)).collect()}
    assert math.isfinite(want[0]) and math.isnan(want[1])
    assert [r.slope for r in change.cell_stats(spark.createDataFrame([(1, 1, "a", 2018, None)], "region_id long, cell_id long, interval string, end_year int, change double")).collect()] == [None]


def test_state_of_a_cell_with_one_change_has_no_slope(spark):
    rows = [(r, r * 10 + c, y, [float(y % 3 + c), 1.0]) for r in (0, 1) for c in (0, 1) for y in range(2017, 2021) if (r, c) != (1, 1) or y < 2019]
    cells = spark.createDataFrame(rows, CELLS)
    state = yearly.nothing_yet(spark)
    for year in range(2017, 2021):
        state = yearly.advanced(state, cells.where(F.col("year") == year))
    got = {r.region_id: r.slope_mean for r in yearly.region_stats(state).collect()}
    assert math.isfinite(got[0]) and math.isnan(got[1])


def test_state_with_repeated_vectors_and_null_changes(spark):
    rows = [(c % 2, c, y, [float((c * y) % 7), float((c + y) % 5)]) for c in range(6) for y in range(2017, 2023)]
    rows += rows[::3] + [(c % 2, c, 2019, [float(c), 9.0]) for c in (1, 4)] + [(c % 2, c, y, None) for c in (6, 7) for y in (2018, 2019, 2021)] + [(1, 5, 2020, None)]
    cells = spark.createDataFrame(rows, CELLS)
    t = Thresholds(strong_change=3.0)
    state = yearly.nothing_yet(spark)
    for year in range(2017, 2023):
        state = yearly.advanced(state, cells.where(F.col("year") == year), t)
    got = {r.region_id: r.asDict() for r in yearly.region_stats(state, t).collect()}
    want = {r.region_id: r.asDict() for r in change.region_stats(change.intervals(cells), t).collect()}
    assert {k: r["n_cells"] for k, r in got.items()} == {0: 4, 1: 4}
    for k, r in want.items():
        assert all(got[k][c] == v or math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-12) for c, v in r.items()), (got[k], r)
