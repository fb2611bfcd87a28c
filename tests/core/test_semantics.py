"""Null, boundary and tie rules, on hand-made rows."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from terradelta.functions import dates, labels, numbers, places
from terradelta.operators import captures, change, history, regions, search, series
from terradelta.plans.params import RegionFilter, Thresholds, clamped, imagery_year
from terradelta.sources import packages

REGION = "id int, feature_type string, behaviour string, area_ha double, ndvi_direction string, dea_signal boolean, ndvi_signal boolean, hotspot_2017_2018 double"
REGIONS = [
    (1, "hotspot_patch", "repeated_change", 0.0, "greening", True, None, 0.05),
    (2, "coldspot_patch", "low_change_reference", 0.5, "stable", False, True, 0.0499),
    (3, None, "mixed_change", 25.0, "browning", None, True, None),
    (4, "other", None, None, None, True, True, math.nan),
    (5, "hotspot_patch", "mixed_change", 0.4999, "greening", False, False, 0.9),
]


def passes(r, f):
    _, kind, behaviour, area, direction, dea, ndvi, hot = r
    if not (f.coldspots if kind == "coldspot_patch" else f.hotspots):
        return False
    if f.behaviour != "all" and behaviour != f.behaviour or (area or 0) < f.min_area:
        return False
    if f.active_only and f.interval != "endpoint" and not (hot or 0) >= 0.05:
        return False
    if f.direction != "all" and direction != f.direction:
        return False
    signals = [{"dea_signal": dea, "ndvi_signal": ndvi}[e] is True for e in f.evidence]
    return not signals or (all(signals) if f.match == "all" else any(signals))


def test_filter_matrix(spark):
    rows = spark.createDataFrame(REGIONS, REGION)
    filters = [
        RegionFilter(hot, cold, behaviour, area, active, "2017_2018" if active else "endpoint", direction, evidence, match)
        for hot, cold in itertools.product((True, False), repeat=2)
        for behaviour in ("all", "mixed_change")
        for area in (0.0, 0.5, 25.0)
        for active in (True, False)
        for direction in ("all", "greening")
        for evidence in ((), ("dea_signal",), ("dea_signal", "ndvi_signal"))
        for match in ("all", "any")
    ]
    got = rows.select("id", *[f.predicate().alias(f"f{i}") for i, f in enumerate(filters)]).collect()
    for r, row in zip(sorted(got), REGIONS):
        for i, f in enumerate(filters):
            assert r[f"f{i}"] == passes(row, f), (row, f)
    assert not RegionFilter().is_active and RegionFilter(min_area=0.5).is_active and not RegionFilter(coldspots=False).is_active


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()


def test_labels(spark):
    got = values(spark, [("repeated_change_x",), ("already Upper-case_b",), ("",), (None,), ("ndviMean it's",)], "s string", a=labels.plain_label(F.col("s")))
    assert [r.a for r in got] == ["Repeated Change X", "Already Upper-Case B", "", "", "NdviMean It'S"]
    assert values(spark, [("<a href=\"x\">&'",)], "s string", a=labels.escape_markup(F.col("s")))[0].a == "&lt;a href=&quot;x&quot;&gt;&amp;&#039;"
    got = values(spark, [("x",), (None,), ("mixed_change",)], "s string", a=labels.behaviour_label(F.col("s")), c=labels.behaviour_colour(F.col("s")), d=labels.direction_label(F.col("s")))
    assert [(r.a, r.c) for r in got] == [("Some repeated change", labels.GREY)] * 2 + [("Some repeated change", "#dc7927")] and got[0].d == "Not available"
    assert [r.a for r in values(spark, [("Unknown 0",), ("",), (None,), ("Wheat",)], "s string", a=labels.detailed_class(F.col("s")))] == ["Detailed class unavailable"] * 3 + ["Wheat"]
    r = values(spark, [("2017_2018",), ("endpoint",)], "s string", a=labels.interval_label(F.col("s")), b=labels.interval_short(F.col("s")))
    assert (r[0].a, r[0].b) == ("2017 → 2018", "17–18") and r[1].a == "2017–2024 overview"
    r = values(spark, [("a", ""), (None, "b"), ("", None)], "x string, y string", a=labels.joined(F.col("x"), F.col("y")))
    assert [x.a for x in r] == ["a", "b", ""]
    r = values(spark, [("mostly_single_period_change", 0.004), ("mixed_change", 0.115), ("low_change_reference", None)], "b string, c double", a=labels.repeat_sentence(F.col("b"), F.col("c")))
    assert r[0].a == labels.SUMMARY_NEVER_TWICE and r[1].a.startswith("12% of") and r[2].a == labels.SUMMARY_LOW
    assert values(spark, [("\t  A b ",)], "s string", a=labels.trimmed_lower(F.col("s")))[0].a == "a b"


def test_shards_and_padding(spark):
    rows = [("r1",), ("r1000",), ("r1001",), ("region_13784",), ("none",)]
    got = values(spark, rows, "s string", a=labels.shard_of(F.col("s")), b=labels.zero_padded(labels.shard_of(F.col("s"))))
    assert [(r.a, r.b) for r in got] == [(0, "000"), (0, "000"), (1, "001"), (13, "013"), (None, None)]
    assert values(spark, [(12345,)], "n int", a=labels.zero_padded(F.col("n")))[0].a == "12345"
    assert packages.shard_number("r1001") == 1 and packages.shard_number("x") is None


def test_numbers_and_dates(spark):
    rows = [(c,) for c in (0.0, 0.0999, 0.1, 0.4999, 0.5, 1.0, None)]
    assert [r.a for r in values(spark, rows, "c double", a=numbers.band(F.col("c")))] == ["mostly_single_period_change"] * 2 + ["mixed_change"] * 2 + ["repeated_change"] * 2 + [None]
    r = values(spark, [([0.0, 3.0], [4.0, 0.0]), ([1.0], None), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>", d=numbers.euclidean(F.col("a"), F.col("b")))
    assert [x.d for x in r] == [5.0, None, None]
    r = values(spark, [(-1.0,), (0.125,), (0.25,), (2.0,), (None,)], "c double", a=numbers.ramp(F.col("c"), numbers.OPACITY_STOPS))
    assert [x.a for x in r] == [0.2, pytest.approx(0.36), 0.52, 0.82, None]
    r = values(spark, [("20230231",), ("20230228",), ("2023-02",), (None,)], "s string", a=dates.capture_date(F.col("s")))
    assert [str(x.a) for x in r] == ["None", "2023-02-28", "None", "None"]
    r = values(spark, [(0.5,), (1.25,), (math.nan,), (None,)], "c double", a=numbers.resolution_text(F.col("c")))
    assert [x.a for x in r] == ["0.50 m", "1.3 m", None, None]


def test_coordinates(spark):
    rows = [("-38.6,145.5",), ("145.5 -38.6",), ("38.6,145.5",), ("-38.6,99",), ("-38.6,145.5  ",), ("1234,5",), (None,)]
    got = values(spark, rows, "s string", p=places.coordinates(F.col("s")))
    assert [tuple(r.p) if r.p else None for r in got] == [(145.5, -38.6), (145.5, -38.6), None, None, (145.5, -38.6), None, None]


def test_change_needs_neighbouring_years(spark):
    rows = [(1, 1, y, [float(y - 2017), 0.0]) for y in (2017, 2018, 2020, 2021)] + [(1, 2, 2017, None), (1, 2, 2018, [1.0, 1.0])]
    got = change.intervals(spark.createDataFrame(rows, "region_id long, cell_id long, year int, embedding array<float>")).collect()
    assert sorted((r.cell_id, r.interval, r.change) for r in got if r.cell_id == 1) == [(1, "2017_2018", 1.0), (1, "2020_2021", 1.0)]
    assert [r.change for r in got if r.cell_id == 2] == [None]
    flat = spark.createDataFrame([(1, "2017_2018", 2018, 0.3), (1, "2018_2019", 2019, 0.3)], "region_id long, interval string, end_year int, change double")
    assert change.strongest(flat).first().strongest_change_interval == "2017-2018"
    sizes = spark.createDataFrame([(i, 1.0) for i in range(8)], "region_id long, cumulative_change_mean double")
    assert [r.tile for r in sorted(change.activity(sizes).collect())] == [1, 1, 1, 2, 2, 2, 3, 3]


def test_history(spark):
    rows = [(r, y, c, n) for r, cs in ((1, "AAA"), (2, "ABA"), (3, "ABB")) for y, (c, n) in enumerate(zip(cs, (0.1, 0.1527, 0.1)), 2017)]
    d = history.outcomes(history.transitions(spark.createDataFrame(rows, "feature_id long, year int, class string, ndvi_mean double")))
    got = {r.feature_id: r for r in d.collect()}
    assert [(got[i].outcome, got[i].first_change_year, got[i].headline) for i in (1, 2, 3)] == [("stayed", None, "Stayed A"), ("returned", 2018, "Returned to A"), ("moved", 2018, "A → B")]
    cells = [(1, "b")] * 3 + [(1, "a")] * 3 + [(2, "x")] * 85 + [(2, "y")] * 15 + [(3, "x")] * 86 + [(3, "y")] * 14 + [(4, None)]
    got = {r.k: r for r in history.dominant(spark.createDataFrame(cells, "k long, class string"), ["k"]).collect()}
    assert got[1]["class"] == "a" and got[2].secondary_shown and not got[3].secondary_shown and 4 not in got


def test_captures(spark):
    t = spark.createDataFrame([(1, 2020), (2, 2020), (3, 2020)], "k long, year int")
    rows = [(1, "2021-12-31", 0.5, 7), (2, "2022-01-01", 0.5, 8), (1, None, 0.1, 9)]
    c = spark.createDataFrame(rows, "k long, day string, resolution double, capture_id long").withColumn("day", F.col("day").cast("date"))
    got = {r.k: r for r in captures.nearest(t, c, "k").collect()}
    assert got[1].distance_days == 548 and got[1].available and got[1].kind == "other year"
    assert got[2].distance_days == 549 and not got[2].available and got[2].nearest_day is not None and got[2].capture_id is None
    assert got[3].nearest_day is None and not got[3].available
    ties = spark.createDataFrame([(1, "2020-06-30", None, 1), (1, "2020-07-02", 2.0, 3), (1, "2020-07-02", 2.0, 2)], "k long, day string, resolution double, capture_id long").withColumn("day", F.col("day").cast("date"))
    assert captures.nearest(t.where("k = 1"), ties, "k").first().capture_id == 2
    stack = spark.createDataFrame([(1, 5, 0.0, 1), (1, 5, 0.3, 2), (1, 4, 0.1, 3), (2, None, None, 4)], "k long, draw int, res double, id long")
    assert sorted((r.k, r.id) for r in captures.top_of(stack, ["k"], F.col("draw"), F.col("res"), ["id"]).collect()) == [(1, 2), (2, 4)]
    last = captures.last_of(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, o int, v string"), ["k"], ["o"])
    assert sorted(map(tuple, last.collect())) == [("a", 3, "z", 1), ("b", 2, "y", 2)]


def test_series(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, math.nan])] + [("b", 0, 2.0), ("b", 1, 2.0), ("c", 0, None)]
    s = spark.createDataFrame(rows, "k string, o int, v double")
    got = {r.k: r for r in series.domain(s, "k", "v").collect()}
    assert set(got) == {"a", "b"} and got["a"].axis_low == pytest.approx(0.76) and got["b"].axis_high == pytest.approx(2.24)
    assert sorted((r.k, r.o) for r in series.placed(s, "k", "o", "v").collect()) == [("a", 1), ("a", 3), ("b", 0), ("b", 1)]
    assert [(r.previous, r.next) for r in sorted(series.neighbours(s.where("k = 'b'"), "k", "o").collect())] == [(0, 1), (0, 1)]


def test_search(spark):
    ids = spark.createDataFrame([(i, f"R{i}", "mixed_change", 0.0, 0.0) for i in range(20)] + [(99, "50%_x", None, 1.0, 1.0)], "ord long, feature_id string, behaviour string, lon double, lat double")
    g = search.gazetteer(spark)
    run = lambda q, **k: [r.name for r in search.search(q, ids, g, **k).collect()]
    assert run("  ") == [] and run("r1") == ["R1", "R10", "R11", "R12", "R13"]
    assert run("VIC 39") == ["Wonthaggi", "Inverloch", "Cowes", "San Remo", "Grantville"]
    assert run("%") == [] and run("50%_") == ["50%_x"] and run("_") == []
    assert run("-38.6, 145.5") == ["Coordinate"]
    remote = spark.createDataFrame([(0, "Far Inverloch", "", 100.0, 0.0), (1, "New Inverloch", "", 145.7, -38.6)], "ord long, name string, detail string, lon double, lat double")
    assert run("inverloch", remote=remote, box=(145.0, -39.0, 146.0, -38.0)) == ["Inverloch", "New Inverloch"]


def test_point_in_ring_and_patches(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    areas = spark.createDataFrame([(1, ring), (2, [(3.0, 0.0), (9.0, 0.0), (9.0, 9.0)])], "area_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.5, 0.2), (4, 8.5, 7.0)], "point_id long, lon double, lat double")
    assert sorted(map(tuple, regions.hit(points, areas).collect())) == [(1, 1), (3, 1), (4, 2)]
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    grid = ["aab", "bab", "aaa", "bba"]
    cells = [(i * 3 + j, j, i, s) for i, row in enumerate(grid) for j, s in enumerate(row)]
    got = {r.cell_id: r.patch for r in regions.patches(spark.createDataFrame(cells, "cell_id long, x long, y long, state string")).collect()}
    assert [got[i] for i in range(12)] == [0, 0, 2, 3, 0, 2, 0, 0, 0, 9, 9, 0]


def test_packages(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"feature_id": "r1", "area_ha": 2.5, "dea_signal": "true", "hotspot_2017_2018": 0.5}}]}
    (tmp_path / "f.json").write_text(json.dumps(f))
    got = packages.features(spark, f"{tmp_path}/f.json").first()
    assert got.feature_id == "r1" and got.dea_signal is None and got.hotspot_2017_2018 == 0.5 and "coordinates" in got.geometry
    (tmp_path / "d.json").write_text(json.dumps({"r1": {"lat": 1.0, "annual_context": {"2017": {"ndvi_mean": 0.25, "dea_level3": "W"}}}, "r1001": {"feature_id": "r1001", "lat": 2.0}}))
    d = packages.details(spark, f"{tmp_path}/d.json")
    assert packages.context(d).first().ndvi_mean == 0.25
    packages.write_details(d, f"{tmp_path}/details")
    stored = spark.read.parquet(f"{tmp_path}/details")
    one = packages.detail(stored, "r1001")
    assert one.first().lat == 2.0 and "shard" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert packages.detail(stored, "none").count() == 0
    c = {"maximum_capture_distance_days": 548, "years": {"2017": [5, 9]}, "releases": {"5": {"release_date": "2017-05-01", "metadata_service": "s"}, "9": {"release_date": "2018-01-01", "metadata_service": ""}}}
    (tmp_path / "c.json").write_text(json.dumps(c))
    assert [(r.year, r.ordinal, r.release_num) for r in packages.candidates(packages.json_object(spark, f"{tmp_path}/c.json", packages.CATALOGUE)).collect()] == [(2017, 0, 5)]


def test_years():
    assert imagery_year("2019_2020") == 2020 and imagery_year("endpoint") == 2024 and clamped(2030) == 2025
    assert Thresholds().capture_days == 548


def test_region_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    d = regions.select_regions(spark.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr("c_acctbal area_ha", "c_mktsegment feature_type", "c_name behaviour", "c_acctbal hotspot_2019_2020"), RegionFilter(coldspots=False, min_area=3, behaviour="x", active_only=True, interval="2019_2020"))
    pushed = d._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(c_acctbal,3.0)" in pushed and "EqualTo(c_name,x)" in pushed and "GreaterThanOrEqual(c_acctbal,0.05)" in pushed


def test_quantile_in_rounds(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    for values in ([1.0], [2.0, 2.0, 2.0], rnd.normal(size=900).tolist(), [0.0] * 500 + rnd.random(300).tolist(), [float(x) for x in range(7)]):
        d = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "v double")
        for share in (0.0, 0.5, 0.95, 1.0):
            got = change.threshold(d, "v", share, most=20).first()
            assert abs(got.threshold - np.quantile(values, share)) < 1e-12 and got.n == len(values)
    assert tuple(change.threshold(spark.createDataFrame([], "v double"), "v").first()) == (None, 0)


def test_number_texts(spark):
    from terradelta.functions.numbers import number_text

    d = spark.createDataFrame([(1234.5,), (0.0,), (-0.001,), (1200.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in d.select(number_text(F.col("x"))).collect()] == ["1,234.5", "0", "0", "1,200", "—", "—"]


def test_both_nearest_forms_agree(spark):
    rows = [("a", "2019-06-30", 2.0, 1), ("a", "2019-07-02", 1.0, 2), ("a", "2019-07-02", 1.0, 3), ("a", "2016-01-01", None, 4), ("b", None, 1.0, 5), ("c", "2019-07-01", None, 6), ("c", "2019-07-01", 9.0, 7)]
    shots = spark.createDataFrame(rows, "k string, day string, resolution double, capture_id long").withColumn("day", F.to_date("day"))
    targets = spark.createDataFrame([(k, y) for k in "abcd" for y in (2017, 2019)], "k string, year int")
    one, two = (sorted(map(tuple, f(targets, shots, "k").collect()), key=str) for f in (captures.nearest, captures.nearest_sorted))
    assert one == two and ("a", 2019) in [(r[0], r[1]) for r in one if r[5] == 2]


def test_ties_of_rounding_fall_as_in_sql(spark):
    """0.3105 - 0.816 is 505.5 thousandths once scaled, but its text is a little less."""
    import duckdb

    values = [(a / 1e6 - b / 1e6,) for a in range(310_000, 312_000, 500) for b in range(500_000, 900_000, 500)]
    d = spark.createDataFrame(values, "x double")
    got = [tuple(r) for r in d.select("x", numbers.rounded_to(F.col("x"), 3).alias("r")).collect()]
    c = duckdb.connect()
    c.execute("create table t as select unnest(?::double[]) x", [[x for x, _ in got]])
    assert [r for _, r in got] == [r for (r,) in c.execute("select round(x, 3) from t").fetchall()]
    assert d.where(numbers.rounded_to(F.col("x"), 3) != F.round("x", 3)).count() > 0
    notes = [r[0] for r in d.limit(2000).select(labels.ndvi_note(F.col("x"))).collect()]
    want = c.execute("select regexp_replace(printf('%.3f', round(abs(x), 3)), '\\.?0+$', '') from t limit 2000").fetchall()
    assert [n.split(" by ")[1].split(" ")[0] for n in notes] == [w for (w,) in want]
