"""The summary against the scan, for every setting, on rows with nulls."""

import itertools
import math

from terradelta.operators import regions, summary
from terradelta.plans.params import RegionFilter

SCHEMA = "id int, feature_type string, behaviour string, area_ha double, ndvi_direction string, dea_signal boolean, ndvi_signal boolean, hotspot_2017_2018 double"
ROWS = [
    (1, "hotspot_patch", "repeated_change", 0.0, "greening", True, None, 0.05),
    (2, "coldspot_patch", "low_change_reference", 0.5, "stable", False, True, 0.04),
    (3, None, "mixed_change", 25.0, "browning", None, True, None),
    (4, "other", None, None, None, True, True, math.nan),
    (5, "hotspot_patch", "mixed_change", 0.4999, "greening", False, False, 0.9),
    (6, "hotspot_patch", "mixed_change", 12.5, "greening", True, True, 0.9),
    (7, "coldspot_patch", "mixed_change", 300.0, "greening", True, True, 0.0),
    (8, "hotspot_patch", "mixed_change", -3.0, "stable", None, None, 0.0),
]


def test_every_setting_equals_the_scan(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    cube = summary.cube(rows).cache()
    types, narrowed = itertools.cycle([(True, True), (True, False), (False, True), (True, True), (False, False)]), itertools.cycle([("all", "all"), ("mixed_change", "all"), ("all", "greening")])
    filters = []
    for area in (0.0, 0.5, 12.5, 25.0):
        for evidence, match in (((), "all"), (("dea_signal",), "all"), (("dea_signal", "ndvi_signal"), "all"), (("dea_signal", "ndvi_signal"), "any")):
            (hot, cold), (behaviour, direction) = next(types), next(narrowed)
            filters.append(RegionFilter(hot, cold, behaviour, area, False, "endpoint", direction, evidence, match))
    assert all(map(summary.fits, filters))
    for f in filters:
        assert tuple(summary.from_cube(cube, f).first()) == tuple(regions.count_regions(rows, f).first())


def test_what_the_cube_cannot_answer_is_scanned(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    cube = summary.cube(rows)
    for f, source in ((RegionFilter(min_area=0.3), "scan"), (RegionFilter(active_only=True, interval="2017_2018"), "scan"), (RegionFilter(min_area=25.5), "scan"), (RegionFilter(min_area=1.5), "summary"), (RegionFilter(active_only=True), "summary")):
        got = summary.counted(rows, cube, f).first()
        assert got.source == source and tuple(got)[:4] == tuple(regions.count_regions(rows, f).first())
    empty = summary.cube(rows.limit(0))
    assert tuple(summary.from_cube(empty, RegionFilter()).first()) == (0, 0, 0, 0)
