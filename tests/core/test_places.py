"""Quadtree hits, nearest places and outlines against brute force on hand-made rows."""

import random

from pyspark.sql import functions as F

from terradelta.operators import outlines, regions, search
from terradelta.operators.quadtree import Quadtree

POINTS, PLACES = "point_id long, lon double, lat double", "ord long, lon double, lat double"
AREAS = "area_id long, draw int, rings array<array<struct<x:double,y:double>>>"


def crowded(rnd, n):
    """A third of all points in one place, others near it, the rest spread out."""
    return [(i, 5.0, 5.0) if i % 3 == 0 else (i, 5 + rnd.random() / 1000, 5 + rnd.random() / 1000) if i % 3 == 1 else (i, rnd.uniform(-50, 60), rnd.uniform(0, 9)) for i in range(n)]


def inside(x, y, ring):
    n = 0
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            n += 1
    return n


def test_leaves_are_small_and_hold_every_point_once(spark):
    points = crowded(random.Random(1), 600)
    t = Quadtree(spark.createDataFrame(points, POINTS), most=20, depth=6)
    leaves = t.leaves.collect()
    assert sum(r.n for r in leaves) == 600 and all(r.n <= 20 or r.level == 6 for r in leaves)
    assert sum(4.0 ** -r.level for r in leaves) == 1.0 and max(r.salts for r in leaves) > 10
    held = t.of_points(spark.createDataFrame(points, POINTS), F.col("point_id")).collect()
    assert sorted(r.point_id for r in held) == list(range(600))
    deepest = [r.salt for r in held if r.level == 6]
    assert len(set(deepest)) > 5
    boxes = [(i, *sorted((random.Random(i).uniform(-60, 70), random.Random(i + 99).uniform(-60, 70))), *sorted((random.Random(i + 5).uniform(-2, 12), random.Random(i + 7).uniform(-2, 12)))) for i in range(40)] + [(40, 5.0, 5.0, 5.0, 5.0), (41, -50.0, 60.0, 0.0, 9.0)]
    met = t.meeting(spark.createDataFrame(boxes, "id long, w double, e double, s double, n double"), salted=False).collect()
    assert len({(r.id, r.level, r.gx, r.gy) for r in met}) == len(met)
    f = t.frame
    for b in boxes:
        want = set()
        for r in leaves:
            k = 1 << r.level
            at = lambda v, low, size: min(max(int((v - low) / size * k // 1), 0), k - 1)  # noqa: B023, E731
            if at(b[1], f.west, f.width) <= r.gx <= at(b[2], f.west, f.width) and at(b[3], f.south, f.height) <= r.gy <= at(b[4], f.south, f.height):
                want.add((r.level, r.gx, r.gy))
        assert {(r.level, r.gx, r.gy) for r in met if r.id == b[0]} == want


def test_hits_with_holes_parts_and_drawing_order(spark):
    rnd = random.Random(2)
    points = [*crowded(rnd, 400), (1000, None, 1.0)]
    areas = []
    for i in range(30):
        x, y, r = rnd.choice((5.0, rnd.uniform(-40, 50))), rnd.choice((5.0, rnd.uniform(0, 9))), rnd.choice((0.0004, 1.0, 30.0))
        square = lambda q: [(x - q, y - q), (x + q, y - q), (x + q, y + q), (x - q, y + q)]  # noqa: B023, E731
        areas.append((i, rnd.choice((1, 2, None)), [square(r), square(r / 2), [(x + r, y), (x + 2 * r, y), (x + r, y + r)]][: 1 + i % 3]))
    areas += [(90, 9, []), (91, 9, [[]])]
    got = {r.point_id: (r.area_id, r.draw) for r in regions.hit_top(spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS), most=16).collect()}
    want = {}
    for i, x, y in points[:-1]:
        on = [(d if d is not None else -1, -a, d) for a, d, rings in areas if sum(inside(x, y, r) for r in rings) % 2]
        if on:
            want[i] = (-max(on)[1], max(on)[2])
    assert got == want and len(set(want.values())) > 5
    empty = spark.createDataFrame([], POINTS)
    assert regions.hit_top(empty, spark.createDataFrame(areas, AREAS)).collect() == []


def test_nearest_place_is_exact(spark):
    rnd = random.Random(3)
    places = crowded(rnd, 300) + [(300, 5.0, 5.0), (301, None, 2.0)]
    points = [(i, rnd.uniform(-90, 100), rnd.uniform(-30, 40)) for i in range(120)] + [(200 + i, 5 + rnd.random() / 900, 5 + rnd.random() / 900) for i in range(60)] + [(900, None, None)]
    d = search.nearest_places(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), most=8)
    got = {r.point_id: r.ord for r in d.collect()}
    for i, x, y in points[:-1]:
        assert got[i] == min(((px - x) * (px - x) + (py - y) * (py - y), o) for o, px, py in places[:-1])[1]
    assert len(got) == len(points) - 1
    one = search.nearest_places(spark.createDataFrame(points, POINTS), spark.createDataFrame([(7, 1.0, 1.0)], PLACES))
    assert {r.ord for r in one.collect()} == {7} and one.count() == len(points) - 1
    assert search.nearest_places(spark.createDataFrame(points, POINTS), spark.createDataFrame([], PLACES)).collect() == []
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def outline(spark, picture):
    cells = [(1 if c == "a" else 2, x, y) for y, row in enumerate(picture) for x, c in enumerate(row) if c != "."]
    r = outlines.rings(spark.createDataFrame(cells, "patch long, x long, y long"))
    sides = r.collect()
    return cells, sides, {(a.patch, tuple(a.ring)): a for a in outlines.ring_areas(r).collect()}, {p.patch: p for p in outlines.patch_areas(r, 2.0).collect()}


def test_outlines_with_holes_islands_and_touching_corners(spark):
    picture = ["aaaaa..", "a.aba..", "aa.aa..", "aaaaabb", ".....bb", "..bb..."]
    cells, sides, areas, patches = outline(spark, picture)
    for patch in (1, 2):
        own = [c for c in cells if c[0] == patch]
        assert sum(a.cells for k, a in areas.items() if k[0] == patch) == len(own) and patches[patch].area_m2 == 2.0 * len(own)
    assert (patches[1].outer, patches[1].holes) == (1, 1) and (patches[2].outer, patches[2].holes) == (3, 0)
    by = {}
    for s in sides:
        by.setdefault((s.patch, tuple(s.ring)), []).append(s)
    for ring in by.values():
        ring.sort(key=lambda s: s.place)
        assert [s.place for s in ring] == list(range(len(ring))) and (ring[0].x, ring[0].y, ring[0].way) == tuple(ring[0].ring)
        assert all((a.x2, a.y2) == (b.x, b.y) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_outline_of_a_long_ring_and_of_nothing(spark):
    _, sides, areas, patches = outline(spark, ["a" * 300, "a" + "." * 298 + "a", "a" * 300])
    assert sorted(a.cells for a in areas.values()) == [-298, 900] and patches[1].perimeter == len(sides) == 606 + 598
    assert outlines.rings(spark.createDataFrame([], "patch long, x long, y long")).collect() == []


def test_search_by_index(spark):
    from terradelta.operators import search_index as x

    names = [(i, n) for i, n in enumerate(["Alpha ring", "alphabet", "beta%_x", "GAMMA alpha", "al", None, "", "aaaa", "Ça va"])] + [(5000 + i, f"alpha {i}") for i in range(40)]
    d = spark.createDataFrame(names, "ord long, name string")
    index = x.posting_lists(d).cache()
    texts = [(1, " ALPHA "), (2, "a"), (3, "%_"), (4, "zzz"), (5, ""), (6, None), (7, "aaaa"), (8, "alpha 39"), (9, "ça"), (10, "l")]
    q = spark.createDataFrame(texts, "query_id long, text string")
    for prefix in (True, False):
        got = {}
        for r in x.find(q, index, d, prefix, most=6).collect():
            got.setdefault(r.query_id, []).append((r.place, r.ord))
        for i, t in texts:
            t = (t or "").strip().lower()
            want = [o for o, n in names if t and n is not None and (n.lower().startswith(t) if prefix else t in n.lower())][:6]
            assert sorted(got.get(i, [])) == list(enumerate(want, 1))
    assert max(len(r.ords) for r in index.collect()) <= x.BLOCK and index.where("gram = 'alp'").select("block").distinct().count() == 2
    both = x.search_all(q, d, index, d, index).where("query_id = 1").orderBy("source", "ord").collect()
    assert [r.source for r in both] == [1] * 5 + [2] * 3
    plan = x.find(q, index, d, False)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


class Counted(Quadtree):
    """Tells how many points were looked up."""

    rows: list[int] = []

    def of_points(self, points, salt):
        self.rows.append(points.count())
        return super().of_points(points, salt)


def test_hits_test_equal_places_and_shapes_once(spark, monkeypatch):
    monkeypatch.setattr(regions, "Quadtree", Counted)
    Counted.rows.clear()
    points = [(i, float(i % 3), 0.5) for i in range(300)]
    square = [[(-1.0, 0.0), (1.5, 0.0), (1.5, 1.0), (-1.0, 1.0)]]
    areas = [(i, i % 5, square) for i in range(50)]
    got = regions.hit_top(spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS), most=16).collect()
    assert {tuple(r) for r in got} == {(i, 4, 4) for i in range(300) if i % 3 < 2} and len(got) == 200
    assert Counted.rows == [3]


def test_search_compares_equal_names_and_texts_once(spark):
    from terradelta.operators import search_index as x

    names = [(i, ("Ring", "ring", "bolt")[i % 3]) for i in range(300)]
    d = spark.createDataFrame(names, "ord long, name string")
    index = x.posting_lists(d).cache()
    assert {o for r in index.collect() for o in r.ords} == {0, 2}
    q = spark.createDataFrame([(i, ("ri", "olt", "in")[i % 3]) for i in range(30)], "query_id long, text string")
    got = {}
    for r in x.find(q, index, d, False, most=7).collect():
        got.setdefault(r.query_id, []).append((r.place, r.ord, r.name))
    for i in range(30):
        want = [(o, n) for o, n in names if ("ri", "olt", "in")[i % 3] in n.lower()][:7]
        assert sorted(got[i]) == [(k, o, n) for k, (o, n) in enumerate(want, 1)]


def test_nearest_looks_up_equal_spots_once(spark, monkeypatch):
    monkeypatch.setattr(search, "Quadtree", Counted)
    Counted.rows.clear()
    points = spark.createDataFrame([(i, float(i % 4), 0.0) for i in range(200)], POINTS)
    places = spark.createDataFrame([(i, float(i % 2) * 3, 0.0) for i in range(100)], PLACES)
    got = search.nearest_places(points, places, most=8).collect()
    assert {(r.point_id, r.ord, r.gap) for r in got} == {(i, int(i % 4 > 1), float(i % 4 in (1, 2))) for i in range(200)} and len(got) == 200
    assert Counted.rows == [4, 2]


def test_rings_are_numbered_in_the_rounds_that_tell_them_apart(spark, monkeypatch):
    written = []
    keep = outlines.stored
    monkeypatch.setattr(outlines, "stored", lambda d, name: written.append(name) or keep(d, name))
    cells = spark.createDataFrame([(1, x, y) for x in range(40) for y in (0, 2)] + [(1, 0, 1)], "patch long, x long, y long")
    places = sorted(r.place for r in outlines.rings(cells).collect())
    assert places == list(range(164)) and len(written) <= 2 + 9 and "outline-left" not in written


def test_areas_from_the_boundary_need_no_rings(spark):
    picture = ["aaaaa..", "a.aba..", "aa.aa..", "aaaaabb", ".....bb", "..bb..."]
    cells = [(1 if c == "a" else 2, x, y) for y, row in enumerate(picture) for x, c in enumerate(row) if c != "."]
    d = outlines.boundary(spark.createDataFrame(cells, "patch long, x long, y long"))
    assert {r.patch: r.area_m2 for r in outlines.boundary_areas(d, 2.0).collect()} == {p: 2.0 * sum(c[0] == p for c in cells) for p in (1, 2)}
