"""Named queries over places: hits of overlapping areas, outlines of patches, nearest addresses, search by index."""

from __future__ import annotations

from pyspark.sql import functions as F

from terradelta import surrogate as s
from terradelta.catalog import REGIONS, query
from terradelta.functions.numbers import rounded_to
from terradelta.operators import outlines, regions, search, search_index
from terradelta.session import stored

# areas around points that suppliers stand for: a square with a hole, and a triangle that is part of it
AREAS = """, a as (select s_suppkey area_id, s_suppkey % 7 draw, 145.2::double + (s_suppkey * 37 % 600) / 1000.0::double x, -38.7::double + (s_suppkey * 53 % 350) / 1000.0::double y, 0.01::double + (s_suppkey % 5) * 0.02::double r from supplier),
ring as (select area_id, draw, unnest([[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)], [(x - r / 2, y - r / 2), (x + r / 2, y - r / 2), (x + r / 2, y + r / 2), (x - r / 2, y + r / 2)], [(x + r, y), (x + 2 * r, y), (x + r, y + r / 2)]]) p from a),
side as (select area_id, draw, p[i][1] px, p[i][2] py, p[i % len(p) + 1][1] qx, p[i % len(p) + 1][2] qy from (select *, unnest(range(1, len(p) + 1)) i from ring)),
x as (select ord, area_id, draw, count(*) c from rg join side on (py > lat) <> (qy > lat) and lon < (qx - px) * (lat - py) / (qy - py) + px group by all)
"""


def _areas(spark, d):
    k = F.col("s_suppkey")
    a = s.table(spark, d, "supplier").select(k.alias("area_id"), (k % 7).alias("draw"), (145.2 + k * 37 % 600 / 1000.0).alias("x"), (-38.7 + k * 53 % 350 / 1000.0).alias("y"), (0.01 + k % 5 * 0.02).alias("r"))
    x, y, r = map(F.col, "xyr")
    at = lambda *ps: F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ps])
    h = r / 2
    rings = F.array(at((x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)), at((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)), at((x + r, y), (x + 2 * r, y), (x + r, y + h)))
    return a.select("area_id", "draw", rings.alias("rings"))


@query(REGIONS + AREAS + "select ord point_id, arg_min(area_id, (-draw, area_id)) area_id, max(draw) draw from x where c % 2 = 1 group by ord")
def point_in_area_top(spark, d):
    """The area on top at every region's point; areas overlap and have holes and parts."""
    points = s.regions(spark, d).select(F.col("ord").alias("point_id"), "lon", "lat")
    return regions.hit_top(points, _areas(spark, d), most=40)


ADDRESSES = """, ad as (select s_suppkey o, s_name || ', VIC' display_name, case when s_suppkey % 3 = 0 then s_name else '' end town, case when s_suppkey % 3 = 1 then upper(s_name) end village, 145.1::double + (s_suppkey * 7919 % 997) / 1200.0::double x, -38.8::double + (s_suppkey * 104729 % 991) / 1500.0::double y from supplier),
n as (select feature_id, feature_type, display_name, town, village, row_number() over (partition by feature_id order by (x - lon) * (x - lon) + (y - lat) * (y - lat), o) k from rg, ad),
p as (select *, coalesce(nullif(town, ''), nullif(village, ''), split_part(display_name, ',', 1)) locality from n where k = 1)
"""


def _addresses(spark, d):
    k, name, none = F.col("s_suppkey"), F.col("s_name"), F.lit(None).cast("string")
    return s.table(spark, d, "supplier").select(
        k.alias("ord"),
        F.concat(name, F.lit(", VIC")).alias("display_name"),
        F.when(k % 3 == 0, name).otherwise("").alias("town"),
        F.when(k % 3 == 1, F.upper(name)).alias("village"),
        *[none.alias(c) for c in ("city", "municipality", "county")],
        (145.1 + k * 7919 % 997 / 1200.0).alias("lon"),
        (-38.8 + k * 104729 % 991 / 1500.0).alias("lat"),
    )


@query(REGIONS + ADDRESSES + "select feature_id, case when feature_type = 'coldspot_patch' then 'Low-change area near ' else 'Landscape change near ' end || locality title, locality from p")
def reverse_nearest(spark, d):
    """The nearest address of every region, from a table that grows with the input."""
    return search.reverse_nearest(s.regions(spark, d), _addresses(spark, d))


CELL_M2 = 900.0  # a cell of 30 m
PATCHES = """with recursive c as (select c_custkey cell_id, c_custkey % 40 x, c_custkey // 40 y, case when c_custkey % 16 in (1, 2, 3, 7, 8) or c_custkey // 40 % 7 = 3 then 'a' else c_mktsegment end state from customer),
e as (select a.cell_id a, b.cell_id b from c a join c b on a.state = b.state and abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach as (select cell_id, cell_id root from c union select e.b, reach.root from reach join e on e.a = reach.cell_id where reach.root < e.b),
pc as (select cell_id, min(root) patch from reach group by cell_id),
"""


def _patch_cells(spark, d):
    k = F.col("c_custkey")
    grid = (k % 16).isin(1, 2, 3, 7, 8) | (F.floor(k / 40) % 7 == 3)
    c = s.table(spark, d, "customer").select(k.alias("cell_id"), (k % 40).alias("x"), F.floor(k / 40).alias("y"), F.when(grid, "a").otherwise(F.col("c_mktsegment")).alias("state"))
    return regions.patches(c).join(c.select("cell_id", "x", "y"), "cell_id")


SIDES = """s as (select patch, unnest([(x, y, x + 1, y, 0), (x + 1, y, x + 1, y + 1, 1), (x + 1, y + 1, x, y + 1, 2), (x, y + 1, x, y, 3)]) t from pc join c using (cell_id)),
f as (select patch, t[1] x, t[2] y, t[3] x2, t[4] y2, t[5] way from s),
b as (select f.*, x * 1000000 + y * 4 + way e from f where not exists (select 1 from f g where g.patch = f.patch and g.x = f.x2 and g.y = f.y2 and g.x2 = f.x and g.y2 = f.y)),
nx as (select b.patch, b.e, n.e next from b join b n on n.patch = b.patch and n.x = b.x2 and n.y = b.y2 qualify row_number() over (partition by b.patch, b.e order by case (n.way - b.way + 4) % 4 when 1 then 0 when 0 then 1 else 2 end) = 1),
low as (select patch, e, e root from nx union select nx.patch, nx.next, low.root from low join nx on nx.patch = low.patch and nx.e = low.e where low.root < nx.next),
rg as (select patch, e, min(root) ring from low group by all),
w as (select patch, ring e, ring, 0::bigint place from rg where e = ring union all select w.patch, nx.next, w.ring, w.place + 1 from w join nx on nx.patch = w.patch and nx.e = w.e where nx.next <> w.ring)
"""


@query(PATCHES + SIDES + "select patch, ring, place, x, y from w join b using (patch, e)")
def patch_outlines(spark, d):
    """The corners of every patch of equal cells on a grid, ring by ring, holes too."""
    r = outlines.rings(_patch_cells(spark, d))
    return r.select("patch", (F.col("ring.x") * 1_000_000 + F.col("ring.y") * 4 + F.col("ring.way")).alias("ring"), "place", "x", "y")


@query(PATCHES.rstrip(",\n") + f", n as (select patch, count(*) cells from pc group by all) select patch, round(cells * {CELL_M2}, 6)::double area_m2, round(cells * {CELL_M2} / 10000, 6)::double area_ha from n")
def patch_hectares(spark, d):
    """Hectares within the outline of every patch; the SQL counts its cells instead."""
    a = outlines.boundary_areas(outlines.boundary(_patch_cells(spark, d)), CELL_M2)
    return a.select("patch", rounded_to(F.col("area_m2"), 6).alias("area_m2"), rounded_to(regions.hectares(F.col("area_m2")), 6).alias("area_ha"))


@query(
    """with q as (select s_suppkey query_id, case s_suppkey % 3 when 0 then 'CUSTOMER#' || lpad((s_suppkey % 1000)::varchar, (6 + s_suppkey % 4)::int, '0') when 1 then ' ' || p_name[s_suppkey % 4 + 1:s_suppkey % 4 + 1 + s_suppkey % 5] else p_name[1:1 + s_suppkey % 2] end text from supplier join part on p_partkey = s_suppkey),
t as (select query_id, lower(trim(text)) t from q where trim(text) <> ''),
h as (select query_id, 1::bigint source, c_custkey ord, c_name as name from t join customer on starts_with(lower(c_name), t) union all select query_id, 2, p_partkey, p_name from t join part on contains(lower(p_name), t)),
f as (select * from h qualify row_number() over (partition by query_id, source order by ord) <= 5)
select query_id, source, ord, name from f qualify row_number() over (partition by query_id order by source, ord) <= 8"""
)
def search_many(spark, d):
    """A query for every supplier over all customers' ids and all parts' names, by stored posting lists."""
    k, name = F.col("s_suppkey"), F.col("p_name")
    q = s.table(spark, d, "supplier").join(s.table(spark, d, "part"), F.col("p_partkey") == k)
    number = F.lpad((k % 1000).cast("string"), 9, "0").substr(F.lit(4) - (k % 4).cast("int"), F.lit(6) + (k % 4).cast("int"))
    text = F.when(k % 3 == 0, F.concat(F.lit("CUSTOMER#"), number)).when(k % 3 == 1, F.concat(F.lit(" "), name.substr((k % 4 + 1).cast("int"), (k % 5 + 1).cast("int")))).otherwise(name.substr(F.lit(1), (1 + k % 2).cast("int")))
    ids = s.table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"))
    parts = s.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    index = [stored(search_index.posting_lists(n), "postings")[0] for n in (ids, parts)]
    found = search_index.search_all(q.select(k.alias("query_id"), text.alias("text")), ids, index[0], parts, index[1])
    return found.select("query_id", F.col("source").cast("long").alias("source"), "ord", "name")
