"""More named queries: packages, details, lookups, texts and series, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradelta import surrogate as s
from terradelta.catalog import CELLS, FILTERS, LONG, REGION_STATS, REGIONS, YEARS, T, _changes, _region_years, query, rounded
from terradelta.functions import labels, numbers, places
from terradelta.functions.dates import capture_kind, capture_text, middle_of
from terradelta.operators import captures, change, history, regions, search, series, summary, yearly
from terradelta.plans.params import YEARS as YEARS_OF_CELLS
from terradelta.plans.params import AREA_STEP, AREA_TOP, ENDPOINT, INTERVALS, imagery_year
from terradelta.session import scratch, stored
from terradelta.sources import loading, packages
from terradelta.streaming import interactions

# details of the regions, made from the same numbers
DETAILS = (
    ", de as (select feature_id, ord, feature_type, lon, lat, ord * 137.0::double area_m2, (ord % 97) / 97.0::double endpoint_change_mean, (ord % 89) / 100.0::double endpoint_hotspot_fraction, "
    + ", ".join(f"change_{iv} annual_change_{iv}, hotspot_{iv} annual_hotspot_{iv}_fraction" for iv in INTERVALS)
    + " from rg where ord % 7 <> 0)"
)


def _details(spark, d):
    k = F.col("ord")
    wide = [c for iv in INTERVALS for c in (F.col(f"change_{iv}").alias(f"annual_change_{iv}"), F.col(f"hotspot_{iv}").alias(f"annual_hotspot_{iv}_fraction"))]
    r = s.regions(spark, d).where(k % 7 != 0)
    return r.select("feature_id", "ord", "feature_type", "lon", "lat", (k * 137.0).alias("area_m2"), (k % 97 / 97.0).alias("endpoint_change_mean"), (k % 89 / 100.0).alias("endpoint_hotspot_fraction"), *wide)


@query(REGIONS + " select feature_id, feature_type, round(area_ha, 6) area_ha, dea_signal, round(hotspot_2017_2018, 6) hotspot from rg")
def feature_collection_scan(spark, d):
    """Regions written as feature collections, one file for each thousand, and read back as rows."""
    r = regions.with_shard(s.regions(spark, d))
    f = r.select("shard", F.struct(F.lit("Feature").alias("type"), F.struct("feature_id", "feature_type", "behaviour", "area_ha", "dea_signal", *[f"hotspot_{i}" for i in INTERVALS]).alias("properties")).alias("f"))
    f = f.groupBy("shard").agg(F.collect_list("f").alias("features"))  # at most a shard's thousand
    where = scratch(spark, "collections")
    f.select("shard", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("shard").text(where)
    got = packages.features(spark, where)
    return rounded(got.select("feature_id", "feature_type", "area_ha", "dea_signal", F.col("hotspot_2017_2018").alias("hotspot")))


@query(REGIONS + DETAILS + " select feature_id, round(area_m2, 6) area_m2, round(annual_change_2019_2020, 6) annual_change from de")
def detail_json_shards(spark, d):
    """Details written as one JSON object of records by id for each shard, and read back."""
    r = regions.with_shard(_details(spark, d))
    r = r.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", F.struct("feature_id", "area_m2", "annual_change_2019_2020")))).alias("m"))  # a shard's thousand
    where = scratch(spark, "details")
    r.select("shard", F.to_json("m").alias("value")).write.partitionBy("shard").text(where)
    return rounded(packages.details(spark, where).select("feature_id", "area_m2", F.col("annual_change_2019_2020").alias("annual_change")))


@query(REGIONS + DETAILS + " select feature_id, round(area_m2, 6) area_m2, round(lon, 6) lon, round(lat, 6) lat from de where feature_id in ('Customer#000000008', 'Customer#000000120', 'Customer#000000007')")
def detail_lookup(spark, d):
    """Records of three ids from the sharded table; the third has none."""
    where = scratch(spark, "shards")
    packages.write_details(_details(spark, d), where)
    stored = packages.stored_details(spark, where)
    found = [packages.detail(stored, f"Customer#{n:09d}") for n in (8, 120, 7)]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]).select("feature_id", "area_m2", "lon", "lat"))


@query(REGIONS + DETAILS + ", dd as (select feature_id, ord, area_m2 from de union all select feature_id, ord + 1000000, area_m2 + 1 from de where ord % 2 = 0) select feature_id, behaviour, round(a, 6) area_m2 from rg left join (select feature_id, max_by(area_m2, ord) a from dd group by all) using (feature_id)")
def region_details(spark, d):
    """Every region with its detail; of two details of one id the later counts."""
    t = _details(spark, d).select("feature_id", "ord", "area_m2")
    twice = t.where(F.col("ord") % 2 == 0).select("feature_id", (F.col("ord") + 1_000_000).alias("ord"), (F.col("area_m2") + 1).alias("area_m2"))
    return rounded(regions.with_details(s.regions(spark, d).select("feature_id", "behaviour"), t.unionByName(twice)))


@query(REGIONS + DETAILS + " select feature_id, round(area_m2 / 10000, 9) area_ha from de")
def area_hectares(spark, d):
    return rounded(_details(spark, d).select("feature_id", regions.hectares(F.col("area_m2")).alias("area_ha")), 9)


@query(
    REGIONS
    + DETAILS
    + """ select feature_id, 'Start-to-end change' change_label, 'Area with strong change' fraction_label, round(endpoint_change_mean, 6) change, round(endpoint_hotspot_fraction, 6) strong_fraction from de
union all select feature_id, 'Change 2019 → 2020', 'Area with strong change this period', round(annual_change_2019_2020, 6), round(annual_hotspot_2019_2020_fraction, 6) from de"""
)
def detail_metric(spark, d):
    """The metrics of the whole time and of one period."""
    t = _details(spark, d)
    return rounded(regions.metric(t, ENDPOINT).unionByName(regions.metric(t, "2019_2020")))


OVERLAYS = [(iv, f"data/annual_hotspot_{iv}.png") for iv in INTERVALS[1:]]


@query(CELLS + ", o as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in OVERLAYS) + ") v(interval, overlay)) select region_id, interval, overlay, count(*) cells from ch left join o using (interval) group by all")
def interval_overlay(spark, d):
    """Cells by interval with its overlay; the first interval has none."""
    o = spark.createDataFrame(OVERLAYS, "interval string, overlay string")
    return regions.with_overlay(_changes(spark, d).groupBy("region_id", "interval").agg(F.count("*").alias("cells")), o)


CATALOGUE = """
with r as (select n_nationkey num, make_date(2017 + n_nationkey % 8, 3, 5) release_date, case when n_nationkey % 5 <> 0 then 'service/' || n_name end service from nation),
y as (select 2017 + n_regionkey as year, n_nationkey num, row_number() over (partition by n_regionkey order by n_nationkey) - 1 ordinal from nation)
"""


@query(CATALOGUE + "select year::bigint as year, ordinal, num::bigint release_num, release_date, service metadata_service from y join r using (num) where service is not null")
def release_candidates(spark, d):
    """The catalogue of releases as nested JSON, read back as candidates that have a service."""
    n = s.table(spark, d, "nation")
    service = F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("service/"), "n_name")).otherwise("")
    release = F.struct(F.make_date(2017 + F.col("n_nationkey") % 8, F.lit(3), F.lit(5)).alias("release_date"), service.alias("metadata_service"))
    releases = n.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), release))).alias("releases"))  # a catalogue of 25
    years = n.groupBy((2017 + F.col("n_regionkey")).cast("string").alias("y")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("nums"))
    years = years.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("y", "nums"))).alias("years"))
    where = scratch(spark, "catalogue")
    releases.join(years).select(F.to_json(F.struct(F.lit(548).alias("maximum_capture_distance_days"), "years", "releases")).alias("value")).write.text(where)
    return rounded(packages.candidates(packages.json_object(spark, where, packages.CATALOGUE)))


@query(REGIONS + " select feature_id, round(area_ha, 6) area_ha, behaviour from rg")
def table_sink(spark, d):
    """Regions written by behaviour, read back through the folders' names."""
    where = scratch(spark, "sink")
    packages.write_table(s.regions(spark, d).select("feature_id", "area_ha", "behaviour"), where, by=("behaviour",))
    return rounded(spark.read.parquet(where).select("feature_id", "area_ha", "behaviour"))


KNOWN = ", kp as (select * from (values " + ", ".join(f"({i}::bigint, '{n}', '{t}', {x}::double, {y}::double)" for i, (n, t, x, y) in enumerate(search.PLACES)) + ") v(ord, name, detail, px, py))"


@query(REGIONS.replace(" ord,", " k,") + KNOWN + " select ord, name, detail, count(k) regions, round(min(area_ha), 6) least_ha from kp left join rg on lon between px - 0.015::double and px + 0.015::double and lat between py - 0.015::double and py + 0.015::double group by all")
def known_places(spark, d):
    """The places known without a service, each with the regions in the box around it."""
    r = s.regions(spark, d).select("feature_id", "area_ha", F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = places.within_box(F.col("x"), F.col("y"), *places.nearby_box(F.col("lon"), F.col("lat")))
    d = r.join(F.broadcast(search.gazetteer(spark)), near, "inner").groupBy("ord").agg(F.count("*").alias("regions"), F.min("area_ha").alias("least_ha"))  # a fixed list of ten
    g = search.gazetteer(spark).join(d, "ord", "left")
    return rounded(g.select("ord", "name", "detail", F.coalesce("regions", F.lit(0)).alias("regions"), "least_ha"))


def _cube(spark, d):
    """The stored summary of all regions."""
    where = scratch(spark, "summary")
    packages.write_table(summary.cube(s.regions(spark, d)), where)
    return spark.read.parquet(where)


@query(
    REGIONS
    + " union all ".join(
        f" select '{k}' as name, {str(f.is_active).lower()} active, '{'summary' if summary.fits(f) else 'scan'}' as source, count(*) filter ({w}) shown, count(*) filter (({w}) and feature_type <> 'coldspot_patch') hot, count(*) filter (({w}) and feature_type = 'coldspot_patch') cold, count(*) total from rg"
        for k, (f, w) in FILTERS.items()
    )
)
def filter_activity(spark, d):
    """Whether each filter narrows the regions, where its counts come from, and the counts."""
    regions_, cube = s.regions(spark, d), _cube(spark, d)
    rows = [summary.counted(regions_, cube, f).select(F.lit(k).alias("name"), F.lit(f.is_active).alias("active"), "source", "shown", "hot", "cold", "total") for k, (f, _) in FILTERS.items()]
    return reduce(DataFrame.unionByName, rows)


STEPS = round(AREA_TOP / AREA_STEP)
SETTINGS = f""", st as (select row_number() over (order by k, b, g, e) setting, k * {AREA_STEP}::double area, nullif(b, '-') b, nullif(g, '-') g, e from range({STEPS + 1}) a(k), (select distinct behaviour b from rg union all select '-'), (select distinct ndvi_direction g from rg union all select '-'), range(5) z(e))
select setting, area, b behaviour, g direction, e evidence, count(*) filter (area_ha >= area and (b is null or behaviour = b) and (g is null or ndvi_direction = g)
and case e when 0 then true when 1 then dea_signal when 2 then coalesce(ndvi_signal, false) when 3 then dea_signal and coalesce(ndvi_signal, false) else dea_signal or coalesce(ndvi_signal, false) end) shown from st, rg group by all
"""


@query(REGIONS + SETTINGS)
def filter_summary(spark, d):
    """Regions shown for every place of the area slider with every pattern, direction and evidence, all from the summary."""
    cube = _cube(spark, d)
    some = lambda c: cube.select(c).distinct().unionByName(spark.sql(f"select '-' {c}"))  # noqa: E731  a few words
    areas = spark.range(STEPS + 1).select(F.col("id").cast("int").alias("step"))
    every = areas.join(F.broadcast(some("behaviour"))).join(F.broadcast(some("ndvi_direction"))).join(F.broadcast(spark.range(5).select(F.col("id").alias("evidence"))))
    order = Window.orderBy("step", "behaviour", "ndvi_direction", "evidence")  # the settings, not the regions
    e = F.col("evidence")
    settings = every.select(
        F.row_number().over(order).alias("setting"),
        "step",
        F.nullif("behaviour", F.lit("-")).alias("behaviour"),
        F.nullif("ndvi_direction", F.lit("-")).alias("direction"),
        "evidence",
        *[F.lit(True).alias(c) for c in ("hotspots", "coldspots")],
        e.isin(1, 3, 4).alias("dea"),
        e.isin(2, 3, 4).alias("ndvi"),
        (e == 3).alias("every"),
    )
    d = settings.join(summary.for_settings(cube, settings), "setting")
    return rounded(d.select("setting", (F.col("step") * AREA_STEP).alias("area"), "behaviour", "direction", "evidence", "shown"))


IDENTIFY = """
with q as (select c_custkey request_id, c_custkey % 500 user_id, c_custkey seq, 145.2::double + (c_custkey % 600) / 1000.0::double lon, -38.7::double + (c_custkey % 350) / 1000.0::double lat from customer),
l as (select * from q qualify row_number() over (partition by user_id order by seq desc) = 1),
n as (select o_orderkey, 145.2::double + (o_orderkey % 601) / 1000.0::double x, -38.7::double + (o_orderkey % 353) / 1000.0::double y, (o_orderkey // 3)::varchar object_id, case when o_orderkey % 10 = 0 then '20230231' else strftime(o_orderdate, '%Y%m%d') end src_date,
case when o_orderkey % 6 <> 0 then (o_orderkey % 4)::double end resolution, o_orderkey % 5 draw, case when o_orderkey % 3 <> 0 then o_orderpriority else '' end description, o_orderstatus as name from orders),
c as (select request_id, object_id, src_date, resolution, draw, description, name from l join n on x between lon - 0.015 and lon + 0.015 and y between lat - 0.015 and lat + 0.015),
t as (select * from c qualify row_number() over (partition by request_id order by draw desc, case when coalesce(resolution, 0) = 0 then 9999 else resolution end, object_id, src_date, description) = 1)
"""


@query(IDENTIFY + "select request_id, try_strptime(src_date, '%Y%m%d')::date as day, resolution, coalesce(nullif(description, ''), name) provider from t where try_strptime(src_date, '%Y%m%d') is not null")
def snapshot_identify(spark, d):
    """The capture at the latest point of each user, from a snapshot of captures around it."""
    k = F.col("c_custkey")
    q = s.table(spark, d, "customer").select(k.alias("request_id"), (k % 500).alias("user_id"), k.alias("seq"), (145.2 + k % 600 / 1000.0).alias("lon"), (-38.7 + k % 350 / 1000.0).alias("lat"))
    o = F.col("o_orderkey")
    n = s.table(spark, d, "orders").select(
        (145.2 + o % 601 / 1000.0).alias("lon"),
        (-38.7 + o % 353 / 1000.0).alias("lat"),
        F.floor(o / 3).cast("string").alias("object_id"),
        F.when(o % 10 == 0, F.lit("20230231")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("src_date"),
        F.when(o % 6 != 0, (o % 4).cast("double")).alias("resolution"),
        (o % 5).alias("draw"),
        F.when(o % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("description"),
        F.col("o_orderstatus").alias("name"),
    )
    return captures.identify(q, n)


@query("with t as (select *, case when l_linenumber % 3 = 0 then '20230231' else strftime(l_shipdate, '%Y%m%d') end src_date from lineitem), f as (select * from t qualify row_number() over (partition by l_orderkey order by l_quantity desc, case when l_discount = 0 then 9999 else l_discount end, l_linenumber, l_partkey, src_date) = 1) select l_orderkey, l_linenumber::bigint l_linenumber, try_strptime(src_date, '%Y%m%d')::date as day from f where try_strptime(src_date, '%Y%m%d') is not null")
def capture_top_dated(spark, d):
    """The capture on top; none if that one has no valid date."""
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit("20230231")).otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    rows = s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", text.alias("src_date"))
    top = captures.top_dated(rows, ["l_orderkey"], F.col("l_quantity"), F.col("l_discount"), "src_date", ["l_linenumber", "l_partkey", "src_date"])
    return rounded(top.select("l_orderkey", "l_linenumber", "day"))


ADDRESSES = [(i, f"{n}, {t}", n if i % 3 == 0 else "", n.upper() if i % 3 == 1 else None, None, "" if i % 2 else None, None, x, y) for i, (n, t, x, y) in enumerate(search.PLACES)]
_ADDRESS = "ord long, display_name string, town string, village string, city string, municipality string, county string, lon double, lat double"


@query(
    REGIONS
    + ", ad as (select * from (values "
    + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x) for x in r) + ")" for r in ADDRESSES)
    + """) v(o, display_name, town, village, city, municipality, county, x, y)),
n as (select feature_id, feature_type, display_name, town, village, row_number() over (partition by feature_id order by (x - lon) * (x - lon) + (y - lat) * (y - lat), o) k from rg, ad),
p as (select *, coalesce(nullif(town, ''), nullif(village, ''), split_part(display_name, ',', 1)) locality from n where k = 1)
select feature_id, case when feature_type = 'coldspot_patch' then 'Low-change area near ' else 'Landscape change near ' end || locality title, locality from p"""
)
def reverse_places(spark, d):
    """The nearest known place of each region, as its title."""
    return search.reverse_nearest(s.regions(spark, d), spark.createDataFrame(ADDRESSES, _ADDRESS))


@query("select 3::bigint source, s_suppkey ord, s_name as name from supplier where contains(lower(s_name), 'supplier') and 145.2::double + s_suppkey % 100 / 100.0::double between 145.25 and 145.6 order by s_suppkey limit 4")
def search_bounded(spark, d):
    """A longer text that is no id is looked up in the remote table, inside a box."""
    places_ = s.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.lit("").alias("detail"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    k = F.col("s_suppkey")
    remote = s.table(spark, d, "supplier").select(k.alias("ord"), F.col("s_name").alias("name"), F.lit("").alias("detail"), (145.2 + k % 100 / 100.0).alias("lon"), F.lit(-38.5).alias("lat"))
    found = search.search("Supplier", s.regions(spark, d), places_, remote, (145.25, -39.0, 145.6, -38.0))
    return rounded(found.select("source", "ord", "name"))


@query(REGIONS + " select feature_id, round(lon, 6) lon, round(lat, 6) lat from rg where lon between 145.3::double - 0.015::double and 145.3::double + 0.015::double and lat between -38.6::double - 0.015::double and -38.6::double + 0.015::double")
def near_point(spark, d):
    """Regions around one given point, as a device would give it."""
    box = places.nearby_box(F.lit(145.3), F.lit(-38.6))
    return rounded(s.regions(spark, d).where(places.within_box(F.col("lon"), F.col("lat"), *box)).select("feature_id", "lon", "lat"))


@query(CELLS + ", ep as (select list_distance(a.e, b.e) change from cy a join cy b on a.cell_id = b.cell_id and a.year = 2017 and b.year = 2024) select round(quantile_cont(change, 0.95), 6) threshold, count(change) n from ep")
def endpoint_threshold(spark, d):
    """The 95th hundredth of the change from the first to the last year, in rounds of counts."""
    return rounded(change.threshold(change.endpoints(s.cell_year(spark, d), 2017, 2024), "change", most=20))


ANNUAL = """, de as (select *, case when feature_id % 5 = 0 then 'Unknown 0' when feature_id % 5 <> 1 then class || ' detail' end detail_class, class_share / 2 detail_share from dom join nd using (feature_id, year)),
an as (select *, lag(year) over w py, lag(class) over w pc, ndvi_mean - lag(ndvi_mean) over w st from de window w as (partition by feature_id order by year))
"""


@query(
    YEARS
    + ANNUAL
    + """select feature_id, year, class, round(class_share, 6) class_share, coalesce(nullif(detail_class, 'Unknown 0'), 'Detailed class unavailable') detail, round(detail_share, 6) detail_share,
case when secondary_share >= 0.15 then 'Also present: ' || secondary || ' (' || printf('%.0f', secondary_share * 100) || '%)' end also, case when py is not null and pc is distinct from class then 'Land-cover change' end land_event,
case when abs(st) >= 0.0527 then 'Vegetation change from ' || py end ndvi_event, round(ndvi_mean, 6) ndvi_mean from an"""
)
def annual_history(spark, d):
    r = _region_years(spark, d)
    k = F.col("feature_id")
    detail = F.when(k % 5 == 0, F.lit("Unknown 0")).when(k % 5 != 1, F.concat("class", F.lit(" detail")))
    return rounded(history.annual(r.withColumn("detail_class", detail).withColumn("detail_share", F.col("class_share") / 2)))


@query(
    YEARS
    + """, o as (select *, case when not changed then 'stayed' when first_class = last_class then 'returned' else 'moved' end outcome from oc2), m as (select *, round(abs(ndvi_change) * 1000) k from o)
select feature_id, case outcome when 'stayed' then 'The dominant mapped broad class was unchanged in every annual DEA map.' when 'returned' then 'The dominant mapped broad class first changed in ' || first_change_year || ', then returned by 2001.'
else 'The first change in the dominant mapped broad class was detected in ' || first_change_year || '.' end land_note,
'Average NDVI ' || case when ndvi_change > 0 then 'increased by ' when ndvi_change < 0 then 'decreased by ' else 'was unchanged' end || case when ndvi_change = 0 then '' else regexp_replace(printf('%.3f', round(abs(ndvi_change), 3)), '\\.?0+$', '') end || ' between the first and last study years.' ndvi_note from m"""
)
def history_notes(spark, d):
    """What a region's land and greenness did, in sentences."""
    o = history.outcomes(history.transitions(_region_years(spark, d)))
    return o.select("feature_id", labels.land_note(F.col("outcome"), F.col("first_change_year"), 2001).alias("land_note"), labels.ndvi_note(F.col("ndvi_change")).alias("ndvi_note"))


@query("with i as (select unnest(generate_series(0, 6)) k), r as (select feature, k, (2017 + k) || '_' || (2018 + k) as interval from i, (select n_nationkey feature from nation)) select feature::bigint feature, interval, coalesce(lag(interval) over w, interval) previous, coalesce(lead(interval) over w, interval) as next from r window w as (partition by feature order by k)")
def interval_steps(spark, d):
    """The period before and after each, no further than the ends."""
    n = s.table(spark, d, "nation").select(F.col("n_nationkey").alias("feature"), F.explode(F.array(*map(F.lit, INTERVALS))).alias("interval"))
    return rounded(series.neighbours(n, "feature", "interval"))


@query(
    REGIONS
    + LONG
    + """, v as (select feature_id, interval, case when ord % 7 <> 0 and not (ord % 5 = 0 and interval = '2019_2020') then change end v, row_number() over (partition by feature_id order by interval) - 1 k from lo),
b as (select feature_id, min(v) low, max(v) high from v group by all), p as (select *, (case when high - low <> 0 then high - low else greatest(abs(high), 0.1) end) * 0.12::double pad from b where low is not null),
a as (select feature_id, greatest(0::double, low - pad) lo, high + pad hi from p)
select feature_id, interval, round(31 + k * 311.0::double / 6, 4) x, round(9 + (hi - v) / (case when hi = lo then 1 else hi - lo end) * 86, 4) y from v join a using (feature_id) where v is not null"""
)
def series_points(spark, d):
    """Chart points; a missing value keeps its place and gives no point, a region without values no series."""
    r = regions.stacked_intervals(s.regions(spark, d), ["feature_id", "ord"])
    gone = (F.col("ord") % 7 == 0) | ((F.col("ord") % 5 == 0) & (F.col("interval") == "2019_2020"))
    return rounded(series.placed(r.withColumn("v", F.when(~gone, F.col("change"))), "feature_id", "interval", "v"), 4)


@query(
    """with p as (select p_partkey, case p_partkey % 6 when 0 then null when 1 then 'NaN'::double when 2 then p_retailprice else (p_partkey % 1000) / 1000.0::double end x from part)
select p_partkey, case when e is null then '—' else format('{:,}', floor(round(e, 2))::bigint) || regexp_replace(substr((round(e, 2) - floor(round(e, 2)))::decimal(12, 2)::varchar, 2), '\\.?0+$', '') end as number,
case when e is null then '—' else round(e * 100, 1)::decimal(20, 1)::varchar || '%' end as percent, case when e < 1 then round(e, 2)::decimal(12, 2)::varchar || ' m' when e >= 1 then round(e, 1)::decimal(12, 1)::varchar || ' m' end resolution from (select p_partkey, case when not isnan(x) then x::decimal(20, 6) end e from p)"""
)
def number_texts(spark, d):
    """Numbers, percentages and resolutions as texts; halves of the last digit go up, as decimals."""
    k = F.col("p_partkey")
    x = F.when(k % 6 == 0, F.lit(None).cast("double")).when(k % 6 == 1, F.lit(float("nan"))).when(k % 6 == 2, F.col("p_retailprice")).otherwise(k % 1000 / 1000.0)
    p = s.table(spark, d, "part").select("p_partkey", x.alias("x"))
    return p.select("p_partkey", numbers.number_text(F.col("x")).alias("number"), numbers.percent_text(F.col("x"), 1).alias("percent"), numbers.resolution_text(F.col("x")).alias("resolution"))


@query("select o_orderkey, strftime(o_orderdate, '%-d %b %Y') as text, case when o_orderkey % 9 = 0 then 'provisional' when year(o_orderdate) = 1996 then 'same year' else 'other year' end kind, abs(o_orderdate::date - date '1996-07-01')::bigint n_days from orders")
def capture_texts(spark, d):
    """Dates as texts, how they stand to a year, and the days to its middle."""
    o = s.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    year = F.lit(1996)
    return o.select("o_orderkey", capture_text(F.col("day")).alias("text"), capture_kind(F.col("day"), year, F.col("o_orderkey") % 9 == 0).alias("kind"), F.abs(F.datediff("day", middle_of(year))).cast("long").alias("n_days"))


@query(REGIONS + " select feature_id, printf('%.3f', round(lon, 3)) || ':' || printf('%.3f', round(lat, 3)) grid_key, case when feature_type = 'coldspot_patch' then 'Low-change area' else 'Landscape change area' end title, array_to_string(list_filter([behaviour, case when ord % 3 = 0 then '' else ndvi_direction end, case when ord % 4 <> 0 then feature_type end], lambda x: x <> ''), ' · ') parts, case ndvi_direction when 'greening' then 'Increasing' when 'browning' then 'Decreasing' else 'Not available' end trend, case behaviour when 'mixed_change' then 'Some years stand out' else 'Not available' end pattern from rg")
def record_texts(spark, d):
    """Grid keys, titles, joined parts and the labels of trends and patterns."""
    r = s.regions(spark, d)
    k = F.col("ord")
    trend = F.when(F.col("ndvi_direction") == "greening", "increasing").when(F.col("ndvi_direction") == "browning", "decreasing")
    pattern = F.when(F.col("behaviour") == "mixed_change", "mixed").otherwise(F.col("behaviour"))
    parts = labels.joined(F.col("behaviour"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("ndvi_direction")), F.when(k % 4 != 0, F.col("feature_type")))
    return r.select("feature_id", places.grid_key(F.col("lon"), F.col("lat")).alias("grid_key"), labels.record_title(F.col("feature_type")).alias("title"), parts.alias("parts"), labels.trend_label(trend).alias("trend"), labels.pattern_label(pattern).alias("pattern"))


@query(
    REGIONS
    + """, z as (select feature_id, ord, lon, lat, case ord % 4 when 0 then 'detail' when 1 then 'feature' when 2 then 'marker' end got, 9 + ord % 3 zoom from rg)
select feature_id, round(case when got is not null then lon + case got when 'detail' then 0 when 'feature' then 1 else 2 end when zoom < 10.5 then (145.2 + 145.8) / 2 else 145.0 end, 6)::double lon, round(case when got is not null then lat when zoom < 10.5 then (-38.7 + -38.4) / 2 else -38.0 end, 6)::double lat from z"""
)
def lookup_points(spark, d):
    """Which point to look at: what is open or chosen, else the box's centre from afar or the map's."""
    k = F.col("ord")
    at = lambda more: F.struct((F.col("lon") + more).alias("lon"), F.col("lat").alias("lat"))
    box = F.struct(F.lit(145.2).alias("west"), F.lit(-38.7).alias("south"), F.lit(145.8).alias("east"), F.lit(-38.4).alias("north"))
    middle = F.struct(F.lit(145.0).alias("lon"), F.lit(-38.0).alias("lat"))
    p = places.lookup_point(F.when(k % 4 == 0, at(0.0)), F.when(k % 4 <= 1, at(1.0)), F.when(k % 4 <= 2, at(2.0)), 9 + k % 3, box, middle)
    return rounded(s.regions(spark, d).select("feature_id", p.alias("p")).select("feature_id", "p.lon", "p.lat"))


@query(YEARS + "select feature_id, round(max(ndvi_mean) filter (year = 1996), 6) ndvi_1996, max(class) filter (year = 1996) class_1996, count(*) n_years from ry group by all")
def nested_context(spark, d):
    """Yearly context as a map of each region; a missing year gives nothing."""
    r = _region_years(spark, d)
    m = r.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string").alias("k"), F.struct("class", "ndvi_mean").alias("v")))).alias("c"))  # a region's years
    return rounded(m.select("feature_id", F.col("c")["1996"]["ndvi_mean"].alias("ndvi_1996"), F.col("c")["1996"]["class"].alias("class_1996"), F.size("c").cast("long").alias("n_years")))


LABELS = ", il as (select * from (values " + ", ".join(f"('{iv}', {2024 if iv == ENDPOINT else int(iv[5:])}::bigint, '{'2017–2024 overview' if iv == ENDPOINT else iv.replace('_', ' → ')}', '{'overview' if iv == ENDPOINT else iv[2:4] + '–' + iv[7:]}')" for iv in (ENDPOINT, *INTERVALS)) + ") v(interval, imagery_year, label, short_label))"


@query(CELLS + LABELS + ", ep as (select 'endpoint' as interval, list_distance(a.e, b.e) change from cy a join cy b on a.cell_id = b.cell_id and a.year = 2017 and b.year = 2024), al as (select interval, change from ch union all select * from ep) select interval, imagery_year, label, short_label, count(*) cells, round(avg(change), 6) change from al join il using (interval) group by all")
def interval_labels(spark, d):
    """Mean change of the cells by interval and from end to end, with the labels and the year of imagery of each."""
    whole = change.endpoints(s.cell_year(spark, d), 2017, 2024).select(F.lit(ENDPOINT).alias("interval"), "change")
    rows = _changes(spark, d).select("interval", "change").unionByName(whole).groupBy("interval").agg(F.count("*").alias("cells"), F.avg("change").alias("change"))
    iv = F.col("interval")
    year = reduce(lambda c, x: c.when(iv == x, imagery_year(x)), INTERVALS, F.when(iv == ENDPOINT, imagery_year(ENDPOINT)))
    return rounded(rows.select("interval", year.cast("long").alias("imagery_year"), labels.interval_label(iv).alias("label"), labels.interval_short(iv).alias("short_label"), "cells", "change"))


@query(REGIONS + ", a as (select feature_id, ord from rg union all select feature_id, ord + 1 from rg) select feature_id, max(ord) ord from a group by all")
def repeated_requests(spark, d):
    """Requests that come twice count once: the form of the stream's rule on a table."""
    r = s.regions(spark, d).select("feature_id", "ord")
    both = r.unionByName(r.select("feature_id", (F.col("ord") + 1).alias("ord")))
    return interactions.newest(both, "feature_id", "ord")


@query("select event_id, k from (select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events)")
def safe_reads(spark, d):
    """Nested values of texts that may be broken: nothing instead of an error."""
    e = s.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(REGIONS + DETAILS + " select feature_id, behaviour, round(area_m2, 6) area_m2, round(annual_change_2019_2020, 6) annual_change from rg left join de using (feature_id)")
def details_beside_regions(spark, d):
    """Every region with its detail, from tables bucketed by id: a join without an exchange."""
    name = f"t{uuid.uuid4().hex}"
    r = packages.write_bucketed(s.regions(spark, d).select("feature_id", "behaviour"), f"{name}_regions", scratch(spark, "bucketed-regions"))
    t = packages.write_bucketed(_details(spark, d).select("feature_id", "ord", "area_m2", "annual_change_2019_2020"), f"{name}_details", scratch(spark, "bucketed-details"))
    both = regions.with_details(r.hint("merge"), t)
    return rounded(both.select("feature_id", "behaviour", "area_m2", F.col("annual_change_2019_2020").alias("annual_change")))


@query(CELLS + REGION_STATS + "select region_id, n_cells, round(mean_change, 6) mean_change, round(cumulative_change_mean, 6) cumulative_change_mean, round(mean_hotspot_intervals, 6) mean_hotspot_intervals, maximum_hotspot_intervals, round(repeat_change_coverage, 6) repeat_change_coverage, round(variance_mean, 6) variance_mean, round(slope_mean, 6) slope_mean, case when repeat_change_coverage < 0.1 then 'mostly_single_period_change' when repeat_change_coverage < 0.5 then 'mixed_change' else 'repeated_change' end behaviour from st")
def region_stats_by_year(spark, d):
    """The regions' statistics from a state that takes one year after the other."""
    where = scratch(spark, "years")
    packages.write_table(s.cell_year(spark, d), where, by=("year",))
    vectors = spark.read.parquet(where)
    state = yearly.nothing_yet(spark)
    for year in YEARS_OF_CELLS:  # each reads the folder of its year and the state before
        state, _ = stored(yearly.advanced(state, vectors.where(F.col("year") == year), T), "year-state")
    return rounded(yearly.region_stats(state, T))


@query(
    CELLS
    + """, bu as (select end_year, floor(change / 0.001)::bigint bucket, count(*) n from ch group by all),
up as (select *, sum(n) over (partition by end_year order by bucket) upto, sum(n) over (partition by end_year) total from bu)
select end_year::bigint end_year, max(total)::bigint n, round((arg_min(bucket, bucket) + 0.5) * 0.001, 6)::double threshold, round(arg_min(n, bucket) / max(total), 6) rank_error from up where upto >= total * 0.95::double group by end_year"""
)
def threshold_by_year(spark, d):
    """The 95th hundredth of each year's change from counts that are kept by region and year, with the rank error."""
    where = scratch(spark, "buckets")
    packages.write_table(yearly.bucket_counts(_changes(spark, d)), where, by=("end_year",))
    return rounded(yearly.thresholds(spark.read.parquet(where), ["end_year"]))


LOADED = """, lf as (select *, (ord - 1) // 100 shard, 'shard=' || ((ord - 1) // 100)::varchar as file, row_number() over (partition by (ord - 1) // 100 order by ord) - 1 place from rg where ord > 0),
lr as (select *, shard % 5 = 3 cut, case when ord % 41 = 5 then 'no feature_id' when ord % 41 = 7 then 'area_ha is no number' when ord % 41 = 11 then 'no properties' end reason from lf)
"""


def _collections(spark, d):
    """Regions as files of a hundred, some features broken, every fifth file cut off; the manifest names one file too many."""
    k = F.col("ord")
    r = s.regions(spark, d).where("ord > 0").select("feature_id", "feature_type", "behaviour", "area_ha", "ord", F.floor((k - 1) / 100).alias("shard"))
    area = F.when(k % 41 == 7, F.lit("wide")).otherwise(F.col("area_ha").cast("string"))
    p = F.when(k % 41 != 11, F.struct(F.when(k % 41 != 5, F.col("feature_id")).alias("feature_id"), "feature_type", "behaviour", area.alias("area_ha")))
    f = r.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(F.lit("Feature").alias("type"), p.alias("properties")).alias("f")))), lambda x: x["f"]).alias("features"))  # a file's hundred
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    text = F.regexp_replace(text, '"area_ha":"([0-9.E-]+)"', '"area_ha":$1')  # numbers stay numbers
    text = F.when(F.col("shard") % 5 == 3, F.left(text, F.lit(500))).otherwise(text)
    where = scratch(spark, "collections")
    f.select("shard", text.alias("value")).write.partitionBy("shard").text(where)
    manifest = f.select(F.concat(F.lit("shard="), F.col("shard").cast("string")).alias("file"))
    return manifest.unionByName(spark.range(1).select(F.lit("shard=none").alias("file"))), where


@query(
    REGIONS
    + LOADED
    + """select file, case when cut then 'no collection' when count(reason) > 0 then 'broken records' else 'ok' end status, case when cut then 0 else count(*) end records, case when cut then 0 else count(reason) end broken from lr group by file, cut
union all select 'shard=none', 'missing', 0, 0"""
)
def load_report(spark, d):
    """What became of every file that a manifest names, each apart from the others."""
    manifest, path = _collections(spark, d)
    files = loading.opened(manifest, path, depth=2)
    return loading.report(files, loading.records(files))


@query(REGIONS + LOADED + "select file, place, reason from lr where not cut and reason is not null")
def load_broken(spark, d):
    """Broken features with their file, place and reason."""
    return loading.broken(loading.records(loading.opened(*_collections(spark, d), depth=2))).select("file", "place", "reason")


@query(REGIONS + LOADED + "select feature_id, behaviour, round(area_ha, 6) area_ha from lr where not cut and reason is null")
def load_sound(spark, d):
    """The features that are sound, read in spite of the others."""
    return rounded(loading.sound(loading.records(loading.opened(*_collections(spark, d), depth=2))).select("feature_id", "behaviour", "area_ha"))
