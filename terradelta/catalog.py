"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta import surrogate as s
from terradelta.functions import labels
from terradelta.functions.dates import capture_date
from terradelta.functions.numbers import rounded_to
from terradelta.functions.places import centre, coordinates, corners
from terradelta.operators import captures, change, history, regions, search, series
from terradelta.plans.params import INTERVALS, RegionFilter, Thresholds
from terradelta.streaming import interactions

T = Thresholds(strong_change=s.STRONG)
CAPTURE_DAYS = 90
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded_to(F.col(c), digits).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


CELLS = f"""
with cy as (select (vec_id // 8) % 10 as region_id, vec_id // 8 as cell_id, (2017 + vec_id % 8)::int as year, embedding::double[] e from embeddings),
lagged as (select *, lag(e) over w as pe, lag(year) over w as py from cy window w as (partition by cell_id order by year)),
ch as (select region_id, cell_id, py || '_' || year as interval, year as end_year, list_distance(pe, e) as change from lagged where year - py = 1),
cs as (select region_id, cell_id, sum(change) cumulative, avg(change) mean_change, count(*) filter (change > {s.STRONG}) strong, var_pop(change) variance, regr_slope(change, end_year::double) slope, count(change) n_intervals from ch group by all)
"""
REGIONS = (
    "with rg as (select c_name feature_id, c_custkey ord, case when c_mktsegment = 'HOUSEHOLD' then 'coldspot_patch' else 'hotspot_patch' end feature_type, "
    "case when c_mktsegment = 'HOUSEHOLD' then 'low_change_reference' else ['repeated_change', 'mixed_change', 'mostly_single_period_change'][c_custkey % 3 + 1] end behaviour, "
    "greatest(c_acctbal, 0) / 400 area_ha, ['greening', 'browning', 'stable'][c_nationkey % 3 + 1] ndvi_direction, c_mktsegment <> 'HOUSEHOLD' embedding_signal, c_custkey % 2 = 0 dea_signal, "
    "case when c_custkey % 11 <> 0 then c_custkey % 3 = 0 end ndvi_signal, 145.2::double + (c_custkey % 600) / 1000.0::double lon, -38.7::double + (c_custkey % 350) / 1000.0::double lat, "
    + ", ".join(f"((c_custkey * 11 + {5 * i}) % 100) / 100.0::double change_{iv}, ((c_custkey * 7 + {13 * i}) % 20) / 100.0::double hotspot_{iv}" for i, iv in enumerate(INTERVALS))
    + " from customer)"
)
YEARS = """
with oc as (select o_custkey feature_id, year(o_orderdate) as year, o_orderpriority as class, round(o_totalprice * 100)::bigint cents from orders),
cc as (select feature_id, year, class, count(*) n from oc group by all),
rk as (select *, sum(n) over (partition by feature_id, year) total, row_number() over (partition by feature_id, year order by n desc, class) k from cc),
dom as (select feature_id, year, max(class) filter (k = 1) as class, max(n / total) filter (k = 1) class_share, max(class) filter (k = 2) secondary, max(n / total) filter (k = 2) secondary_share from rk group by all),
nd as (select feature_id, year, ((2 * sum(cents) + 50 * count(*)) // (100 * count(*)))::double / 1e6 ndvi_mean from oc group by all),
ry as (select feature_id, year, class, class_share, ndvi_mean from dom join nd using (feature_id, year)),
tr as (select *, lag(year) over w as previous_year, lag(class) over w as pc, ndvi_mean - lag(ndvi_mean) over w as ndvi_step from ry window w as (partition by feature_id order by year)),
ev as (select *, previous_year is not null and pc is distinct from class as land_changed, coalesce(abs(ndvi_step) >= 0.0527, false) as ndvi_event from tr),
oc2 as (select feature_id, min_by(class, year) first_class, max_by(class, year) last_class, bool_or(land_changed) changed, min(year) filter (land_changed) first_change_year, count(*) filter (land_changed) n_changes, count(*) filter (ndvi_event) n_ndvi_events, max_by(ndvi_mean, year) - min_by(ndvi_mean, year) ndvi_change from ev group by all)
"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return change.intervals(s.cell_year(spark, d))


def _region_years(spark: SparkSession, d: str) -> DataFrame:
    r = history.dominant(s.class_cells(spark, d), ["feature_id", "year"], sums=("cents",))
    return r.select("feature_id", "year", "class", "class_share", "secondary", "secondary_share", s.greenness(F.col("cents"), F.col("rows")).alias("ndvi_mean"))


@query(CELLS + "select region_id::bigint region_id, cell_id, interval, end_year::bigint end_year, round(change, 6) change from ch")
def change_cell_interval(spark, d):
    return rounded(_changes(spark, d))


REGION_STATS = """, st as (select region_id, count(*) n_cells, avg(mean_change) mean_change, avg(cumulative) cumulative_change_mean, avg(strong) mean_hotspot_intervals, max(strong) maximum_hotspot_intervals,
avg(case when strong >= 2 then 1.0::double else 0 end) repeat_change_coverage, avg(variance) variance_mean, avg(slope) slope_mean from cs group by all)
"""


@query(
    CELLS
    + REGION_STATS
    + """select region_id, n_cells, round(mean_change, 6) mean_change, round(cumulative_change_mean, 6) cumulative_change_mean, round(mean_hotspot_intervals, 6) mean_hotspot_intervals, maximum_hotspot_intervals,
round(repeat_change_coverage, 6) repeat_change_coverage, round(variance_mean, 6) variance_mean, round(slope_mean, 6) slope_mean,
case when repeat_change_coverage < 0.1 then 'mostly_single_period_change' when repeat_change_coverage < 0.5 then 'mixed_change' else 'repeated_change' end behaviour from st"""
)
def change_region_stats(spark, d):
    return rounded(change.region_stats(_changes(spark, d), T))


@query(CELLS + "select a.region_id, a.cell_id, round(list_distance(a.e, b.e), 6) change from cy a join cy b on a.cell_id = b.cell_id and a.year = 2017 and b.year = 2024")
def change_endpoint(spark, d):
    return rounded(change.endpoints(s.cell_year(spark, d), 2017, 2024))


@query(CELLS + f"select region_id, interval, round(avg(change), 6) change, round(avg(case when change > {s.STRONG} then 1.0::double else 0 end), 6) hot_fraction from ch group by all")
def interval_hot_fraction(spark, d):
    return rounded(change.hot_fraction(_changes(spark, d), T))


@query(CELLS + ", m as (select region_id, interval, end_year, round(avg(change), 9) v from ch group by all) select region_id, replace(interval, '_', '-') strongest_change_interval, round(v, 6) mean_change from m qualify row_number() over (partition by region_id order by v desc, end_year) = 1")
def strongest_interval(spark, d):
    return rounded(change.strongest(_changes(spark, d)))


@query(CELLS + REGION_STATS + ", t as (select region_id, round(cumulative_change_mean, 9) total, ntile(3) over (order by round(cumulative_change_mean, 9), region_id) tile from st) select region_id, round(total, 6) total, tile::bigint tile, ['low', 'moderate', 'high'][tile] overall_activity from t")
def activity_tertile(spark, d):
    return rounded(change.activity(change.region_stats(_changes(spark, d), T)))


@query(CELLS + "select round(quantile_cont(variance, 0.95), 6) threshold, count(variance) n from cs")
def variance_threshold(spark, d):
    return rounded(change.threshold(change.cell_stats(_changes(spark, d), T), "variance"))


@query(
    CELLS
    + """, sta as (select case when n_intervals < 7 then 'no_data' when strong >= 4 then 'persistent_hot' when strong >= 1 then 'episodic_hot' when mean_change < 0.2 then 'cold' else 'background' end state from cs),
c as (select state, count(*) cells from sta group by all)
select state, cells, round(cells / sum(cells) over (), 6) share_of_grid, case when state <> 'no_data' then round(cells / sum(cells) filter (state <> 'no_data') over (), 6) end share_of_finite_grid from c"""
)
def cell_state_summary(spark, d):
    return rounded(change.state_summary(change.cell_states(change.cell_stats(_changes(spark, d), T), T)))


FILTERS = {
    "default": (RegionFilter(), "true"),
    "area": (RegionFilter(coldspots=False, min_area=12.5), "feature_type <> 'coldspot_patch' and area_ha >= 12.5"),
    "behaviour": (RegionFilter(behaviour="mixed_change", direction="greening"), "behaviour = 'mixed_change' and ndvi_direction = 'greening'"),
    "evidence_all": (RegionFilter(evidence=("dea_signal", "ndvi_signal")), "dea_signal and coalesce(ndvi_signal, false)"),
    "evidence_any": (RegionFilter(evidence=("dea_signal", "ndvi_signal"), match="any", hotspots=True), "dea_signal or coalesce(ndvi_signal, false)"),
    "active_period": (RegionFilter(active_only=True, interval="2019_2020", min_area=1.0), "hotspot_2019_2020 >= 0.05 and area_ha >= 1"),
    "none": (RegionFilter(hotspots=False, coldspots=False), "false"),
}
for _name, (_filter, _where) in FILTERS.items():

    def _one(spark, d, f=_filter):
        return regions.count_regions(s.regions(spark, d), f)

    _one.__name__ = f"region_filter_{_name}"
    query(REGIONS + f" select count(*) filter ({_where}) shown, count(*) filter (({_where}) and feature_type <> 'coldspot_patch') hot, count(*) filter (({_where}) and feature_type = 'coldspot_patch') cold, count(*) total from rg")(_one)


@query(REGIONS + " select feature_id, round(area_ha, 6) area_ha, behaviour from rg where feature_type = 'hotspot_patch' and area_ha >= 20 and hotspot_2022_2023 >= 0.05")
def region_filter_rows(spark, d):
    return rounded(regions.select_regions(s.regions(spark, d), RegionFilter(coldspots=False, min_area=20, active_only=True, interval="2022_2023")).select("feature_id", "area_ha", "behaviour"))


@query(
    REGIONS
    + f""", b as (select behaviour, count(*) regions from rg group by all) select behaviour, case {' '.join(f"when behaviour = '{k}' then '{v}'" for k, v in labels.BEHAVIOUR_LABELS.items())} end as label,
case {' '.join(f"when behaviour = '{k}' then '{v}'" for k, v in labels.BEHAVIOUR_COLOURS.items())} end colour, regions from b"""
)
def behaviour_counts(spark, d):
    return regions.behaviour_counts(s.regions(spark, d))


@query(REGIONS + " select count(*) filter (embedding_signal) embedding, count(*) filter (dea_signal) dea, count(*) filter (ndvi_signal) ndvi, count(*) filter (embedding_signal and dea_signal and ndvi_signal) all_three from rg")
def evidence_counts(spark, d):
    return regions.evidence_counts(s.regions(spark, d))


@query(YEARS + "select feature_id, year, class, round(class_share, 6) class_share, secondary, round(secondary_share, 6) secondary_share, coalesce(secondary_share >= 0.15, false) secondary_shown from dom")
def dominant_class(spark, d):
    return rounded(history.dominant(s.class_cells(spark, d), ["feature_id", "year"]))


@query(YEARS + "select feature_id, year, class, round(class_share, 6) class_share, round(ndvi_mean, 6) ndvi_mean, previous_year, land_changed, round(ndvi_step, 6) ndvi_step, ndvi_event from ev")
def class_transitions(spark, d):
    return rounded(history.transitions(_region_years(spark, d)).select("feature_id", "year", "class", "class_share", "ndvi_mean", "previous_year", "land_changed", "ndvi_step", "ndvi_event"))


@query(
    YEARS
    + """, o as (select *, case when not changed then 'stayed' when first_class = last_class then 'returned' else 'moved' end outcome from oc2)
select feature_id, first_class, last_class, first_change_year, n_changes, outcome, case outcome when 'stayed' then 'Stayed ' || first_class when 'returned' then 'Returned to ' || last_class else first_class || ' → ' || last_class end headline from o"""
)
def class_history_outcome(spark, d):
    o = history.outcomes(history.transitions(_region_years(spark, d)))
    return rounded(o.select("feature_id", "first_class", "last_class", "first_change_year", "n_changes", "outcome", "headline"))


@query(
    YEARS
    + f"""select feature_id, round(ndvi_change, 6) ndvi_change, case when ndvi_change >= 0.0527 then 'greening' when ndvi_change <= -0.0527 then 'browning' else 'stable' end ndvi_direction,
case when ndvi_change >= 0.0527 then '{labels.DIRECTION_LABELS["greening"]}' when ndvi_change <= -0.0527 then '{labels.DIRECTION_LABELS["browning"]}' else '{labels.DIRECTION_LABELS["stable"]}' end as label,
case when ndvi_change > 0 then 'increased' when ndvi_change < 0 then 'decreased' else 'was unchanged' end ndvi_action from oc2"""
)
def ndvi_direction(spark, d):
    o = history.outcomes(history.transitions(_region_years(spark, d)))
    return rounded(o.select("feature_id", "ndvi_change", "ndvi_direction", labels.direction_label(F.col("ndvi_direction")).alias("label"), "ndvi_action"))


@query(YEARS + "select year, count(*) filter (ndvi_event) events, count(*) filter (land_changed) land_changes, count(*) regions from ev group by all")
def ndvi_step_events(spark, d):
    t = history.transitions(_region_years(spark, d))
    return rounded(t.groupBy("year").agg(F.count_if("ndvi_event").alias("events"), F.count_if("land_changed").alias("land_changes"), F.count("*").alias("regions")))


LONG = ", lo as (" + " union all ".join(f"select feature_id, ord, '{iv}' as interval, change_{iv} change, hotspot_{iv} hotspot, feature_type from rg" for iv in INTERVALS) + ")"


@query(
    REGIONS
    + LONG
    + """, ndv as (select o_custkey, (2017 + year(o_orderdate) - 1994)::int as year, ((2 * sum(round(o_totalprice * 100)::bigint) + 50 * count(*)) // (100 * count(*)))::double / 1e6 ndvi_mean from orders group by all)
select feature_id, interval, replace(interval, '_', ' → ') as label, interval[3:4] || '–' || interval[8:9] short_label, round(change, 6) change, round(hotspot, 6) hotspot, round(ndvi_mean, 6) ndvi_mean from lo left join ndv on o_custkey = ord and year = split_part(interval, '_', 2)::int"""
)
def timeline_table(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    ndvi = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ord"), (2017 + F.year("o_orderdate") - 1994).alias("year")).agg(s.greenness(F.sum(cents), F.count("*")).alias("ndvi_mean"))
    return rounded(history.timeline(s.regions(spark, d), ndvi, "ord"))


@query(REGIONS + LONG + " select feature_id, interval, round(change, 6) change, round(hotspot, 6) hotspot from lo")
def interval_unpivot(spark, d):
    return rounded(regions.stacked_intervals(s.regions(spark, d), ["feature_id"]))


@query(CELLS + "select region_id, " + ", ".join(f"round(avg(change) filter (interval = '{iv}'), 6) \"{iv}\"" for iv in INTERVALS) + " from ch group by all")
def interval_pivot(spark, d):
    return rounded(regions.wide_intervals(change.hot_fraction(_changes(spark, d), T), ["region_id"]))


@query(
    YEARS
    + """, b as (select feature_id, min(ndvi_mean) low, max(ndvi_mean) high, count(ndvi_mean) points from ry group by all), p as (select *, (case when high - low <> 0 then high - low else greatest(abs(high), 0.1) end) * 0.12 pad from b)
select feature_id, round(low, 6) low, round(high, 6) high, points, round(greatest(0, low - pad), 6) axis_low, round(high + pad, 6) axis_high from p"""
)
def series_domain(spark, d):
    return rounded(series.domain(_region_years(spark, d), "feature_id", "ndvi_mean"))


@query(
    REGIONS
    + LONG
    + """ select feature_id, interval, case when feature_type = 'coldspot_patch' then -1::bigint else (change >= 0.1)::bigint + (change >= 0.25)::bigint + (change >= 0.45)::bigint + (change >= 0.7)::bigint end bucket,
round(case when feature_type = 'coldspot_patch' then 0.42 when hotspot <= 0 then 0.2 when hotspot <= 0.25 then 0.2 + hotspot / 0.25 * 0.32 else 0.52 + (hotspot - 0.25) / 0.75 * 0.3 end, 6)::double opacity from lo"""
)
def change_ramp(spark, d):
    rows = regions.stacked_intervals(s.regions(spark, d), ["feature_id", "feature_type"])
    return rounded(series.painted(rows, "change", "hotspot").select("feature_id", "interval", "bucket", "opacity"))


@query("select l_orderkey, l_returnflag, l_linestatus, max(l_linenumber)::bigint l_linenumber, min(l_linenumber)::bigint first_l_linenumber, round(max_by(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)), 6) l_quantity from lineitem group by l_orderkey, l_returnflag, l_linestatus")
def capture_dedupe(spark, d):
    rows = s.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    last = captures.last_of(rows, ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return rounded(last.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "first_l_linenumber", "l_quantity"))


@query("select l_orderkey, l_linenumber::bigint l_linenumber, l_partkey, round(l_quantity, 6) l_quantity, l_shipdate::date ship_day from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, case when l_discount = 0 then 9999 else l_discount end, l_linenumber, l_partkey, l_shipdate) = 1")
def capture_top_draw(spark, d):
    rows = s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    top = captures.top_of(rows, ["l_orderkey"], F.col("l_quantity"), F.col("l_discount"), ["l_linenumber", "l_partkey", "l_shipdate"])
    return rounded(top.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.to_date("l_shipdate").alias("ship_day")))


NEAREST = f"""
with t as (select c_custkey region, y::int as year from customer, unnest(range(1995, 2002)) u(y)),
c as (select o_custkey region, o_orderdate::date as day, o_totalprice resolution, o_orderkey capture_id from orders),
n as (select t.region, t.year, c.day, c.resolution, c.capture_id, abs(c.day - make_date(t.year, 7, 1)) dist from t left join c on t.region = c.region),
b as (select * from n qualify row_number() over (partition by region, year order by dist nulls last, resolution, capture_id) = 1),
near as (select region, year::bigint as year, day nearest_day, dist::bigint distance_days, coalesce(dist <= {CAPTURE_DAYS}, false) available, case when dist <= {CAPTURE_DAYS} then capture_id end capture_id,
case when dist <= {CAPTURE_DAYS} then case when year(day) = year then 'same year' else 'other year' end end kind from b)
"""


def _targets(spark, d):
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    return s.table(spark, d, "customer").select(F.col("c_custkey").alias("region"), years.alias("year"))


@query(NEAREST + "select * from near")
def capture_nearest(spark, d):
    return rounded(captures.nearest(_targets(spark, d), s.captures(spark, d), "region", CAPTURE_DAYS))


@query(NEAREST + "select year, count(*) filter (available) available, count(*) filter (kind = 'same year') same_year, count(*) targets from near group by all")
def capture_availability(spark, d):
    n = captures.nearest(_targets(spark, d), s.captures(spark, d), "region", CAPTURE_DAYS)
    return rounded(n.groupBy("year").agg(F.count_if("available").alias("available"), F.count_if(F.col("kind") == "same year").alias("same_year"), F.count("*").alias("targets")))


@query(NEAREST + "select region, year, nearest_day, distance_days, capture_id from near")
def capture_nearest_sorted(spark, d):
    """The same choice without pairs, by one sort of each region's days and years."""
    return rounded(captures.nearest_sorted(_targets(spark, d), s.captures(spark, d), "region", CAPTURE_DAYS).select("region", "year", "nearest_day", "distance_days", "capture_id"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d') src_date, o_orderdate::date as day from orders")
def capture_dates(spark, d):
    o = s.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("src_date"))
    return o.withColumn("day", capture_date(F.col("src_date")))


@query("select c_name feature_id, floor((regexp_replace(c_name, '[^0-9]', '', 'g')::bigint - 1) / 1000)::bigint shard, 'regions_' || lpad(floor((regexp_replace(c_name, '[^0-9]', '', 'g')::bigint - 1) / 1000)::bigint::varchar, 3, '0') || '.json' shard_file from customer")
def detail_shard_lookup(spark, d):
    return regions.with_shard(s.regions(spark, d).select("feature_id"))


@query(
    """with a as (select 1::bigint source, c_custkey ord, c_name as name from customer where starts_with(lower(c_name), 'customer#00000001') order by c_custkey limit 5),
b as (select 2::bigint source, n_nationkey::bigint ord, n_name as name from nation where contains(lower(n_name), 'customer#00000001') order by n_nationkey limit 5)
select * from (select * from a union all select * from b) order by source, ord limit 8"""
)
def search_ids_places(spark, d):
    return _search(spark, d, " Customer#00000001 ")


@query("select 2::bigint source, n_nationkey::bigint ord, n_name as name from nation join region on n_regionkey = r_regionkey where contains(lower(n_name || ' ' || r_name), 'nation') order by n_nationkey limit 5")
def search_places(spark, d):
    return _search(spark, d, "NATION")


def _search(spark, d, text):
    nations, parts = s.table(spark, d, "nation"), s.table(spark, d, "region")
    places = nations.join(F.broadcast(parts), F.col("n_regionkey") == F.col("r_regionkey"))  # a region table of five rows
    places = places.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("r_name").alias("detail"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return rounded(search.search(text, s.regions(spark, d), places).select("source", "ord", "name"))


@query(
    """with q as (select c_custkey, case c_custkey % 4 when 0 then '-38.' || c_custkey || ',145.5' when 1 then '145.' || c_custkey || '  -38.6' when 2 then '38.6,145.5' else c_custkey || '5,5' end query from customer),
m as (select *, regexp_extract(trim(query), '^(-?[0-9]{1,3}(?:\\.[0-9]+)?)\\s*[, ]\\s*(-?[0-9]{1,3}(?:\\.[0-9]+)?)$', 1) a, regexp_extract(trim(query), '^(-?[0-9]{1,3}(?:\\.[0-9]+)?)\\s*[, ]\\s*(-?[0-9]{1,3}(?:\\.[0-9]+)?)$', 2) b from q),
n as (select *, try_cast(a as double) x, try_cast(b as double) y from m)
select c_custkey, query, case when x < 0 and y > 100 then y when x > 100 and y < 0 then x end lon, case when x < 0 and y > 100 then x when x > 100 and y < 0 then y end lat from n"""
)
def parse_coordinates(spark, d):
    k = F.col("c_custkey").cast("string")
    q = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("-38."), k, F.lit(",145.5"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("145."), k, F.lit("  -38.6"))).when(F.col("c_custkey") % 4 == 2, F.lit("38.6,145.5")).otherwise(F.concat(k, F.lit("5,5")))
    return s.table(spark, d, "customer").select("c_custkey", q.alias("query")).withColumn("p", coordinates(F.col("query"))).select("c_custkey", "query", "p.lon", "p.lat")


@query(
    f"""with p as (select p_partkey, replace(lower(p_type), ' ', '_') raw, p_brand || ' <&"''>' b, (p_partkey % 101) / 100.0::double c, ['repeated_change', 'mixed_change', 'mostly_single_period_change', 'low_change_reference'][p_partkey % 4 + 1] k from part), q as (select *, floor(c * 100 + 0.5)::int::varchar pc from p)
select p_partkey, array_to_string(list_transform(string_split(replace(raw, '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as label, replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') escaped,
case when k = 'low_change_reference' then '{labels.SUMMARY_LOW}' when k = 'repeated_change' then pc || '{labels.SUMMARY_REPEATED}' when k = 'mixed_change' then pc || '{labels.SUMMARY_MIXED}' when pc = '0' then '{labels.SUMMARY_NEVER_TWICE}' else '{labels.SUMMARY_SINGLE[0]}' || pc || '{labels.SUMMARY_SINGLE[1]}' end sentence from q"""
)
def label_text(spark, d):
    kinds = F.array(*map(F.lit, labels.BEHAVIOUR_LABELS))
    p = s.table(spark, d, "part").select("p_partkey", F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("raw"), F.concat("p_brand", F.lit(" <&\"'>")).alias("b"), (F.col("p_partkey") % 101 / 100.0).alias("c"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("k"))
    return p.select("p_partkey", labels.plain_label(F.col("raw")).alias("label"), labels.escape_markup(F.col("b")).alias("escaped"), labels.repeat_sentence(F.col("k"), F.col("c")).alias("sentence"))


@query(REGIONS + ", b as (select min(lon) west, min(lat) south, max(lon) east, max(lat) north, count(*) points from rg) select round(west, 6) west, round(south, 6) south, round(east, 6) east, round(north, 6) north, points, round((west + east) / 2, 6) lon, round((south + north) / 2, 6) lat from b")
def bbox_summary(spark, d):
    b = regions.bounds(s.regions(spark, d))
    lon, lat = centre(*map(F.col, ("west", "south", "east", "north")))
    return rounded(b.withColumn("lon", lon).withColumn("lat", lat))


@query(
    REGIONS
    + """, b as (select ord // 100 shard, min(lon) w, min(lat) s, max(lon) e, max(lat) n from rg group by all), c as (select shard, unnest([1, 2, 3, 4]) k, [(w, n), (e, n), (e, s), (w, s)] p from b)
select shard::bigint shard, k::bigint corner, round(p[k][1], 6) lon, round(p[k][2], 6) lat from c"""
)
def bbox_corners(spark, d):
    """The four corners of the box around every hundred regions, from the north-west on."""
    b = s.regions(spark, d).groupBy(F.floor(F.col("ord") / 100).alias("shard")).agg(*[f(c).alias(k) for f, c, k in ((F.min, "lon", "w"), (F.min, "lat", "s"), (F.max, "lon", "e"), (F.max, "lat", "n"))])
    d = b.select("shard", F.posexplode(corners(*map(F.col, "wsen"))).alias("k", "p"))
    return rounded(d.select("shard", (F.col("k") + 1).alias("corner"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")))


SQUARES = """, q as (select i * 10 + j area_id, 145.2::double + i * 0.1::double w, 145.2::double + (i + 1) * 0.1::double e, -38.7::double + j * 0.1::double s, -38.7::double + (j + 1) * 0.1::double n from range(6) a(i), range(10) b(j))
"""
SIDES = """, v as (select 2 * area_id + k area_id, unnest(case k when 0 then [(w, s, e, s), (e, s, e, n), (e, n, w, s)] else [(w, s, e, n), (e, n, w, n), (w, n, w, s)] end) t from q, range(2) z(k)),
l as (select area_id, t[1] px, t[2] py, t[3] qx, t[4] qy from v),
x as (select ord, area_id, count(*) c from rg join l on ((py > lat) <> (qy > lat)) and lon < (qx - px) * (lat - py) / (qy - py) + px group by all)
"""


@query(REGIONS + SQUARES + SIDES + "select ord point_id, min(area_id)::bigint area_id from x where c % 2 = 1 group by ord")
def point_in_area(spark, d):
    """Every point in the triangles that halve squares of a tenth of a degree."""
    return _hit(spark, d, ((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))


@query(REGIONS + SQUARES + "select ord point_id, min(area_id)::bigint area_id from rg join q on lon >= w and lon < e and lat >= s and lat < n group by ord")
def point_in_area_edges(spark, d):
    """Every point in the squares; a square holds its west and south edges only."""
    return _hit(spark, d, ((0, 0), (1, 0), (1, 1), (0, 1)))


def _hit(spark, d, *shapes):
    ring = lambda shape: F.array(*[F.struct((145.2 + (F.col("i") + a) * 0.1).alias("x"), (-38.7 + (F.col("j") + b) * 0.1).alias("y")) for a, b in shape])
    squares = spark.range(60).select(F.floor(F.col("id") / 10).alias("i"), (F.col("id") % 10).alias("j"))
    areas = squares.select(F.posexplode(F.array(*map(ring, shapes))).alias("k", "ring"), (F.col("i") * 10 + F.col("j")).alias("square"))
    points = s.regions(spark, d).select(F.col("ord").alias("point_id"), "lon", "lat")
    return regions.hit(points, areas.select((F.col("square") * len(shapes) + F.col("k")).alias("area_id"), "ring"), 0.1)


@query(
    """with recursive c as (select c_custkey cell_id, c_custkey % 40 x, c_custkey // 40 y, c_mktsegment state from customer),
e as (select a.cell_id a, b.cell_id b from c a join c b on a.state = b.state and abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach as (select cell_id, cell_id root from c union select e.b, reach.root from reach join e on e.a = reach.cell_id where reach.root < e.b)
select cell_id, min(root) patch from reach group by cell_id"""
)
def connected_patches(spark, d):
    """Patches of equal segment on a grid of customers."""
    c = s.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") % 40).alias("x"), F.floor(F.col("c_custkey") / 40).alias("y"), F.col("c_mktsegment").alias("state"))
    return regions.patches(c)


SESSIONS = """
with e as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) >= 3600000000, true)::int as fresh from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from e)
"""


@query(SESSIONS + "select user_id, count(*) n_events, epoch_us(min(ts))::bigint started_us, max_by(event_id, (ts, event_id)) event_id, max_by(event_type, (ts, event_id)) event_type from n group by user_id, session")
def session_last_event(spark, d):
    e = interactions.debounced(s.table(spark, d, "events"))
    return e.select("user_id", "n_events", F.unix_micros("started").alias("started_us"), "event_id", "event_type")


@query("select user_id, event_type, max_by(event_id, (ts, event_id)) event_id, round(max_by(value, (ts, event_id)), 6) as value, count(*) requests from events group by user_id, event_type")
def latest_request_wins(spark, d):
    return rounded(interactions.latest(s.table(spark, d, "events"), ["user_id", "event_type"]))


@query("select epoch_us(date_trunc('day', ts))::bigint day_us, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def window_results(spark, d):
    r = interactions.results(s.table(spark, d, "events"))
    return r.select(F.unix_micros("day").alias("day_us"), "event_type", "n", rounded_to(F.col("total"), 4).alias("total"))
