"""Daily climate, grids, seasons, quality checks and polygons on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.functions import columns as fc
from harvestlens.functions import weather
from harvestlens.operators import grid, quality, results, season, soil, spatial
from harvestlens.plans.registry import query
from harvestlens.plans.testbed import (
    CELLS,
    DAILY,
    EDGES,
    GRID,
    POINTS,
    SERIES,
    WEATHER,
    climate_cells,
    climate_daily,
    grid_daily,
    order_series,
    points,
    polygon_edges,
    r,
    table,
    tidy,
)

_W = ", ".join(WEATHER)


def _rounded(names, prefix=""):
    return ", ".join(r(f"{prefix}{n}", n) for n in names)


# --- selecting, renaming, converting ----------------------------------------


@query(
    "climate_window",
    f"""with {CELLS} select lat, lon, date, {', '.join(r(f"avg(value) filter (variable = '{v}')", v)
 for v in ('tasmax', 'tasmin', 'pr'))} from cells where lat between 3 and 9 and lon between 1 and 7
 and date between '2024-01-05' and '2024-01-20' and variable in ('tasmax', 'tasmin', 'pr') group by all""",
)
def climate_window(spark, sf_dir):
    names = ["tasmax", "tasmin", "pr"]
    window = grid.climate_window(
        climate_cells(spark, sf_dir), (3.0, 9.0), (1.0, 7.0), ("2024-01-05", "2024-01-20"), names
    )
    return tidy(grid.pivot_variables(window, ["lat", "lon", "date"], names))


@query(
    "unit_conversion",
    f"""with {DAILY} select location_id, date, {r('tasmax - 273.15', 'maximum')}, {r('tasmin', 'tasmin')},
 {r('pr * 86400', 'rain', 3)}, {r('rsds * 0.0864', 'radiation')}, {r('hurs', 'hurs')},
 {r('tasmax - tasmin', 'dtr')} from daily""",
)
def unit_conversion(spark, sf_dir):
    daily = climate_daily(spark, sf_dir).withColumn(
        "dtr", weather.diurnal_range(F.col("tasmax"), F.col("tasmin"))
    )
    processed = season.process_point_series(
        daily,
        {"tasmax": "maximum", "pr": "rain", "rsds": "radiation", "absent": "ignored"},
        {
            "maximum": fc.kelvin_to_celsius,
            "rain": fc.flux_to_mm_per_day,
            "radiation": fc.watt_to_megajoule_per_day,
            "absent": fc.kelvin_to_celsius,
        },
    )
    # nine digits before the point leave fewer behind it
    return tidy(processed.withColumn("rain", F.round("rain", 3)))


@query(
    "model_weather",
    f"""with {DAILY} select location_id, date, {r('rsds', 'SRAD')}, {r('tasmax', 'TMAX')},
 {r('tasmin', 'TMIN')}, {r('pr', 'RAIN')}, {r('hurs', 'RHUM')} from daily""",
)
def model_weather(spark, sf_dir):
    return tidy(results.model_weather(climate_daily(spark, sf_dir), "DSSAT", ["location_id", "date"]))


_RA = """37.5860314 * (1 + 0.033 * cos(d)) * (
 acos(greatest(-1, least(1, -tan(phi) * tan(0.409 * sin(d - 1.39))))) * sin(phi) * sin(0.409 * sin(d - 1.39))
 + cos(phi) * cos(0.409 * sin(d - 1.39)) * sin(acos(greatest(-1, least(1, -tan(phi) * tan(0.409 * sin(d - 1.39)))))))"""


@query(
    "et0_radiation",
    f"""with {DAILY}, x as (select location_id, date, tasmax, tasmin, radians((location_id * 7 % 60)::double) as phi,
 dayofyear(date) * 2 * pi() / 365 as d from daily),
 y as (select *, {_RA.replace('37.5860314', '(24 * 60 / pi() * 0.0820)')} as ra,
 case when tasmax - tasmin is not null then sqrt(greatest(0, tasmax - tasmin)) end as s from x)
 select location_id, date, {r('0.16 * s * ra', 'rsds')},
 {r('0.0023 * ((tasmax + tasmin) / 2 + 17.8) * s * ra * 0.408', 'et0', 4)} from y""",
)
def et0_radiation(spark, sf_dir):
    daily = climate_daily(spark, sf_dir).drop("rsds")
    located = daily.withColumn("lat", (F.col("location_id") * 7 % 60).cast("double"))
    derived = weather.add_derived_variables(located).select("location_id", "date", "rsds", "et0")
    return tidy(derived.withColumn("et0", F.round("et0", 4)))


# --- points from grids --------------------------------------------------------


def _pick_sql(axis: str, order: str, where: str = "true") -> str:
    return f"""(select location_id, a as {axis} from (select location_id, a, row_number() over (
 partition by location_id order by {order}) as k from points, (select distinct {axis} as a from grid)
 where {where}) where k = 1)"""


def _cell_sql(lat_order: str, lon_order: str, lat_where: str = "true", lon_where: str = "true") -> str:
    return f"""with {GRID}, {POINTS},
 m as (select * from {_pick_sql('lat', lat_order.replace('X', 'points.lat'), lat_where.replace('X', 'points.lat'))}
 join {_pick_sql('lon', lon_order.replace('X', 'points.lon'), lon_where.replace('X', 'points.lon'))} using (location_id))
 select location_id, date, {_rounded(WEATHER)} from m join grid using (lat, lon)"""


def _series(spark, sf_dir, method="nearest"):
    """Series at the points; the axes come from the long cells, before they are pivoted."""
    axes = grid.grid_axes(climate_cells(spark, sf_dir))
    return grid.extract_points(points(spark, sf_dir), grid_daily(spark, sf_dir), WEATHER, method=method, axes=axes)


@query("nearest_cell", _cell_sql("abs(a - X), a desc", "abs(a - X), a desc"))
def nearest_cell(spark, sf_dir):
    return tidy(_series(spark, sf_dir))


@query("previous_cell", _cell_sql("a desc", "a desc", "a <= X", "a <= X"))
def previous_cell(spark, sf_dir):
    return tidy(
        _series(spark, sf_dir, method="previous")
    )


@query("next_cell", _cell_sql("a", "a", "a >= X", "a >= X"))
def next_cell(spark, sf_dir):
    return tidy(
        _series(spark, sf_dir, method="next")
    )


@query(
    "bilinear",
    f"""with {GRID}, {POINTS},
 ax as (select location_id, points.lat as y, points.lon as x,
  (select max(lat) from grid where grid.lat <= points.lat) as y0,
  (select min(lat) from grid where grid.lat >= points.lat) as y1,
  (select max(lon) from grid where grid.lon <= points.lon) as x0,
  (select min(lon) from grid where grid.lon >= points.lon) as x1 from points),
 f as (select *, case when y0 = y1 then 0 else (y - y0) / (y1 - y0) end as fy,
  case when x0 = x1 then 0 else (x - x0) / (x1 - x0) end as fx from ax
  where y0 is not null and y1 is not null and x0 is not null and x1 is not null),
 c as (select location_id, y0 as lat, x0 as lon, (1 - fy) * (1 - fx) as w from f union all
  select location_id, y0, x1, (1 - fy) * fx from f union all
  select location_id, y1, x0, fy * (1 - fx) from f union all
  select location_id, y1, x1, fy * fx from f)
 select location_id, date, {', '.join(r(f'sum(w * {v}) / nullif(sum(w) filter ({v} is not null), 0)', v) for v in WEATHER)}
 from c join grid using (lat, lon) where w > 0 group by all""",
)
def bilinear(spark, sf_dir):
    return tidy(
        _series(spark, sf_dir, method="linear")
    )


@query(
    "nearest_station",
    """with axis as (select distinct l_extendedprice as a from lineitem),
 b as (select o_orderkey, o_totalprice as x, a as below from orders asof left join axis on o_totalprice >= a),
 n as (select o_orderkey, a as above from orders asof left join axis on o_totalprice <= a)
 select o_orderkey as location_id, below as previous, above as next, case when above is null then below
 when below is null then above when above - x <= x - below then above else below end as nearest
 from b join n using (o_orderkey)""",
)
def nearest_station(spark, sf_dir):
    """An axis of very many distinct coordinates, most of them away from the points."""
    axis = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"))
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("location_id"), F.col("o_totalprice").alias("place"))
    around = grid.axis_neighbours(places, "place", axis, "x")
    return around.select(
        "location_id",
        F.col("x_below").alias("previous"),
        F.col("x_above").alias("next"),
        grid.nearer(F.col("place"), F.col("x_below"), F.col("x_above")).alias("nearest"),
    )


_CUSTOMERS = """cust as (select c_custkey as location_id, (c_custkey * 37 % 1499) / 100.0::double as lat,
 (c_custkey * 53 % 1499) / 100.0::double as lon from customer)"""


@query(
    "point_in_polygon",
    f"""with {EDGES}, {_CUSTOMERS},
 hits as (select location_id, polygon_id from cust join edges on (y1 > lat) <> (y2 > lat)
 and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) group by all having count(*) % 2 = 1)
 select location_id, {r('any_value(lat)', 'lat')}, {r('any_value(lon)', 'lon')}, min(polygon_id) as polygon_id
 from cust left join hits using (location_id) group by location_id""",
)
def point_in_polygon(spark, sf_dir):
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        k.alias("location_id"),
        ((k * 37 % 1499) / 100.0).alias("lat"),
        ((k * 53 % 1499) / 100.0).alias("lon"),
    )
    return tidy(spatial.polygon_of_point(customers, polygon_edges(spark, sf_dir)))


# --- seasons, months, extremes -----------------------------------------------


@query(
    "growing_season",
    f"""with {DAILY}, whole as (select location_id, date, {', '.join(f'round({v}) as {v}' for v in WEATHER)} from daily),
 runs as (select s_suppkey::varchar as simulation_id, s_suppkey // 7 as location_id,
 date '2024-01-01' + (s_suppkey * 3 % 34)::int as season_start,
 date '2024-01-01' + (s_suppkey * 3 % 34 + 5 + s_suppkey % 14)::int as season_end from supplier)
 select simulation_id, runs.location_id, season_start, season_end, count(date) as "GrowingDays",
 {r('coalesce(sum(pr), 0)', 'TotalPrecip_mm')}, {r('avg(tasmax)', 'AvgTmax_C')}, {r('avg(tasmin)', 'AvgTmin_C')},
 {r('coalesce(sum(rsds), 0)', 'TotalRad_MJ')} from runs left join whole
 on runs.location_id = whole.location_id and date between season_start and season_end
 group by simulation_id, runs.location_id, season_start, season_end""",
)
def growing_season(spark, sf_dir):
    k = F.col("s_suppkey")
    first = F.lit("2024-01-01").cast("date")
    runs = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("simulation_id"),
        F.floor(k / 7).alias("location_id"),
        F.date_add(first, (k * 3 % 34).cast("int")).alias("season_start"),
        F.date_add(first, (k * 3 % 34 + 5 + k % 14).cast("int")).alias("season_end"),
    )
    daily = climate_daily(spark, sf_dir).withColumns({v: F.round(v) for v in WEATHER})
    return tidy(season.growing_season_climate(runs, daily, ["location_id"]))


@query(
    "season_from_every_day",
    f"""with {SERIES}, runs as (select climate_model, date as season_start, date + (90 + day(date) * 7)::int as season_end from series),
 p as (select climate_model, date, sum(pr) over w as pr, sum(round(tasmax)) over w as tasmax, count(*) over w as n from series
 window w as (partition by climate_model order by date))
 select r.climate_model, season_start, season_end, e.n - coalesce(s.n, 0) as "GrowingDays",
 {r('e.pr - coalesce(s.pr, 0)', 'TotalPrecip_mm')}, {r('(e.tasmax - coalesce(s.tasmax, 0)) / (e.n - coalesce(s.n, 0))', 'AvgTmax_C')},
 null::double as "AvgTmin_C", null::double as "TotalRad_MJ"
 from runs r asof join p e on r.climate_model = e.climate_model and season_end >= e.date
 asof left join p s on r.climate_model = s.climate_model and season_start > s.date""",
)
def season_from_every_day(spark, sf_dir):
    """Seasons of three to ten months that begin on every day of every series."""
    daily = order_series(spark, sf_dir).withColumn("tasmax", F.round("tasmax"))
    runs = daily.select(
        "climate_model",
        F.col("date").alias("season_start"),
        F.date_add("date", 90 + F.dayofmonth("date") * 7).alias("season_end"),
    )
    return tidy(season.growing_season_climate(runs, daily, ["climate_model"]))


def _statistics_sql(freq: str) -> str:
    return f"""with {SERIES} select climate_model, date_trunc('{freq}', date)::date as period_start,
 {r('coalesce(sum(pr), 0)', 'pr_sum')}, {r('avg(tasmax)', 'tasmax_mean')} from series group by all"""


@query("monthly_climate", _statistics_sql("month"))
def monthly_climate(spark, sf_dir):
    daily = order_series(spark, sf_dir)
    return tidy(season.climate_statistics(daily, ["climate_model"], ["pr", "tasmax"], "month"))


@query("yearly_climate", _statistics_sql("year"))
def yearly_climate(spark, sf_dir):
    daily = order_series(spark, sf_dir)
    return tidy(season.climate_statistics(daily, ["climate_model"], ["pr", "tasmax"], "year"))


@query(
    "extreme_indices",
    f"""with {DAILY} select location_id, count(*) as n_days, count(*) filter (tasmax >= 9000) as heatwave_days,
 count(*) filter (pr < 5000) as dry_days from daily group by all""",
)
def extreme_indices(spark, sf_dir):
    return season.extreme_indices(
        climate_daily(spark, sf_dir), ["location_id"], hot_above=9000.0, dry_below=5000.0
    )


@query(
    "longest_spell",
    f"""with {DAILY}, s as (select location_id, date - row_number() over (partition by location_id order by date)::int
 as island from daily where pr < 7000), n as (select location_id, island, count(*) as c from s group by all)
 select location_id, coalesce(max(c), 0) as longest_dry_spell
 from (select distinct location_id from daily) left join n using (location_id) group by all""",
)
def longest_spell(spark, sf_dir):
    daily = climate_daily(spark, sf_dir)
    return season.longest_spell(daily, ["location_id"], F.col("pr") < 7000, "longest_dry_spell")


def _smooth_sql(width: int) -> str:
    frame = f"over (partition by climate_model order by date rows between {width // 2} preceding and {(width - 1) // 2} following)"
    return f"""with {SERIES} select climate_model, date, {r('pr', 'pr')}, {r('tasmax', 'tasmax')},
 {r(f'case when count(pr) {frame} = {width} then avg(pr) {frame} end', 'smoothed')} from series"""


@query("centered_mean", _smooth_sql(31))
def centered_mean(spark, sf_dir):
    return tidy(
        season.centered_mean(
            order_series(spark, sf_dir), ["climate_model"], "date", "pr", 31, block=500
        )
    )


@query("centered_mean_even", _smooth_sql(12))
def centered_mean_even(spark, sf_dir):
    return tidy(
        season.centered_mean(
            order_series(spark, sf_dir), ["climate_model"], "date", "pr", 12
        )
    )


# --- quality -----------------------------------------------------------------

_LIMITS = {"tasmax": {"min": 100.0, "max": 20000.0}, "pr": {"max": 15000.0}, "tasmin": {"min": 50.0}}
_NEEDED = [*WEATHER, "sfcWind"]


def _report_sql(checks: list[tuple[str, str, str]]) -> str:
    return " union all ".join(
        f"select location_id, '{check}' as \"check\", '{variable}' as variable, "
        f"count(*) filter ({condition}) as n_bad from daily group by location_id having n_bad > 0"
        for check, variable, condition in checks
    )


_ALL_CHECKS = [
    ("missing_variable", "sfcWind", "true"),
    *[("null", v, f"{v} is null") for v in WEATHER],
    ("below_min", "tasmax", "tasmax < 100"),
    ("above_max", "tasmax", "tasmax > 20000"),
    ("above_max", "pr", "pr > 15000"),
    ("below_min", "tasmin", "tasmin < 50"),
]


@query("climate_quality", f"with {DAILY} {_report_sql(_ALL_CHECKS)}")
def climate_quality(spark, sf_dir):
    return quality.quality_report(climate_daily(spark, sf_dir), ["location_id"], _NEEDED, _LIMITS)


@query(
    "climate_accepted",
    f"""with {DAILY}, report as ({_report_sql([("null", "tasmax", "tasmax is null"), ("above_max", "tasmax", "tasmax > 30000")])})
 select location_id, date, {_rounded(WEATHER)} from daily anti join report using (location_id)""",
)
def climate_accepted(spark, sf_dir):
    return tidy(quality.gate(climate_daily(spark, sf_dir), ["location_id"], ["tasmax"], {"tasmax": {"max": 30000.0}}).accepted)


@query(
    "climate_rejected",
    f"""with {DAILY}, report as ({_report_sql([("null", "tasmax", "tasmax is null"), ("above_max", "tasmax", "tasmax > 30000")])})
 select location_id, date, {_rounded(WEATHER)} from daily semi join report using (location_id)""",
)
def climate_rejected(spark, sf_dir):
    return tidy(quality.gate(climate_daily(spark, sf_dir), ["location_id"], ["tasmax"], {"tasmax": {"max": 30000.0}}).rejected)


@query(
    "missing_inputs",
    """with want as (select distinct user_id, unnest(generate_series(date '2024-01-01', date '2024-01-30',
 interval 1 day))::date as date from events)
 select user_id as location_id, date, 'SETUP_ERROR' as status,
 'No climate data for ' || user_id || ', ' || date as message
 from want anti join (select distinct user_id, ts::date as date from events) using (user_id, date)""",
)
def missing_inputs(spark, sf_dir):
    available = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("location_id"), F.col("ts").cast("date").alias("date")
    )
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    expected = available.select("location_id").distinct().withColumn("date", F.explode(days))
    return quality.missing_inputs(expected, available, ["location_id", "date"])


@query(
    "null_counts",
    f"with {DAILY} "
    + " union all ".join(f"select '{v}' as \"column\", count(*) - count({v}) as n_null from daily" for v in WEATHER),
)
def null_counts(spark, sf_dir):
    return quality.null_counts(climate_daily(spark, sf_dir), WEATHER)


# --- soil ----------------------------------------------------------------------


@query(
    "soil_layers",
    """select soil_id, layer_no, depth, sand, clay from (
 select p_partkey::varchar as soil_id, unnest([1, 2, 3]) as layer_no,
 unnest([0.0, p_size::double, 2.0 * p_size]) as depth,
 unnest([60.0 + p_size % 7, 55.0 + p_size % 7, 50.0 + p_size % 7])::double as sand,
 unnest([20.0, 25.0, case when p_size % 2 = 0 then 30.0 end])::double as clay from part)""",
)
def soil_layers(spark, sf_dir):
    s = F.col("p_size")
    clay = [F.lit(20.0), F.lit(25.0)]
    profiles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("soil_id"),
        F.array(F.lit(0.0), s.cast("double"), 2.0 * s).alias("depth"),
        F.array(60.0 + s % 7, 55.0 + s % 7, 50.0 + s % 7).alias("sand"),
        F.when(s % 2 == 0, F.array(*clay, F.lit(30.0))).otherwise(F.array(*clay)).alias("clay"),
    )
    return soil.soil_layers(profiles)
