"""Run matrix, standard outputs, run status and surrogate data on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestlens.functions import columns as fc
from harvestlens.functions import status as st
from harvestlens.operators import adaptation as ad
from harvestlens.operators import apply, impacts, quality, results, runs, scenario, surrogate
from harvestlens.plans import workflows
from harvestlens.plans.registry import query
from harvestlens.plans.testbed import (
    CROP_MODEL_OF_FLAG,
    PERIODS,
    SCHEMAS,
    SIM,
    STATUS,
    VALUES,
    as_status_events,
    case_sql,
    once,
    points,
    r,
    sim_results,
    status_events,
    table,
    tidy,
    translate,
    whole,
)
from harvestlens.session import shared_folder, store
from harvestlens.streaming import status_feed

# The default configuration of a run set.
DIMENSIONS = {
    "crop_model": ["DSSAT", "APSIM"],
    "climate_source": ["gcm_nex_cmip6"],
    "climate_model": ["ACCESS-ESM1-5", "CNRM-ESM2-1", "EC-Earth3-Veg-LR", "MIROC6"],
    "scenario": ["ssp245", "ssp585"],
}
SOWING_DATES = ["06-15", "06-30", "07-15"]
ADAPTATIONS = [
    {
        "name": "baseline",
        "description": "as farmed today",
        "settings": {},
    },
    {
        "name": "early_sowing_jun01",
        "description": "sown on the first of June",
        "settings": {"sowing_dates": ["06-01"]},
    },
    {
        "name": "drip_irrigation_90eff",
        "description": "drip lines that lose a tenth of the water",
        "settings": {"baseline_irrigation_threshold_pct": 70, "baseline_irrigation_amount_mm": 15},
    },
    {
        "name": "drought_tolerant_cultivar",
        "description": "a cultivar bred for dry years",
        "settings": {
            "DSSAT": {"cultivar_id": "DROUGHTNK_DSSAT"},
            "APSIM": {"cultivar_id": "DROUGHTNK_APSIM"},
            "STICS": {"cultivar_id": "DROUGHTNK_STICS"},
        },
    },
    {
        "name": "residue_retention_50pct",
        "description": "half of the straw stays on the field",
        "settings": {"soil_carbon_parameters": {"residue_incorporation_pct": 50}},
    },
]


def _values(names) -> str:
    return "(values " + ", ".join(f"('{n}')" for n in names) + ")"


_DIM_SQL = ", ".join(f"{_values(v)} as d_{k}({k})" for k, v in DIMENSIONS.items())


@query(
    "simulation_matrix",
    f"""select s_suppkey::varchar as location_id, s_nationkey::varchar as soil_id, crop_model, climate_source,
 climate_model, scenario, adaptation, sowing_date, concat_ws('_', s_suppkey, crop_model, climate_source,
 climate_model, scenario, adaptation, replace(sowing_date, '-', '')) as simulation_id
 from supplier, {_DIM_SQL}, {_values(a['name'] for a in ADAPTATIONS)} as a(adaptation),
 (select unnest(['06-15', '06-30', '07-15', '06-01']) as sowing_date)
 where (adaptation = 'early_sowing_jun01') = (sowing_date = '06-01')""",
)
def simulation_matrix(spark, sf_dir):
    locations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("location_id"),
        F.col("s_nationkey").cast("string").alias("soil_id"),
    )
    return scenario.simulation_matrix(
        locations,
        {**DIMENSIONS, "adaptation": [a["name"] for a in ADAPTATIONS]},
        SOWING_DATES,
        {"early_sowing_jun01": ["06-01"]},
    )


@query(
    "location_attributes",
    f"""with {SIM}, loc as (select s_nationkey::varchar as location_id, min((s_suppkey * 37 % 1400) / 100.0::double)
 as lat, min((s_suppkey * 53 % 900) / 100.0::double) as lon from supplier group by all)
 select location_id, scenario, {r('lat', 'lat')}, {r('lon', 'lon')}, count(*) as n_runs
 from sim join loc using (location_id) group by location_id, scenario, lat, lon""",
)
def location_attributes(spark, sf_dir):
    locations = (
        points(spark, sf_dir)
        .join(table(spark, sf_dir, "supplier"), F.col("location_id") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("string").alias("location_id"))
        .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    )
    counted = sim_results(spark, sf_dir).groupBy("location_id", "scenario").agg(F.count(F.lit(1)).alias("n_runs"))
    return tidy(scenario.attach_attributes(counted, locations, ["lat", "lon"]).select("location_id", "scenario", "lat", "lon", "n_runs"))


@query(
    "chosen_runs",
    f"""with {SIM} select climate_model, scenario, adaptation, count(*) as n_runs from sim
 where climate_model in ('1-URGENT', '2-HIGH') and scenario in ('F') and adaptation <> 'baseline' group by all""",
)
def chosen_runs(spark, sf_dir):
    chosen = scenario.choose(
        sim_results(spark, sf_dir),
        {"climate_source": None, "climate_model": ["1-URGENT", "2-HIGH"], "scenario": ["F"]},
    )
    kept = scenario.without_baseline(chosen)
    return kept.groupBy("climate_model", "scenario", "adaptation").agg(F.count(F.lit(1)).alias("n_runs"))


_SPANS = {"a": ("1995-01-01", "1996-12-31"), "b": ("1996-07-01", "1999-03-31"), "c": ("2000-02-01", "2001-05-31")}
_SPANS_SQL = "(values " + ", ".join(
    f"('{n}', date '{s}', date '{e}')" for n, (s, e) in _SPANS.items()
) + ") as s(period, d0, d1)"


@query(
    "period_assignment",
    "select o_orderkey, period from orders join (values "
    + ", ".join(f"('{n}', date '{s}', date '{e}')" for n, (s, e) in PERIODS.items())
    + ") as s(period, d0, d1) on o_orderdate::date between d0 and d1",
)
def period_assignment(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return scenario.assign_periods(dated, "o_orderdate", PERIODS).select("o_orderkey", "period")


_OVERLAP_SQL = f"select o_orderkey, period from orders join {_SPANS_SQL} on o_orderdate::date between d0 and d1"


@query("period_assignment_overlapping", _OVERLAP_SQL)
def period_assignment_overlapping(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return scenario.assign_periods(dated, "o_orderdate", _SPANS).select("o_orderkey", "period")


@query("period_assignment_table", _OVERLAP_SQL)
def period_assignment_table(spark, sf_dir):
    """Periods from a stored table, whose size the planner knows."""
    rows = [(n, s, e) for n, (s, e) in _SPANS.items()]
    path = shared_folder(spark, "periods")
    spark.createDataFrame(rows, "period string, s string, e string").select(
        "period", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date")
    ).coalesce(1).write.parquet(path)
    spans = spark.read.schema("period string, start_date date, end_date date").parquet(path)
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return scenario.assign_periods(dated, "o_orderdate", spans).select("o_orderkey", "period")


# --- scalar helpers -------------------------------------------------------------


@query(
    "parse_dates",
    """with x as (select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d')
 when 1 then strftime(o_orderdate, '%Y%m%d') when 2 then strftime(o_orderdate, '%d-%m-%Y')
 when 3 then strftime(o_orderdate, '%d/%m/%Y') when 4 then strftime(o_orderdate, '%Y/%m/%d')
 else 'day ' || o_orderkey end as text from orders)
 select o_orderkey, text, try_strptime(text, ['%Y-%m-%d', '%Y%m%d', '%d-%m-%Y', '%d/%m/%Y', '%Y/%m/%d'])::date
 as date from x""",
)
def parse_dates(spark, sf_dir):
    kind, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = F.concat(F.lit("day "), F.col("o_orderkey").cast("string"))
    for i, layout in enumerate(["yyyy-MM-dd", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd"]):
        text = F.when(kind == i, F.date_format(day, layout)).otherwise(text)
    texts = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return texts.withColumn("date", fc.parse_date(F.col("text")))


@query(
    "ensure_numeric",
    """with x as (select o_orderkey, case when o_orderkey % 10 = 0 then 'n/a' else o_totalprice::varchar end as price,
 o_orderkey::varchar as code from orders)
 select o_orderkey, try_cast(price as double) as price, try_cast(code as double) as code from x""",
)
def ensure_numeric(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderkey").cast("string").alias("code"),
    )
    return fc.as_numeric(texts, ["price", "code", "absent"])


@query(
    "sowing_doy",
    f"""with {SIM} select sowing_date, dayofyear(try_strptime('1900-' || sowing_date, '%Y-%m-%d'))::int as sowing_doy,
 count(*) as n_runs from sim group by all""",
)
def sowing_doy(spark, sf_dir):
    counted = sim_results(spark, sf_dir).groupBy("sowing_date").agg(F.count(F.lit(1)).alias("n_runs"))
    return surrogate.with_sowing_day(counted)


@query(
    "water_productivity",
    f"""with {SIM} select location_id, scenario, {r('avg(yield_kg / nullif(etc_mm, 0))', 'productivity')},
 count(*) as n_runs from sim group by all""",
)
def water_productivity(spark, sf_dir):
    productivity = fc.water_productivity(F.col("yield_kg"), F.col("etc_mm"))
    return tidy(
        sim_results(spark, sf_dir)
        .groupBy("location_id", "scenario")
        .agg(F.avg(productivity).alias("productivity"), F.count(F.lit(1)).alias("n_runs"))
    )


# --- standard outputs ------------------------------------------------------------

_CROP = case_sql("l_returnflag", CROP_MODEL_OF_FLAG)
_RAW = f"""raw as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as simulation_id,
 {_CROP} as crop_model, l_quantity as q, round(l_extendedprice) as e, l_linenumber as n from lineitem)"""


def _raw_outputs(spark, sf_dir):
    """Wide raw outputs: each model fills its own columns, two names are not mapped."""
    crop = translate("l_returnflag", CROP_MODEL_OF_FLAG)
    q, e = F.col("l_quantity"), whole(F.col("l_extendedprice"))

    def only(model, value):
        return F.when(crop == model, value)

    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("simulation_id"),
        crop.alias("crop_model"),
        only("DSSAT", q).alias("GWAD"),
        only("DSSAT", e).alias("ETCP"),
        only("DSSAT", q + e).alias("HWAM"),
        only("APSIM", q * 2).alias("Yield"),
        only("APSIM", e * 2).alias("Maize.Evapotranspiration"),
        only("APSIM", q + e * 2).alias("Maize.AboveGround.Wt"),
        only("STICS", q * 3).alias("masec(n)"),
        only("STICS", e * 3).alias("cumulraint"),
        only("STICS", q + e * 3).alias("maerienne(n)"),
    )


_STANDARD = ["Yield_kg_ha", "ETc_mm", "Biomass_kg_ha", "Anthesis_DOY"]


@query(
    "standardize_wide",
    f"""with {_RAW} select simulation_id, crop_model, case when crop_model = 'STICS' then e * 3 end as cumulraint,
 q * (case crop_model when 'DSSAT' then 1 when 'APSIM' then 2 else 3 end) as "Yield_kg_ha",
 case crop_model when 'DSSAT' then e when 'APSIM' then e * 2 end as "ETc_mm",
 q + e * (case crop_model when 'DSSAT' then 1 when 'APSIM' then 2 else 3 end) as "Biomass_kg_ha",
 null::double as "Anthesis_DOY" from raw""",
)
def standardize_wide(spark, sf_dir):
    return results.standardize_wide(_raw_outputs(spark, sf_dir), variables=_STANDARD)


@query(
    "standardize_long",
    f"""with {_RAW}, x as (select simulation_id, crop_model, max(q) as q, max(e) as e from raw group by all)
 select simulation_id, crop_model,
 q * (case crop_model when 'DSSAT' then 1 when 'APSIM' then 2 else 3 end) as "Yield_kg_ha",
 case crop_model when 'DSSAT' then e when 'APSIM' then e * 2 end as "ETc_mm" from x union all
 select 'unmapped-' || s_suppkey, 'STICS', null, null from supplier""",
)
def standardize_long(spark, sf_dir):
    """Outputs of all runs, and runs whose only output has no standard name."""
    wide = _raw_outputs(spark, sf_dir)
    names = [c for c in wide.columns if c not in ("simulation_id", "crop_model")]
    rows = wide.unpivot(
        ["simulation_id", "crop_model"], [fc.col(c) for c in names], "model_var", "value"
    )
    unmapped = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("unmapped-"), F.col("s_suppkey").cast("string")).alias("simulation_id"),
        F.lit("STICS").alias("crop_model"),
        F.lit("cumulraint").alias("model_var"),
        F.col("s_acctbal").alias("value"),
    )
    known = rows.filter(F.col("value").isNotNull()).union(unmapped)
    return results.standardize_long(known, ["Yield_kg_ha", "ETc_mm"])


@query(
    "run_metadata",
    """select o_orderkey as simulation_id, o_orderpriority as climate_model, c_mktsegment as crop_model,
 o_totalprice as "Yield_kg_ha" from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'""",
)
def run_metadata(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tracked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("simulation_id"),
        F.col("o_orderpriority").alias("climate_model"),
        F.col("c_mktsegment").alias("crop_model"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("RUN_ERROR").alias("status"),
    )
    outputs = orders.select(
        F.col("o_orderkey").alias("simulation_id"), F.col("o_totalprice").alias("Yield_kg_ha")
    )
    return results.attach_run_metadata(outputs, tracked, ["climate_model", "crop_model"])


_SETTINGS_SQL = """case when adaptation = 'drip_irrigation_90eff' then '70' else '50' end as baseline_irrigation_threshold_pct,
 case when adaptation = 'drip_irrigation_90eff' then '15' else '25' end as baseline_irrigation_amount_mm,
 '120' as baseline_fertilizer_n,
 (case when adaptation = 'drought_tolerant_cultivar' then 'DROUGHTNK_' else 'LOCALNK_' end) || crop_model as cultivar_id"""
_SETTINGS = [
    "baseline_irrigation_threshold_pct",
    "baseline_irrigation_amount_mm",
    "baseline_fertilizer_n",
    "cultivar_id",
]


@query(
    "adaptation_settings",
    f"""with {SIM}, s as (select adaptation, crop_model, yield_kg, {_SETTINGS_SQL} from sim)
 select adaptation, crop_model, {', '.join(_SETTINGS)}, count(*) as n_runs, {r('avg(yield_kg)', 'yield_kg')}
 from s group by all""",
)
def adaptation_settings(spark, sf_dir):
    effective = ad.apply_settings(
        sim_results(spark, sf_dir),
        ADAPTATIONS,
        {
            "baseline_irrigation_threshold_pct": F.lit("50"),
            "baseline_irrigation_amount_mm": F.lit("25"),
            "baseline_fertilizer_n": F.lit("120"),
            "cultivar_id": F.concat(F.lit("LOCALNK_"), F.col("crop_model")),
        },
    )
    return tidy(
        effective.groupBy("adaptation", "crop_model", *_SETTINGS).agg(
            F.count(F.lit(1)).alias("n_runs"), F.avg("yield_kg").alias("yield_kg")
        )
    )


# --- run status ------------------------------------------------------------------

_FINAL = ", ".join(f"'{s}'" for s in st.FINAL)
_LATEST = f"""select simulation_id, status, message, ts, seq, start_time, n_events,
 case when status in ({_FINAL}) then ts end as end_time from (select *,
 min(ts) over (partition by simulation_id) as start_time, count(*) over (partition by simulation_id) as n_events,
 row_number() over (partition by simulation_id order by ts desc, seq desc) as k from feed) where k = 1"""


@query("status_latest", f"with {STATUS} {_LATEST}")
def status_latest(spark, sf_dir):
    return runs.latest_status(status_events(spark, sf_dir))


@query("status_stream", f"with {STATUS} {_LATEST}")
def status_stream(spark, sf_dir):
    """The same state from a stream over the event files."""
    folder = shared_folder(spark, "status-stream")
    feed = status_feed.read_feed(spark, f"{sf_dir}/events*.parquet", SCHEMAS["events"])
    stream = status_feed.track_status(as_status_events(feed), f"{folder}/table", f"{folder}/checkpoint")
    stream.awaitTermination()
    return status_feed.current_status(spark, f"{folder}/table")


_BATCHES = ["ts < timestamp '2024-01-10'", "ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'", "ts >= timestamp '2024-01-20'"]
_LATE = "event_id % 17 = 0"  # of the first ten days: these arrive with the last batch


@query(
    "status_batches",
    f"""with {STATUS}, w as (select max(ts) - interval 7 days as mark from events where {_BATCHES[1]}),
 intime as (select feed.* from feed, w where not (seq % 17 = 0 and {_BATCHES[0]} and ts < mark)),
 late as (select count(*) as n from events, w where {_LATE} and {_BATCHES[0]} and ts < mark)
 select s.*, n as late_events from ({_LATEST.replace("from feed)", "from intime)")}) s, late""",
)
def status_batches(spark, sf_dir):
    """Three batches in the order of time, some early events with the last one: beyond the bound they are counted only."""
    folder = shared_folder(spark, "status-batches")
    events = table(spark, sf_dir, "events")
    late = F.expr(f"{_LATE} and {_BATCHES[0]}")
    batches = [events.filter(F.expr(_BATCHES[0]) & ~late), events.filter(_BATCHES[1]), events.filter(F.expr(_BATCHES[2]) | late)]
    for batch, rows in enumerate(batches):
        status_feed.fold_batch(as_status_events(rows), batch, folder, "7 days")
    n_late = status_feed.pointer(spark, folder)["late"]
    return status_feed.current_status(spark, folder).withColumn("late_events", F.lit(n_late).cast("long"))


@query(
    "status_upsert",
    f"""with {STATUS}, cur as (select user_id::varchar as simulation_id, min(props) as message,
 'PENDING' as status, null::double as run_time from events group by all),
 upd as (select user_id::varchar as simulation_id, max(value) as run_time, min(props) as message,
 'SUCCESS' as status from events where event_type = 'purchase' and ts >= timestamp '2024-01-29' group by all)
 select simulation_id, case when upd.run_time < 100 then coalesce(upd.message, cur.message) else cur.message end
 as message, coalesce(upd.status, cur.status) as status, upd.run_time
 from cur left join upd using (simulation_id)""",
)
def status_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("simulation_id", F.col("user_id").cast("string"))
    current = (
        events.groupBy("simulation_id")
        .agg(F.min("props").alias("message"))
        .withColumns({"status": F.lit("PENDING"), "run_time": F.lit(None).cast("double")})
    )
    late = events.filter((F.col("event_type") == "purchase") & (F.col("ts") >= "2024-01-29"))
    updates = (
        late.groupBy("simulation_id")
        .agg(F.max("value").alias("run_time"), F.min("props").alias("message"))
        .withColumns(
            {"status": F.lit("SUCCESS"), "message": F.when(F.col("run_time") < 100, F.col("message"))}
        )
    )
    return runs.upsert_status(current, updates)


_DESCRIBED = "case status " + " ".join(
    f"when '{k}' then '{v}'" for k, v in st.STATUS_DESCRIPTIONS.items()
) + " end"


@query(
    "status_summary",
    f"""with {STATUS} select status, count(*) as n_runs, {_DESCRIBED} as description,
 {_DESCRIBED} is not null as known, status like '%ERROR%' or status like '%TIMEOUT%' as is_error,
 status in ({_FINAL}) as is_final, status in ('SUCCESS', 'OUTPUT_PARSED') as is_success,
 status = 'READY_TO_RUN' as is_runnable from feed group by status""",
)
def status_summary(spark, sf_dir):
    return runs.status_counts(status_events(spark, sf_dir))


@query(
    "status_totals",
    f"""with {STATUS}, now as ({_LATEST}) select count(*) as n_total,
 count(*) filter (status = 'READY_TO_RUN') as n_ready, count(*) filter (status = 'RUN_ERROR') as n_error,
 count(*) filter (status = 'SUCCESS') as n_success,
 count(*) filter (status in ({_FINAL}) and status <> 'SUCCESS') as n_failed from now""",
)
def status_totals(spark, sf_dir):
    return runs.status_totals(runs.latest_status(status_events(spark, sf_dir)))


@query(
    "undefined_codes",
    f"""with {STATUS} select status, count(*) as n_rows from feed
 where status not in ({', '.join(f"'{s}'" for s in st.STATUS_DESCRIPTIONS)}) group by all""",
)
def undefined_codes(spark, sf_dir):
    known = spark.createDataFrame([(s,) for s in st.STATUS_DESCRIPTIONS], "status string")
    return quality.undefined_values(status_events(spark, sf_dir), known, ["status"])


@query(
    "work_split",
    """select event_id as simulation_id, ntile(7) over (order by left(md5(event_id::varchar), 3),
 event_id::varchar)::int as task from events where event_type = 'view'""",
)
def work_split(spark, sf_dir):
    listed = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("simulation_id"),
        F.when(F.col("event_type") == "view", "READY_TO_RUN").otherwise("SUCCESS").alias("status"),
    )
    return runs.split_work(runs.runnable(listed), 7).select("simulation_id", "task")


def _toy_model(run: dict) -> str:
    if run["discount"] == 0:
        raise ValueError("no discount")
    if run["discount"] > 0.095:
        raise TimeoutError("too long")
    order = "none" if run["even_order"] is None else run["even_order"]
    return f"line {run['line']}, order {order}"


@query(
    "parallel_apply",
    """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as simulation_id,
 case when l_discount = 0 then 'RUN_ERROR' when l_discount > 0.095 then 'TIMEOUT' else 'SUCCESS' end as status,
 case when l_discount = 0 then 'no discount' when l_discount > 0.095 then 'too long'
 else 'line ' || l_linenumber || ', order ' || case when l_orderkey % 2 = 0 then l_orderkey::varchar else 'none' end
 end as message from lineitem""",
)
def parallel_apply(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("simulation_id"),
        F.col("l_discount").alias("discount"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey")).alias("even_order"),
    )
    return apply.run_in_parallel(listed, _toy_model).select("simulation_id", "status", "message")


@query(
    "resumed_runs",
    """with x as (select o_orderkey, o_orderkey::varchar as id, ('0x' || left(md5(o_orderkey::varchar), 8))::bigint % 4 as portion from orders)
 select id as simulation_id, case when o_orderkey % 10 = 0 then 'RUN_ERROR' else 'SUCCESS' end as status,
 portion::int as portion, 1 as n_runs, case when portion < 2 then 0 else 1 end as start from x""",
)
def resumed_runs(spark, sf_dir):
    """The first start ends after two portions of four, the second one runs what is left, the third finds nothing to do."""
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("simulation_id"))
    path = shared_folder(spark, "resumed-runs")

    def model(run: dict) -> None:
        if int(run["simulation_id"]) % 10 == 0:
            raise ValueError("no yield")

    for stop_after in (2, None, None):
        found = apply.run_resumable(listed, model, path, portions=4, stop_after=stop_after)
    return found.groupBy("simulation_id").agg(
        F.max("status").alias("status"),
        F.max("portion").alias("portion"),
        F.count(F.lit(1)).cast("int").alias("n_runs"),
        F.max("seq").cast("int").alias("start"),
    )


@query(
    "retried_runs",
    """select o_orderkey::varchar as simulation_id, case when o_orderkey % 5 < 3 then 'SUCCESS' else 'RUN_ERROR' end as status,
 case when o_orderkey % 5 < 3 then 'attempt ' || (1 + o_orderkey % 5) else 'attempt 3 failed' end as message from orders""",
)
def retried_runs(spark, sf_dir):
    """Three attempts a run; a run fails as often as its number modulo five says."""
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("simulation_id"))
    attempts: dict[str, int] = {}

    def model(run: dict) -> str:
        key = run["simulation_id"]
        attempts[key] = attempts.get(key, 0) + 1
        if attempts[key] <= int(key) % 5:
            raise RuntimeError(f"attempt {attempts[key]} failed")
        return f"attempt {attempts[key]}"

    return apply.run_in_parallel(listed, model, max_tries=3, initial_delay=0.0).select("simulation_id", "status", "message")


# --- surrogate data --------------------------------------------------------------

_HOT = {
    "climate_source": ["F", "O"],
    "scenario": ["F", "O", "P"],
    "adaptation": sorted(a["name"] for a in ADAPTATIONS),
}


@query(
    "one_hot",
    f"with {SIM} select period, "
    + ", ".join(
        f"(count(*) filter ({f} = '{v}'))::bigint as \"{f}_{v}\"" for f, vs in _HOT.items() for v in vs
    )
    + " from sim group by all",
)
def one_hot(spark, sf_dir):
    sim = sim_results(spark, sf_dir)
    encoded = surrogate.one_hot(sim, _HOT)
    names = [c for c in encoded.columns if any(c.startswith(f"{f}_") for f in _HOT)]
    return encoded.groupBy("period").agg(*[F.sum(fc.col(c)).alias(c) for c in names])


@query(
    "null_drop_report",
    f"""with {SIM}, x as (select *, dayofyear(try_strptime('1900-' || sowing_date, '%Y-%m-%d')) as sowing_doy,
 case when yield_kg > 2 then yield_kg end as target from sim)
 select count(*) as n_total, count(*) filter (sowing_doy is not null and target is not null) as n_complete,
 count(*) filter (sowing_doy is null or target is null) as n_dropped from x""",
)
def null_drop_report(spark, sf_dir):
    prepared = surrogate.with_sowing_day(sim_results(spark, sf_dir)).withColumn(
        "target", F.when(F.col("yield_kg") > 2, F.col("yield_kg"))
    )
    rows, counts = surrogate.drop_incomplete(prepared.select("simulation_id", "sowing_doy", "target"), ["sowing_doy", "target"])
    found = rows.agg(F.count(F.lit(1)).alias("n_complete"))
    return found.select(F.lit(counts["n_total"]).cast("long").alias("n_total"), "n_complete", F.lit(counts["n_dropped"]).cast("long").alias("n_dropped"))


@query(
    "hash_split",
    """select o_orderkey as simulation_id, ('0x' || left(md5('42:' || o_orderkey), 8))::bigint % 1000 < 200
 as is_test from orders""",
)
def hash_split(spark, sf_dir):
    return surrogate.hash_split(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("simulation_id"))
    )


def _metric_sql(target: str, true: str, predicted: str) -> str:
    return f"""select '{target}' as target, {r(f'sqrt(avg(({predicted} - {true}) ** 2))', 'RMSE')},
 {r(f'avg(abs({predicted} - {true}))', 'MAE')}, {r(f'1 - sum(({predicted} - {true}) ** 2) / (var_pop({true}) * count(*))', 'R2')},
 count(*) as "Count" from x where {true} is not null and {predicted} is not null"""


@query(
    "regression_metrics",
    f"""with {SIM}, x as (select *, case when yield_kg > 10 then fertilizer_n end as guess, yield_kg * 1100 as guess2
 from sim) {_metric_sql('yield_kg', 'yield_kg', 'guess')} union all {_metric_sql('etc_mm', 'etc_mm', 'guess2')}""",
)
def regression_metrics(spark, sf_dir):
    guessed = sim_results(spark, sf_dir).withColumns(
        {
            "guess": F.when(F.col("yield_kg") > 10, F.col("fertilizer_n")),
            "guess2": F.col("yield_kg") * 1100,
        }
    )
    return tidy(
        surrogate.regression_metrics(
            guessed, {"yield_kg": ("yield_kg", "guess"), "etc_mm": ("etc_mm", "guess2")}
        )
    )


# --- machine learning ----------------------------------------------------------------

_NUMERIC = ["sowing_doy", "yield_kg", "irrigation_mm", "fertilizer_n", "price"]
_CATEGORIES = ["climate_source", "climate_model", "scenario", "period", "soil_id", "adaptation"]
_TARGETS = ["revenue", "water"]
_TREES = {"n_estimators": 10, "max_depth": 8, "min_samples_leaf": 3, "max_features": 0.7}
_ML = f"""{SIM}, ml as (select *, yield_kg * price as revenue, irrigation_mm * 2 + fertilizer_n as water,
 dayofyear(try_strptime('1900-' || sowing_date, '%Y-%m-%d')) as sowing_doy from sim),
 split as (select *, ('0x' || left(md5('42:' || simulation_id), 8))::bigint % 1000 < 200 as is_test from ml
 where {' and '.join(f'{c} is not null' for c in [*_NUMERIC, *_CATEGORIES, *_TARGETS])})"""


def _surrogate_data(spark, sf_dir):
    """The encoded runs with their split, stored once a session."""
    return once(spark, sf_dir, "surrogate-data", lambda: store(_split_runs(spark, sf_dir), "surrogate-data"))


def _forest(spark, sf_dir):
    """(path of the one fitted forest, its predictions when it was fitted); all its queries load it from there."""
    def make():
        data, path = _surrogate_data(spark, sf_dir), shared_folder(spark, "surrogate")
        model = _fit(data)
        model.save(path)
        return path, store(model.predict(data.filter("is_test")), "predictions")

    return once(spark, sf_dir, "surrogate-forest", make)


def _loaded(spark, sf_dir):
    return surrogate.Surrogate.load(spark, _forest(spark, sf_dir)[0])


def _split_runs(spark, sf_dir):
    rows = surrogate.with_sowing_day(sim_results(spark, sf_dir)).withColumns(
        {
            "revenue": F.col("yield_kg") * F.col("price"),
            "water": F.col("irrigation_mm") * 2 + F.col("fertilizer_n"),
        }
    )
    whole_rows = surrogate.complete_rows(rows, [*_NUMERIC, *_CATEGORIES], _TARGETS, check=False)
    return surrogate.hash_split(whole_rows).select("simulation_id", *_NUMERIC, *_CATEGORIES, *_TARGETS, "is_test")


def _fit(data, model_type="RandomForest", hyperparameters=_TREES, categorical=_CATEGORIES, targets=_TARGETS):
    train = data.filter(~F.col("is_test"))
    return surrogate.fit_surrogate(train, _NUMERIC, categorical, targets, model_type, hyperparameters, stored=True)


@query(
    "surrogate_predict",
    f"with {_ML} select simulation_id, revenue, water, true as revenue_inside, true as water_inside from split where is_test",
)
def surrogate_predict(spark, sf_dir):
    """Test rows; a forest averages targets it was trained on, so it predicts inside their range."""
    data = _surrogate_data(spark, sf_dir)
    predicted = _loaded(spark, sf_dir).predict(data.filter("is_test"))
    ranges = data.filter("NOT is_test").agg(
        *[f(t).alias(f"{t}_{n}") for t in _TARGETS for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    inside = {
        f"{t}_inside": F.col(f"{t}_pred").between(ranges[f"{t}_lo"] - 1e-6, ranges[f"{t}_hi"] + 1e-6) for t in _TARGETS
    }
    return predicted.withColumns(inside).select("simulation_id", *_TARGETS, *inside)


_QUALITY_SQL = " union all ".join(
    f"select '{t}' as target, count({t}) as \"Count\", true as good from split where is_test" for t in _TARGETS
)


@query("surrogate_quality", f"with {_ML} {_QUALITY_SQL}")
def surrogate_quality(spark, sf_dir):
    """Test rows by target, and whether the fit explains more than half of the variance."""
    data = _surrogate_data(spark, sf_dir)
    predicted = _loaded(spark, sf_dir).predict(data.filter("is_test"))
    metrics = surrogate.regression_metrics(predicted, {t: (t, f"{t}_pred") for t in _TARGETS})
    return metrics.select("target", "Count", (F.col("R2") > 0.5).alias("good"))


@query("surrogate_boosted", f"with {_ML} select count(*) as n_test, true as good from split where is_test")
def surrogate_boosted(spark, sf_dir):
    """Boosted trees on one target; the mean R2 over targets."""
    data = _surrogate_data(spark, sf_dir)
    model = _fit(data, "GBT", {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3}, ["scenario"], ["revenue"])
    metrics = surrogate.regression_metrics(
        model.predict(data.filter("is_test")), {"revenue": ("revenue", "revenue_pred")}
    )
    metrics = store(metrics, "metrics")  # read twice below
    return metrics.agg(F.max("Count").alias("n_test")).join(surrogate.mean_r2(metrics)).select(
        "n_test", (F.col("mean_r2") > 0.5).alias("good")
    )


@query(
    "surrogate_stored",
    f"with {_ML} select simulation_id, true as revenue_same, true as water_same from split where is_test",
)
def surrogate_stored(spark, sf_dir):
    """A model saved, loaded and applied predicts as before."""
    path, before = _forest(spark, sf_dir)
    after = surrogate.Surrogate.load(spark, path).predict(before, "_again")
    return after.select(
        "simulation_id", *[(F.abs(F.col(f"{t}_pred") - F.col(f"{t}_again")) < 1e-9).alias(f"{t}_same") for t in _TARGETS]
    )


@query(
    "prediction_file",
    f"with {_ML} select simulation_id, true as revenue_inside, true as water_inside from split where is_test",
)
def prediction_file(spark, sf_dir):
    """Features from a file, predictions to a file, read back."""
    data = _surrogate_data(spark, sf_dir)
    features = shared_folder(spark, "features") + ".parquet"
    data.filter("is_test").select("simulation_id", *_NUMERIC, *_CATEGORIES).write.parquet(features)
    out = shared_folder(spark, "predictions") + ".parquet"
    workflows.predict_file(spark, features, _forest(spark, sf_dir)[0], out)
    bounds = [f(t).alias(f"{t}_{n}") for t in _TARGETS for n, f in (("lo", F.min), ("hi", F.max))]
    ranges = data.filter("NOT is_test").agg(*bounds).first()
    inside = {f"{t}_inside": F.col(t).between(ranges[f"{t}_lo"] - 1e-6, ranges[f"{t}_hi"] + 1e-6) for t in _TARGETS}
    return spark.read.parquet(out).withColumns(inside).select("simulation_id", *inside)


@query(
    "run_set_up",
    f"""with m as (select s_suppkey::varchar as location_id, crop_model, climate_source, climate_model, scenario, sowing_date
 from supplier, {_DIM_SQL}, (select unnest(['06-15', '06-30', '07-15']) as sowing_date))
 select location_id, climate_model, scenario, case when location_id::bigint % 3 = 0 and scenario = 'ssp585' then 'SETUP_ERROR' else 'READY_TO_RUN' end as status,
 case when location_id::bigint % 3 = 0 and scenario = 'ssp585' then 'No climate data for ' || concat_ws(', ', location_id, climate_source, climate_model, scenario) end as message,
 count(*) as n_runs from m group by all""",
)
def run_set_up(spark, sf_dir):
    """The set-up step: every third location has no climate for one scenario."""
    locations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("location_id"))
    matrix = scenario.simulation_matrix(locations, DIMENSIONS, SOWING_DATES)
    there = (F.col("location_id").cast("long") % 3 != 0) | (F.col("scenario") != "ssp585")
    series = matrix.filter(there).select(*workflows.CLIMATE_KEYS).distinct()
    made = workflows.set_up_runs(spark, locations, DIMENSIONS, SOWING_DATES, series, shared_folder(spark, "set-up"))
    return made.groupBy("location_id", "climate_model", "scenario", "status", "message").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "feature_importance",
    f"""with {_ML}, train as (select * from split where not is_test), f as (
 {' union all '.join(f"select '{c}' as feature" for c in _NUMERIC)} union all
 {' union all '.join(f"select distinct '_h_{c}_' || {c} from train" for c in _CATEGORIES)})
 select target, feature, true as in_order, true as sums_to_one, feature = 'yield_kg' as leads_revenue
 from f, (values ('revenue')) as t(target)""",
)
def feature_importance(spark, sf_dir):
    """All encoded features of revenue, as they are listed: descending, adding up to one, yield first."""
    found = _loaded(spark, sf_dir).importance(_surrogate_data(spark, sf_dir), "revenue")
    listed = found.withColumn("place", F.monotonically_increasing_id())
    line = Window.partitionBy().orderBy("place")
    return listed.select(
        F.lit("revenue").alias("target"),
        "feature",
        F.coalesce(F.lag("importance").over(line) >= F.col("importance"), F.lit(True)).alias("in_order"),
        (F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9).alias("sums_to_one"),
        (F.row_number().over(line) == 1).alias("leads_revenue"),
    )


@query(
    "top_features",
    f"with {_ML} select count(distinct 'x' || simulation_id) > 0 as fitted, 10 as n_features, true as yield_is_first, true as descending from split",
)
def top_features(spark, sf_dir):
    """The ten features with the greatest importance."""
    found = _loaded(spark, sf_dir).importance(_surrogate_data(spark, sf_dir), "revenue", top=10)
    weights = F.collect_list("importance")
    return found.agg(
        (F.count(F.lit(1)) > 0).alias("fitted"),
        F.count(F.lit(1)).cast("int").alias("n_features"),
        (F.max_by("feature", "importance") == "yield_kg").alias("yield_is_first"),
        (F.sort_array(weights, False) == weights).alias("descending"),
    )


@query(
    "feature_table",
    f"""with {SIM}, x as (select *, dayofyear(try_strptime('1900-' || sowing_date, '%Y-%m-%d')) as sowing_doy from sim)
 select simulation_id, sowing_doy, price, {', '.join(f"(coalesce(scenario = '{v}', false))::int as scenario_{v}" for v in ('F', 'O', 'P'))},
 yield_kg, 'elev' as absent from x""",
)
def feature_table(spark, sf_dir):
    """Encoded features and a target; what cannot be had is named."""
    frame, _, absent = surrogate.engineer_features(
        sim_results(spark, sf_dir), ["sowing_doy", "price", "scenario", "elev"], {"scenario": _HOT["scenario"]}, ["yield_kg"]
    )
    return frame.withColumn("absent", F.lit(",".join(absent)))


@query(
    "impact_clusters",
    f"""with {SIM}, base as (select location_id, avg(yield_kg) as b from sim where period = 'historical' group by all),
 fut as (select location_id, period, avg(yield_kg) as f from sim where period <> 'historical' group by all),
 loc as (select s_nationkey::varchar as location_id, min((s_suppkey * 37 % 1400) / 100.0::double) as lat,
 min((s_suppkey * 53 % 900) / 100.0::double) as lon from supplier group by all)
 select location_id, period, {r('lat', 'lat')}, {r('lon', 'lon')}, {r('f - b', 'yield_kg_abs_change')}, true as known_cluster
 from fut join base using (location_id) join loc using (location_id)""",
)
def impact_clusters(spark, sf_dir):
    """Every location and future period in one of four clusters."""
    changes = store(impacts.climate_impacts(sim_results(spark, sf_dir), ["location_id"], VALUES), "changes")
    locations = (
        points(spark, sf_dir)
        .join(table(spark, sf_dir, "supplier"), F.col("location_id") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("string").alias("location_id"))
        .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    )
    placed = scenario.attach_attributes(changes, locations, ["lat", "lon"])
    clustered = surrogate.impact_clusters(placed, "yield_kg_abs_change", name="cluster")
    return tidy(
        clustered.select(
            "location_id", "period", "lat", "lon", "yield_kg_abs_change", F.col("cluster").between(0, 3).alias("known_cluster")
        )
    )
