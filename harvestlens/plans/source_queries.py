"""Readers, writers and pipeline steps: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens import schemas
from harvestlens.operators import impacts
from harvestlens.operators.grid import extract_points
from harvestlens.plans import workflows
from harvestlens.plans.climate_queries import _cell_sql
from harvestlens.plans.impact_queries import (
    _AD_VARS,
    _BASE_FIGURES,
    _ENS,
    _ENS_KEYS,
    _IMPACTS,
    _ensemble_sql,
    _region_map,
)
from harvestlens.plans.registry import ORACLES, query
from harvestlens.plans.testbed import (
    CELLS,
    KEYS,
    POINTS,
    SIM,
    STATUS,
    WEATHER,
    climate_cells,
    once,
    points,
    r,
    sim_results,
    status_events,
    table,
    tidy,
)
from harvestlens.session import shared_folder, store
from harvestlens.sources import publication, tables


def _grid_cells(spark, sf_dir):
    """Cells with the folder columns: two scenarios by the parity of the day."""
    return climate_cells(spark, sf_dir).select(
        F.lit("obs").alias("climate_source"),
        F.lit("gcm").alias("climate_model"),
        F.when(F.dayofmonth("date") % 2 == 0, "even").otherwise("odd").alias("scenario"),
        "variable",
        "lat",
        "lon",
        "date",
        "value",
    )


@query(
    "read_locations_csv",
    f"select s_suppkey::varchar as location_id, {r('(s_suppkey * 37 % 1400) / 100.0::double', 'lat')}, "
    f"{r('(s_suppkey * 53 % 900) / 100.0::double', 'lon')} from supplier",
)
def read_locations_csv(spark, sf_dir):
    path = shared_folder(spark, "locations")
    points(spark, sf_dir).select("lon", "lat", "location_id").write.csv(path, header=True)
    return tidy(tables.read_locations(spark, path))


@query(
    "unreadable_locations_csv",
    f"""with {POINTS} select location_id::varchar as location_id, case when location_id % 7 = 0 then 'n/a' else null end as lat,
 case when location_id % 7 = 0 then '5' end as lon from points where location_id % 7 = 0 or location_id % 11 = 0""",
)
def unreadable_locations_csv(spark, sf_dir):
    """Bad coordinates are reported instead of dropped in silence."""
    path = shared_folder(spark, "locations")
    k = F.col("location_id")
    texts = points(spark, sf_dir).select(
        k.cast("string").alias("location_id"),
        F.when(k % 7 == 0, "n/a").when(k % 11 != 0, F.col("lat").cast("string")).alias("lat"),
        F.when(k % 7 == 0, "5").when(k % 11 != 0, F.col("lon").cast("string")).alias("lon"),
    )
    texts.write.csv(path, header=True)
    return tables.unreadable_locations(spark, path)


@query(
    "read_region_map_csv",
    "select n_nationkey::varchar as location_id, n_regionkey::varchar as region_id from nation",
)
def read_region_map_csv(spark, sf_dir):
    path = shared_folder(spark, "regions")
    _region_map(spark, sf_dir).write.csv(path, header=True)
    return tables.read_region_map(spark, path)


@query(
    "read_climate_folders",
    f"""with {CELLS} select 'obs' as climate_source, 'gcm' as climate_model, 'even' as scenario, lat, lon, date,
 {', '.join(r(f"avg(value) filter (variable = '{v}')", v) for v in ('tasmax', 'pr'))} from cells
 where day(date) % 2 = 0 and variable in ('tasmax', 'pr') and lat between 2 and 11 and date <= '2024-01-21'
 group by all""",
)
def read_climate_folders(spark, sf_dir):
    path = shared_folder(spark, "cells")
    tables.write_climate_cells(_grid_cells(spark, sf_dir), path)
    return tidy(
        tables.read_climate(
            spark,
            path,
            ["tasmax", "pr"],
            climate_model=["gcm", "other"],
            scenario="even",
            lat_range=(2.0, 11.0),
            lon_range=(-1e9, 1e9),
            date_range=("2024-01-01", "2024-01-21"),
        )
    )


@query("point_series_folders", _cell_sql("abs(a - X), a desc", "abs(a - X), a desc"))
def point_series_folders(spark, sf_dir):
    """Gridded cells to point series in folders, read back by source and model."""
    out = shared_folder(spark, "series")
    tables.write_climate_cells(_grid_cells(spark, sf_dir), f"{out}/cells")
    cells = tables.read_climate(spark, f"{out}/cells", WEATHER)
    series = extract_points(points(spark, sf_dir), cells, WEATHER, [*tables.CLIMATE_FOLDERS, "date"])
    tables.write_point_series(series, f"{out}/points")
    stored = tables.read_point_series(spark, f"{out}/points", climate_source="obs", climate_model="gcm")
    return tidy(stored.drop(*tables.CLIMATE_FOLDERS))


_STEP_CHECKS = " union all ".join(
    f"select location_id, scenario, '{check}' as \"check\", '{v}' as variable, "
    f"count(*) filter ({condition}) as n_bad from near group by all having n_bad > 0"
    for v in WEATHER
    for check, condition in [("null", f"{v} is null")] + ([("above_max", "pr > 15000")] if v == "pr" else [])
)


@query(
    "climate_step_report",
    f"""with near as (select *, case when day(date) % 2 = 0 then 'even' else 'odd' end as scenario from
 ({_cell_sql("abs(a - X), a desc", "abs(a - X), a desc")})) {_STEP_CHECKS}""",
)
def climate_step_report(spark, sf_dir):
    """The findings of the climate step, from stored cells."""
    out = shared_folder(spark, "climate-step")
    tables.write_climate_cells(_grid_cells(spark, sf_dir), f"{out}/cells")
    made = workflows.prepare_climate(
        spark, f"{out}/cells", points(spark, sf_dir), out, WEATHER, limits={"pr": {"max": 15000.0}}
    )
    return made["report"].drop("climate_source", "climate_model")


@query(
    "results_file",
    f"""with {SIM} select location_id, crop_model, scenario, count(*) as n_runs, {r('avg(yield_kg)', 'yield_kg')}
 from sim group by all""",
)
def results_file(spark, sf_dir):
    path = shared_folder(spark, "results")
    tables.write_results(sim_results(spark, sf_dir), path, "gzip")
    stored = tables.read_results(spark, path)
    return tidy(
        stored.groupBy("location_id", "crop_model", "scenario").agg(
            F.count(F.lit(1)).alias("n_runs"), F.avg("yield_kg").alias("yield_kg")
        )
    )


@query(
    "status_event_table",
    f"with {STATUS} select simulation_id, seq, status, message from feed",
)
def status_event_table(spark, sf_dir):
    path = shared_folder(spark, "events")
    events = status_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.col("ts") < "2024-01-15"
    tables.append_status_events(events.filter(early).select(*schemas.STATUS_EVENT.names), path)
    tables.append_status_events(events.filter(~early).select(*schemas.STATUS_EVENT.names), path)
    return tables.read_status_events(spark, path).drop("ts")


@query(
    "feature_file_csv",
    "select s_suppkey::varchar as simulation_id, round(s_acctbal, 2) as balance from supplier",
)
def feature_file_csv(spark, sf_dir):
    path = shared_folder(spark, "features") + ".csv"
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("simulation_id"), F.col("s_acctbal").alias("balance")
    )
    tables.write_by_suffix(rows, path)
    return tidy(tables.read_by_suffix(spark, path, rows.schema), 2)


# --- the analysis steps as a whole ---------------------------------------------


def _analysis(spark, sf_dir):
    """The step is run once a session; its queries read what it wrote."""
    return once(
        spark,
        sf_dir,
        "impact-step",
        lambda: workflows.analyze_impacts(
            spark,
            sim_results(spark, sf_dir).drop("region_id"),
            ["yield_kg", "etc_mm"],
            shared_folder(spark, "analysis"),
            region_map=_region_map(spark, sf_dir),
        ),
    )


@query(
    "impact_step_baseline",
    f"with {SIM} select {', '.join(KEYS)}, 'historical' as period, "
    f"{', '.join(f for f in _BASE_FIGURES if 'irrigation' not in f)} from sim where period = 'historical' group by all",
)
def impact_step_baseline(spark, sf_dir):
    return tidy(_analysis(spark, sf_dir)["baseline"])


@query(
    "impact_step_ensemble",
    f"with {_IMPACTS} {_ensemble_sql('impacts', _ENS_KEYS, _ENS, 'climate_model')}",
)
def impact_step_ensemble(spark, sf_dir):
    made = _analysis(spark, sf_dir)["ensemble"]
    figures = [c for c in made.columns if c == "n_models" or c.startswith(tuple(f"{v}_" for v in _ENS))]
    return tidy(made.select(*_ENS_KEYS.split(", "), *figures))


@query(
    "impact_step_regions",
    f"""with {_IMPACTS}, e as (select {_ENS_KEYS}, {', '.join(f'avg({v}) as {v}_mean' for v in _ENS)}
 from impacts group by all) select n_regionkey::varchar as region_id, scenario, period,
 {', '.join(r(f'avg({v}_mean)', f'{v}_mean') for v in _ENS)}
 from e join nation on location_id = n_nationkey::varchar group by all""",
)
def impact_step_regions(spark, sf_dir):
    made = _analysis(spark, sf_dir)["regions"]
    return tidy(made.select("region_id", "scenario", "period", *[f"{v}_mean" for v in _ENS]))


@query(
    "rerun_period",
    f"""with {SIM}, m as (select location_id, period, avg(yield_kg) as y from sim group by all)
 select location_id, period, {r("y + case when period = 'far_future' then 100 else 0 end", 'yield_kg')} from m""",
)
def rerun_period(spark, sf_dir):
    """All periods are published, then one of them again with other values: the others stay."""
    path = shared_folder(spark, "published")
    means = sim_results(spark, sf_dir).groupBy("location_id", "period").agg(F.avg("yield_kg").alias("yield_kg"))
    publication.publish_periods(means, path)
    first = publication.read_published(spark, path)
    again = first.filter("period = 'far_future'").withColumn("yield_kg", F.col("yield_kg") + 100)
    publication.publish_periods(store(again, "rerun"), path)
    return tidy(publication.read_published(spark, path))


@query("run_status_csv", "select s_suppkey::varchar as simulation_id, case when s_suppkey % 3 = 0 then 'SUCCESS' else 'READY_TO_RUN' end as status, "
       "case when s_suppkey % 3 = 0 then 'done, \"well\"' end as message, s_suppkey / 2.0 as setup_time, null::double as run_time from supplier")
def run_status_csv(spark, sf_dir):
    path = shared_folder(spark, "run-status")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.cast("string").alias("simulation_id"),
        F.when(k % 3 == 0, "SUCCESS").otherwise("READY_TO_RUN").alias("status"),
        F.when(k % 3 == 0, F.lit('done, "well"')).alias("message"),
        (k / 2.0).alias("setup_time"),
        F.lit(None).cast("double").alias("run_time"),
    )
    rows.write.csv(path, header=True, escape='"')
    return tables.read_run_status(spark, path)


@query("feature_file_parquet", "select s_suppkey::varchar as simulation_id, s_acctbal as balance from supplier")
def feature_file_parquet(spark, sf_dir):
    path = shared_folder(spark, "features") + ".parquet"
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("simulation_id"), F.col("s_acctbal").alias("balance")
    )
    tables.write_by_suffix(rows, path)
    return tables.read_by_suffix(spark, path)


def _adaptation_step(spark, sf_dir):
    """The step is run once a session; its queries read what it wrote."""
    return once(
        spark,
        sf_dir,
        "adaptation-step",
        lambda: workflows.analyze_adaptations(
            spark, sim_results(spark, sf_dir).drop("region_id"), _AD_VARS, shared_folder(spark, "adaptations"), region_map=_region_map(spark, sf_dir)
        ),
    )


@query("adaptation_step_ranking", ORACLES["adaptation_ranking_table"])
def adaptation_step_ranking(spark, sf_dir):
    return tidy(_adaptation_step(spark, sf_dir)["ranking"], 3)


@query("adaptation_step_ensemble", ORACLES["adaptation_ensemble"])
def adaptation_step_ensemble(spark, sf_dir):
    return tidy(_adaptation_step(spark, sf_dir)["ensemble"])


@query("adaptation_step_regions", ORACLES["adaptation_regions"])
def adaptation_step_regions(spark, sf_dir):
    return tidy(_adaptation_step(spark, sf_dir)["regions"])


@query("soil_layers_json", ORACLES["soil_layers"])
def soil_layers_json(spark, sf_dir):
    """Profiles from JSON, half of them as parallel arrays, half as lists of layers."""
    path = shared_folder(spark, "soil")
    s, even = F.col("p_size"), F.col("p_partkey") % 2 == 0
    depth = [F.lit(0.0), s.cast("double"), 2.0 * s]
    sand = [60.0 + s % 7, 55.0 + s % 7, 50.0 + s % 7]
    clay = [F.lit(20.0), F.lit(25.0), F.when(s % 2 == 0, 30.0)]
    layers = [F.struct(d.alias("depth"), a.alias("sand"), c.alias("clay")) for d, a, c in zip(depth, sand, clay)]
    profiles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("soil_id"),
        *[F.when(even, F.array(*x)).alias(n) for n, x in (("depth", depth), ("sand", sand), ("clay", clay))],
        F.when(~even, F.array(*layers)).alias("layers"),
    )
    profiles.write.json(path)
    return tables.read_soil_layers(spark, path)
