"""The whole pipeline on a small made-up grid."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens import schemas
from harvestlens.functions.columns import kelvin_to_celsius
from harvestlens.operators import apply, results
from harvestlens.operators.runs import runnable
from harvestlens.plans import workflows as wf
from harvestlens.sources import tables

MODELS, SCENARIOS = ["m1", "m2"], ["ssp245", "ssp585"]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    rng = np.random.default_rng(42)
    rows = [
        ("src", m, s, v, lat, lon, date(2020, 1, d), 300.0 + float(rng.normal()) if v == "tasmax" else float(d))
        for m in MODELS for s in SCENARIOS for v in ("tasmax", "pr")
        for lat in (12.0, 13.0) for lon in (75.0, 76.0) for d in range(1, 11)
    ]
    rows.append(("src", "m2", "ssp585", "tasmax", 13.0, 76.0, date(2020, 1, 11), 999.0))
    tables.write_climate_cells(spark.createDataFrame(rows, schemas.CLIMATE_CELL), f"{out}/cells")
    locations = spark.createDataFrame(
        [("l1", 12.1, 75.2, "s1"), ("l2", 12.9, 75.9, "s2"), ("l3", 12.0, 76.0, "s1")],
        "location_id string, lat double, lon double, soil_id string",
    )
    climate = wf.prepare_climate(
        spark, f"{out}/cells", locations, out, ["tasmax", "pr"], names={"tasmax": "tmax"},
        conversions={"tmax": kelvin_to_celsius}, limits={"tmax": {"max": 60.0}},
    )
    dims = {"crop_model": ["DSSAT"], "climate_source": ["src"], "climate_model": MODELS, "scenario": SCENARIOS, "adaptation": ["baseline", "early"]}
    runs = wf.set_up_runs(spark, locations, dims, ["06-15", "07-15"], climate["points"], out, {"early": ["06-01"]})
    wf.record_status(runs, f"{out}/status", 1)

    def model(run):
        if run["sowing_date"] == "07-15" and run["location_id"] == "l3":
            raise ValueError("no convergence")

    outcome = apply.run_in_parallel(runnable(runs), model, tasks=4)
    wf.record_status(outcome, f"{out}/status", 2)
    outputs = runs.select(
        "simulation_id", (F.length("simulation_id") * 100.0).alias("GWAD"), F.lit(7.0).alias("IRCM")
    )
    table = wf.collect_results(spark, outputs, runs, f"{out}/status", locations, out)
    return out, climate, runs, table


def test_bad_climate_is_reported_and_left_out(done):
    _, climate, _, _ = done
    report = climate["report"].collect()
    # l2 takes its climate from the cell with the unreal value, whose last day has no rain
    assert {(r["location_id"], r["climate_model"], r["scenario"], r["check"], r["variable"]) for r in report} == {
        ("l2", "m2", "ssp585", "above_max", "tmax"), ("l2", "m2", "ssp585", "null", "pr"),
    }
    groups = climate["points"].select(*wf.CLIMATE_KEYS).distinct().count()
    assert groups == 3 * 2 * 2 - 1
    assert climate["points"].agg(F.max("tmax")).first()[0] < 40


def test_run_status(spark, done):
    out, _, runs, _ = done
    assert runs.count() == 3 * 2 * 2 * 3
    assert {r["message"] for r in runs.filter("status = 'SETUP_ERROR'").collect()} == {"No climate data for l2, src, m2, ssp585"}
    counts = {r["status"]: r["count"] for r in wf.status_overview(spark, f"{out}/status").groupBy("status").count().collect()}
    assert counts == {"SETUP_ERROR": 3, "RUN_ERROR": 4, "SUCCESS": 29}


def test_result_table(done):
    _, _, _, table = done
    assert table.count() == 29
    assert set(results.standard_names(results.VARIABLE_NAMES)) <= set(table.columns)
    assert table.filter("Yield_kg_ha is null or Irrigation_mm <> 7 or lat is null or soil_id is null").count() == 0


def test_analysis(spark, done):
    out, _, _, table = done
    data = table.withColumn("period", F.explode(F.array(F.lit("historical"), F.lit("near"), F.lit("far")))).withColumn(
        "Yield_kg_ha", F.col("Yield_kg_ha") * F.when(F.col("period") == "near", 0.9).when(F.col("period") == "far", 0.8).otherwise(1.0)
        * F.when(F.col("adaptation") == "early", F.when(F.col("period") != "historical", 1.1).otherwise(1.0)).otherwise(1.0)
    )
    region_map = spark.createDataFrame([("l1", "A"), ("l2", "A"), ("l3", "B")], "location_id string, region_id string")
    plain = data.filter("adaptation = 'baseline'")
    made = wf.analyze_impacts(spark, plain, ["Yield_kg_ha"], f"{out}/analysis", region_map=region_map)
    assert set(made) == {"baseline", "impacts", "ensemble", "regions"}
    change = {r["period"]: r["c"] for r in made["regions"].groupBy("period").agg(F.avg("Yield_kg_ha_rel_change_mean").alias("c")).collect()}
    assert change == pytest.approx({"near": -10.0, "far": -20.0}, abs=0.5)
    adapted = wf.analyze_adaptations(spark, data, ["Yield_kg_ha"], f"{out}/adapt", region_map=region_map)
    assert [r["adaptation"] for r in adapted["ranking"].collect()] == ["early"]
    assert adapted["effectiveness"].filter("relative_effectiveness <= 0").count() == 0


def test_surrogate_files(spark, done, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", float(x), ["a", "b"][i % 2], "06-15", float(3 * x + i % 2)) for i, x in enumerate(rng.uniform(0, 10, 400))]
    data = spark.createDataFrame(rows, "simulation_id string, x double, scenario string, sowing_date string, y double")
    model, metrics = wf.train_surrogate(data, ["x", "sowing_doy"], ["scenario"], ["y"], str(tmp_path / "m"), hyperparameters={"n_estimators": 10, "max_depth": 8, "max_features": 0.7})
    assert metrics.first()["R2"] > 0.9
    tables.write_by_suffix(data.drop("y"), str(tmp_path / "in.parquet"))
    assert wf.predict_file(spark, str(tmp_path / "in.parquet"), str(tmp_path / "m"), str(tmp_path / "out.parquet")) == "parquet"
    out = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert out.columns == ["simulation_id", "y"] and out.count() == 400
