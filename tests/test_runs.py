from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import apply, results, runs, scenario
from harvestlens.streaming import status_feed

EVENTS = "simulation_id string, ts timestamp, seq long, status string, message string"


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_matrix_size_and_keys(spark):
    locations = spark.createDataFrame([("l1", "s1"), ("l2", "s2")], "location_id string, soil_id string")
    dims = {
        "crop_model": ["DSSAT", "APSIM"], "climate_source": ["a", "b"], "climate_model": ["m"], "scenario": ["s1", "s2"],
        "adaptation": ["baseline", "early"],
    }
    matrix = scenario.simulation_matrix(locations, dims, ["06-15", "06-30", "07-15"], {"early": ["06-01"]})
    assert matrix.count() == 2 * 2 * 2 * 1 * 2 * (3 + 1)
    assert matrix.select("simulation_id").distinct().count() == matrix.count()
    assert matrix.filter("simulation_id = 'l1_DSSAT_a_m_s1_early_0601'").count() == 1
    plain = scenario.simulation_matrix(locations, {"crop_model": ["DSSAT"]}, ["06-15"])
    assert {r["simulation_id"] for r in plain.collect()} == {"l1_DSSAT_0615", "l2_DSSAT_0615"}


def test_matrix_needs_no_join_or_shuffle(spark):
    locations = spark.createDataFrame([("l1",)], "location_id string")
    plan = scenario.simulation_matrix(locations, {"crop_model": ["A", "B"]}, ["06-15"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_periods(spark):
    periods = {
        "historical": ("1995-01-01", "2014-12-31"), "near_future": ("2024-01-01", "2050-12-31"),
        "mid_future": ("2051-01-01", "2075-12-31"), "far_future": ("2076-01-01", "2100-12-31"),
    }
    days = ["1994-12-31", "1995-01-01", "2014-12-31", "2015-01-01", "2023-12-31", "2024-01-01", "2050-12-31", "2051-01-01", "2100-12-31", "2101-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("date"))
    want = [("1995-01-01", "historical"), ("2014-12-31", "historical"), ("2024-01-01", "near_future"), ("2050-12-31", "near_future"),
            ("2051-01-01", "mid_future"), ("2100-12-31", "far_future")]
    got = scenario.assign_periods(df, "date", periods)
    assert sorted((str(r["date"]), r["period"]) for r in got.collect()) == want
    table = spark.createDataFrame([(n, date.fromisoformat(s), date.fromisoformat(e)) for n, (s, e) in periods.items()], "period string, start_date date, end_date date")
    got = scenario.assign_periods(df, "date", table)
    assert sorted((str(r["date"]), r["period"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        scenario.period_of(F.col("date"), {"a": ("2000-01-01", "2001-01-01"), "b": ("2000-06-01", "2002-01-01")})


def test_standard_names_from_dotted_columns(spark):
    raw = spark.createDataFrame(
        [("1", "DSSAT", 5000.0, None, None), ("2", "APSIM", None, 12000.0, None), ("3", "STICS", None, None, 4000.0), ("4", "OTHER", 1.0, 2.0, 3.0)],
        "simulation_id string, crop_model string, a double, b double, c double",
    ).toDF("simulation_id", "crop_model", "GWAD", "Maize.AboveGround.Wt", "masec(n)")
    out = results.standardize_wide(raw, variables=["Yield_kg_ha", "Biomass_kg_ha"]).orderBy("simulation_id")
    assert [tuple(r) for r in out.collect()] == [
        ("1", "DSSAT", 5000.0, None), ("2", "APSIM", None, 12000.0), ("3", "STICS", 4000.0, None), ("4", "OTHER", None, None)
    ]
    kept = results.standardize_wide(raw, keep_raw=True)
    assert set(raw.columns) <= set(kept.columns) and len(kept.columns) == 5 + 8


def test_mapping_gaps():
    produced = ["masec(n)", "maerienne(n)", "cumulirrig", "cumulraint", "cumulep", "iflos", "idrp", "QNplante"]
    gaps = results.unmapped_variables(produced, models=["STICS"])
    assert [std for _, std in gaps] == ["ETc_mm", "Anthesis_DOY", "Maturity_DOY", "SoilEvap_mm", "NUptake_kg_ha"]


def test_model_weather(spark):
    df = spark.createDataFrame([("l", 1.0, 2.0, 3.0, 4.0)], "location_id string, tasmax double, tasmin double, pr double, rsds double")
    assert results.model_weather(df, "APSIM", ["location_id"]).columns == ["location_id", "maxt", "mint", "rain", "radn"]
    with pytest.raises(ValueError, match="rsds"):
        results.model_weather(df.drop("rsds"), "DSSAT", ["location_id"])


def test_latest_status(spark):
    rows = [("r1", at(1), 1, "PENDING", None), ("r1", at(3), 3, "SUCCESS", "ok"), ("r1", at(2), 2, "RUNNING", None),
            ("r2", at(1), 1, "RUNNING", None), ("r2", at(1), 2, "READY_TO_RUN", "same time")]
    got = {r["simulation_id"]: r for r in runs.latest_status(spark.createDataFrame(rows, EVENTS)).collect()}
    assert (got["r1"]["status"], got["r1"]["start_time"], got["r1"]["end_time"]) == ("SUCCESS", at(1), at(3))
    assert (got["r2"]["status"], got["r2"]["message"], got["r2"]["end_time"]) == ("READY_TO_RUN", "same time", None)


def test_upsert_and_counts(spark):
    schema = "simulation_id string, status string, message string, run_time double"
    current = spark.createDataFrame([("a", "PENDING", "m", None), ("b", "READY_TO_RUN", "m", 1.0), ("c", "FAILED", None, None)], schema)
    updates = spark.createDataFrame([("a", "SUCCESS", None, 2.0), ("z", "SUCCESS", None, 3.0)], schema)
    after = runs.upsert_status(current, updates)
    assert sorted(tuple(r) for r in after.collect()) == [("a", "SUCCESS", "m", 2.0), ("b", "READY_TO_RUN", "m", 1.0), ("c", "FAILED", None, None)]
    assert tuple(runs.status_totals(after).first()) == (3, 1, 0, 1, 0)
    assert [r["simulation_id"] for r in runs.runnable(after).collect()] == ["b"]
    assert [r["simulation_id"] for r in runs.completed(after).collect()] == ["a"]


@pytest.mark.parametrize("n,tasks", [(10, 3), (3, 5), (100, 7), (1, 1)])
def test_split_sizes(spark, n, tasks):
    df = spark.range(n).select(F.col("id").cast("string").alias("simulation_id"))
    split = runs.split_work(df, tasks).toPandas()
    sizes = split.task.value_counts().sort_index().reindex(range(1, tasks + 1), fill_value=0)
    assert list(sizes) == [len(p) for p in np.array_split(np.arange(n), tasks)]
    again = runs.split_work(df.repartition(5), tasks).toPandas()
    pd.testing.assert_frame_equal(split.sort_values("simulation_id", ignore_index=True), again.sort_values("simulation_id", ignore_index=True))


def test_task_runs_cover_all(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("simulation_id"), F.when(F.col("id") % 2 == 0, "READY_TO_RUN").otherwise("SUCCESS").alias("status"))
    ids = [r["simulation_id"] for t in (1, 2, 3) for r in runs.task_runs(df, t, 3).collect()]
    assert sorted(ids, key=int) == [str(i) for i in range(0, 20, 2)]


def test_parallel_runs_capture_errors(spark):
    def model(run):
        if run["x"] == 1:
            raise RuntimeError("broken")
        if run["x"] == 2:
            raise TimeoutError("slow")
        return None if run["x"] == 3 else f"x={run['x']}"

    df = spark.range(1, 6).select(F.col("id").cast("string").alias("simulation_id"), F.col("id").alias("x"))
    rows = {r[0]: r for r in apply.run_in_parallel(df, model, tasks=3).collect()}
    assert [(rows[str(i)]["status"], rows[str(i)]["message"]) for i in range(1, 6)] == [
        ("RUN_ERROR", "broken"), ("TIMEOUT", "slow"), ("SUCCESS", ""), ("SUCCESS", "x=4"), ("SUCCESS", "x=5")
    ]
    assert all(r["run_time"] >= 0 for r in rows.values())


def test_runs_arrive_with_their_types(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, [2, 3])], "simulation_id string, x int, y array<int>")
    out = apply.run_in_parallel(df, lambda run: f"{run['x']!r} {run['y']!r}")
    assert {r["simulation_id"]: r["message"] for r in out.collect()} == {"a": "1 None", "b": "None [2, 3]"}


def test_long_outputs_keep_runs_without_a_mapped_output(spark):
    rows = [("1", "DSSAT", "GWAD", "5"), ("1", "DSSAT", "ETCP", None), ("2", "DSSAT", "other", "7"), ("3", None, "GWAD", "1")]
    df = spark.createDataFrame(rows, "simulation_id string, crop_model string, model_var string, value string")
    out = results.standardize_long(df, ["Yield_kg_ha", "ETc_mm"])
    assert {r["simulation_id"]: (r["Yield_kg_ha"], r["ETc_mm"]) for r in out.collect()} == {
        "1": (5.0, None), "2": (None, None), "3": (None, None)
    }


def test_retry_waits_and_gives_up(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(apply.time, "sleep", waits.append)

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "yes"

    assert apply.with_retry(flaky)() == "yes" and waits == [1.0, 2.0]

    def broken():
        raise KeyError("always")

    with pytest.raises(KeyError):
        apply.with_retry(broken, max_tries=2)()
    with pytest.raises(KeyError):
        apply.with_retry(broken, exceptions=(ValueError,))()
    assert waits == [1.0, 2.0, 1.0]


def test_stream_equals_batch_with_late_events(spark, tmp_path):
    feed, table, marks = (str(tmp_path / n) for n in ("feed", "table", "marks"))
    batches = [
        [("r1", at(1), 1, "PENDING", "a"), ("r2", at(5), 5, "SUCCESS", "b")],
        [("r1", at(9), 9, "SUCCESS", "c"), ("r3", at(2), 2, "RUNNING", "d")],
        [("r1", at(4), 4, "RUNNING", "late"), ("r2", at(1), 1, "PENDING", "late")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(feed)
        stream = status_feed.track_status(status_feed.read_feed(spark, feed, EVENTS, 1), table, marks)
        stream.awaitTermination()
    got = status_feed.current_status(spark, table)
    want = runs.latest_status(spark.read.schema(EVENTS).parquet(feed))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r["simulation_id"]: r["status"] for r in got.collect()} == {"r1": "SUCCESS", "r2": "SUCCESS", "r3": "RUNNING"}


def test_late_events_expiry_and_folders(spark, tmp_path):
    """Events beyond the bound are counted only, final runs leave the open states, folders don't grow with batches."""
    table = str(tmp_path / "table")
    history = []
    for batch in range(12):
        day = 10 * batch
        rows = [(f"r{batch}", at(day), 1, "RUNNING", "a"), (f"r{batch}", at(day + 1), 2, "SUCCESS", "b"), ("open", at(day), batch, "RUNNING", "o")]
        history += rows
        late = [("r0", at(0), 99, "FAILED", "too late")] if batch == 5 else []
        events = spark.createDataFrame(rows + late, EVENTS)
        status_feed.fold_batch(events, batch, table, "30 minutes")
        status_feed.fold_batch(events, batch, table, "30 minutes")  # repeated after a failure: nothing changes
    now = status_feed.pointer(spark, table)
    assert now["late"] == 1 and now["batch"] == 11
    open_rows = spark.read.parquet(f"{table}/{now['open']}")
    assert {r["simulation_id"] for r in open_rows.collect()} == {"open", "r8", "r9", "r10", "r11"}
    assert len(now["segments"]) <= 2 * status_feed.SEGMENTS
    assert len(list((tmp_path / "table").iterdir())) < 30
    got = status_feed.current_status(spark, table)
    want = runs.latest_status(spark.createDataFrame(history, EVENTS))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_start_runs_only_what_is_left(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(40).select(F.col("id").cast("string").alias("simulation_id"))
    marks = tmp_path / "calls"
    marks.mkdir()

    def model(run):
        with open(marks / run["simulation_id"], "a") as f:
            f.write("x")
        return "done"

    first = apply.run_resumable(df, model, path, portions=5, stop_after=2)
    n = first.count()
    assert 0 < n < 40 and set(r["portion"] for r in first.collect()) == {0, 1}
    # a portion that broke off: its folder has no mark of success and doesn't count
    broken = tmp_path / "runs" / "start=1-portion=4"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert apply.run_resumable(df, model, path, portions=5).count() == 40
    assert apply.run_resumable(df, model, path, portions=5).count() == 40
    assert {p.read_text() for p in marks.iterdir()} == {"x"} and len(list(marks.iterdir())) == 40
