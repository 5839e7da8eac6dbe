from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from harvestlens import schemas
from harvestlens.operators import quality
from harvestlens.session import shared_folder
from harvestlens.sources import publication, tables
from tests.compare import explained


def test_locations(spark, tmp_path):
    (tmp_path / "l.csv").write_text("lon,location_id,lat,elev\n76.5,loc1,13.0,900\n77.0,002,14.0,\n")
    rows = tables.read_locations(spark, str(tmp_path / "l.csv")).orderBy("lat").collect()
    assert [r.asDict() for r in rows] == [
        {"location_id": "loc1", "lat": 13.0, "lon": 76.5, "elev": 900.0},
        {"location_id": "002", "lat": 14.0, "lon": 77.0, "elev": None},
    ]
    (tmp_path / "bad.csv").write_text("location_id,lat\nx,1\n")
    with pytest.raises(ValueError, match="lon"):
        tables.read_locations(spark, str(tmp_path / "bad.csv"))


def test_region_map(spark, tmp_path):
    (tmp_path / "r.csv").write_text("location_id,region_id,name\nl1,A,x\n")
    assert [tuple(r) for r in tables.read_region_map(spark, str(tmp_path / "r.csv")).collect()] == [("l1", "A")]


def test_climate_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [("s", m, sc, v, lat, 76.0, date(2020, 1, d), float(d)) for m in ("m1", "m2") for sc in ("a", "b") for v in ("pr", "tasmax") for lat in (12.0, 13.0) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, schemas.CLIMATE_CELL)
    tables.write_climate_cells(df, path)
    read = tables.read_climate(spark, path, ["pr", "hurs"], "s", "m1", "a", (12.5, 14.0), (75.0, 77.0), ("2020-01-02", "2020-01-03"))
    assert sorted((r["lat"], str(r["date"]), r["pr"], r["hurs"]) for r in read.collect()) == [(13.0, "2020-01-02", 2.0, None), (13.0, "2020-01-03", 3.0, None)]
    plan = explained(read)
    partition_filters = plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert all(name in partition_filters for name in ("climate_model", "scenario", "variable"))
    assert "GreaterThanOrEqual(lat" in plan and "GreaterThanOrEqual(date" in plan
    assert "ReadSchema: struct<lat:double,lon:double,date:date,value:double>" in plan


def test_point_series(spark, tmp_path):
    path = str(tmp_path / "points")
    df = spark.createDataFrame(
        [("l1", date(2020, 1, 1), 1.0, "s1", "m", "a"), ("l1", date(2020, 1, 1), 2.0, "s2", "m", "a")],
        "location_id string, date date, pr double, climate_source string, climate_model string, scenario string",
    )
    tables.write_point_series(df, path)
    assert tables.read_point_series(spark, path).count() == 2
    assert tables.read_point_series(spark, path, "l1", "s2", "m", "a").first()["pr"] == 2.0
    assert tables.read_point_series(spark, path, "nowhere").count() == 0


@pytest.mark.parametrize("codec", ["gzip", "snappy", None])
def test_results(spark, tmp_path, codec):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([("l", "DSSAT", "s", "m", "sc", "06-15", 1.0)], ", ".join(f"{c} string" for c in schemas.RESULT_REQUIRED) + ", Yield_kg_ha double")
    tables.write_results(df, path, codec)
    assert tables.read_results(spark, path).collect() == df.collect()
    with pytest.raises(ValueError):
        tables.write_results(df, path, "rar")
    tables.write_results(df.limit(0), path)
    with pytest.raises(ValueError, match="empty"):
        tables.read_results(spark, path)
    tables.write_results(df.drop("scenario"), path)
    with pytest.raises(ValueError, match="scenario"):
        tables.read_results(spark, path)


def test_period_tables(spark, tmp_path):
    path = str(tmp_path / "analysis")
    df = spark.createDataFrame([("near", 1.0), ("far", 2.0), (None, 3.0)], "period string, y double")
    tables.write_period_tables({"impacts": df, "ensemble": df.limit(0)}, path)
    read = tables.read_period_tables(spark, path, ["impacts", "ensemble", "regions"])
    assert sorted(tuple(r) for r in read["impacts"].select("period", "y").collect()) == [("far", 2.0), ("near", 1.0)]
    assert "regions" not in read


def test_status_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("simulation_id,status,message,setup_time,run_time\na,SUCCESS,,0.5,\n")
    assert tuple(tables.read_run_status(spark, str(tmp_path / "s.csv")).first()) == ("a", "SUCCESS", None, 0.5, None)
    events = spark.createDataFrame([("a", None, 1, "RUNNING", "")], schemas.STATUS_EVENT)
    for _ in range(2):
        tables.append_status_events(events, str(tmp_path / "events"))
    assert tables.read_status_events(spark, str(tmp_path / "events")).count() == 2


def test_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "simulation_id string, y double")
    for suffix, kind in ((".csv", "csv"), (".parquet", "parquet"), (".xlsx", "csv")):
        path = str(tmp_path / f"out{suffix}")
        assert tables.write_by_suffix(df, path) == kind
        if suffix != ".xlsx":
            assert tables.read_by_suffix(spark, path, df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        tables.read_by_suffix(spark, "x.xlsx")


def test_soil_file(spark, tmp_path):
    (tmp_path / "soil.json").write_text('{"soil_id": "SOIL1", "depth": [0, 10], "sand": [60, 55], "clay": [20, 25]}\n{"soil_id": "SOIL2", "depth": [0], "sand": [70], "clay": [10]}\n')
    assert tables.read_soil_layers(spark, str(tmp_path / "soil.json")).count() == 3
    assert tuple(tables.read_soil_layers(spark, str(tmp_path / "soil.json"), "SOIL2").first()) == ("SOIL2", 1, 0.0, 70.0, 10.0)


def session_with(folder, master):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_follows_the_setting():
    cluster = session_with("hdfs://name/marks/", "yarn")
    assert shared_folder(cluster, "x").startswith("hdfs://name/marks/x-")
    assert shared_folder(cluster, "x") != shared_folder(cluster, "x")
    assert "/x-" in shared_folder(session_with(None, "local[2]"), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with(None, "yarn"), "x")


def test_unreadable_locations(spark, tmp_path):
    (tmp_path / "l.csv").write_text("location_id,lat,lon\na,1.5,2\nb,north,2\nc,,3\n")
    bad = tables.unreadable_locations(spark, f"{tmp_path}/l.csv").collect()
    assert [(r["location_id"], r["lat"]) for r in bad] == [("b", "north"), ("c", None)]
    assert tables.read_locations(spark, f"{tmp_path}/l.csv").filter("lat is null").count() == 2


def test_one_period_is_published_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0)], "k int, period string, v double")
    publication.publish_periods(df, path)
    publication.publish_periods(spark.createDataFrame([(9, "b", 9.0)], df.schema), path)
    assert sorted(tuple(r) for r in publication.read_published(spark, path).collect()) == [(1, "a", 1.0), (2, "a", 2.0), (9, "b", 9.0)]
    publication.remove(spark, f"{path}/{publication.MARKER}")
    with pytest.raises(ValueError, match="not a complete table"):
        publication.read_published(spark, path)
    with pytest.raises(ValueError):
        publication.read_published(spark, str(tmp_path / "none"))


def test_gate_counts_while_it_writes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 5.0), ("c", 99.0)], "k string, v double")
    found = quality.gate(df, ["k"], ["v"], {"v": {"max": 50.0}})
    assert (found.n_rows, found.n_null) == (4, 1)
    assert [r["k"] for r in found.accepted.collect()] == ["b"] and found.rejected.count() == 3
