from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens import session
from harvestlens.operators import grid, quality, season, soil, spatial

SOURCE = ("src", "gcm", "ssp245")


@pytest.fixture(scope="module")
def cells(spark):
    """A leap year on a 3 x 3 grid in long form. The grid lines and the distributions."""
    rng = np.random.default_rng(42)
    rows = []
    for d in range(366):
        day = date(2020, 1, 1) + timedelta(days=d)
        for lat in (12.0, 13.0, 14.0):
            for lon in (75.0, 76.0, 77.0):
                high = rng.normal(30, 5)
                for v, x in (("tasmax", high), ("tasmin", high - abs(rng.normal(10, 5))), ("pr", rng.exponential(5))):
                    rows.append((*SOURCE, v, lat, lon, day, float(x)))
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["climate_source", "climate_model", "scenario", "variable", "lat", "lon", "date", "value"])
    )


@pytest.fixture(scope="module")
def wide(cells):
    return grid.pivot_variables(cells, ["lat", "lon", "date"], ["tasmax", "tasmin", "pr"]).cache()


def points(spark, rows):
    return spark.createDataFrame(rows, "location_id string, lat double, lon double")


def test_pivot_is_an_outer_merge(spark):
    df = spark.createDataFrame([(1.0, "tasmax", 5.0), (2.0, "pr", 1.0), (3.0, "hurs", 1.0)], "lat double, variable string, value double")
    out = grid.pivot_variables(df, ["lat"], ["tasmax", "pr"])
    assert sorted(tuple(r) for r in out.collect()) == [(1.0, 5.0, None), (2.0, None, 1.0)]


def test_window_is_inclusive(cells):
    out = grid.climate_window(cells, (12.0, 13.0), (76.0, 77.0), ("2020-02-01", "2020-02-02"), ["pr"])
    assert out.count() == 2 * 2 * 2


def test_nearest_ties_take_the_larger_coordinate(spark, wide):
    out = grid.locate_cells(points(spark, [("a", 12.5, 75.5), ("b", 12.4, 76.6), ("c", 0.0, 99.0), ("d", 13.0, 76.0)]), grid.grid_axes(wide))
    rows = {r["location_id"]: (r["cell_lat"], r["cell_lon"]) for r in out.collect()}
    assert rows == {"a": (13.0, 76.0), "b": (12.0, 77.0), "c": (12.0, 77.0), "d": (13.0, 76.0)}


def test_directional(spark, wide):
    where = points(spark, [("a", 12.5, 75.5), ("b", 11.0, 76.0), ("c", 14.5, 76.0), ("d", 13.0, 76.0)])
    axes = grid.grid_axes(wide)
    before = {r[0]: (r["cell_lat"], r["cell_lon"]) for r in grid.locate_cells(where, axes, "previous").collect()}
    after = {r[0]: (r["cell_lat"], r["cell_lon"]) for r in grid.locate_cells(where, axes, "next").collect()}
    assert before == {"a": (12.0, 75.0), "c": (14.0, 76.0), "d": (13.0, 76.0)}
    assert after == {"a": (13.0, 76.0), "b": (12.0, 76.0), "d": (13.0, 76.0)}


def test_unknown_method(spark, wide):
    with pytest.raises(ValueError):
        grid.extract_points(points(spark, [("a", 12.5, 75.5)]), wide, ["pr"], method="cubic")


def test_extracted_series(spark, wide):
    out = grid.extract_points(points(spark, [("l1", 13.0, 76.0), ("l2", 14.0, 77.0)]), wide, ["tasmax", "pr"])
    assert out.groupBy("location_id").count().collect() and out.count() == 2 * 366
    assert out.columns == ["location_id", "date", "tasmax", "pr"]


def test_bilinear_renormalizes_over_missing_corners(spark):
    plane = [(y, x, date(2020, 1, 1), 10 * y + x) for y in (13.0, 14.0) for x in (76.0, 77.0)]
    df = spark.createDataFrame(plane, "lat double, lon double, date date, v double")
    where = points(spark, [("mid", 13.5, 76.5), ("off", 13.25, 76.75), ("hit", 13.0, 77.0), ("edge", 13.0, 76.5), ("out", 12.9, 76.5)])
    rows = {r[0]: r["v"] for r in grid.extract_points(where, df, ["v"], method="linear").collect()}
    assert rows == pytest.approx({"mid": 211.5, "off": 209.25, "hit": 207.0, "edge": 206.5})
    holed = df.withColumn("v", F.when(~((F.col("lat") == 13) & (F.col("lon") == 76)), F.col("v")))
    rows = {r[0]: r["v"] for r in grid.extract_points(where, holed, ["v"], method="linear").collect()}
    assert rows["mid"] == pytest.approx((207 + 216 + 217) / 3)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    axis = np.unique(np.round(rng.uniform(-20, 20, 60), 2))
    xs = np.r_[np.round(rng.uniform(-22, 22, 300), 2), axis[:5], axis[-1], np.full(400, 3.21), np.full(400, axis[7])]
    axis_df = spark.createDataFrame(pd.DataFrame({"lat": np.repeat(axis, 3)}))
    where = spark.createDataFrame(pd.DataFrame({"id": range(len(xs)), "x": xs}))
    out = grid.axis_neighbours(where, "x", axis_df, "lat")
    assert out.columns == ["id", "x", "lat_below", "lat_above"]
    out = out.toPandas().set_index("id").sort_index()
    below = [axis[axis <= x].max() if (axis <= x).any() else np.nan for x in xs]
    above = [axis[axis >= x].min() if (axis >= x).any() else np.nan for x in xs]
    np.testing.assert_array_equal(out["lat_below"].astype(float), below)
    np.testing.assert_array_equal(out["lat_above"].astype(float), above)


def test_an_axis_of_two_million_stations(spark):
    """All in a corner of the extent: no task holds more than its piece."""
    n = 2_000_000
    axis = spark.range(n).select((F.col("id") * 1e-6 + 40).alias("lat"))
    where = spark.range(2000).select("id", (F.col("id") * 0.05).alias("x"))
    rows = grid.axis_neighbours(where, "x", axis, "lat")
    assert "collect_set" not in rows._jdf.queryExecution().toString()
    stations = np.arange(n) * 1e-6 + 40
    for r in rows.collect():
        left, right = (int(np.searchsorted(stations, r["x"], side)) for side in ("left", "right"))
        assert r["lat_below"] == (stations[right - 1] if right else None)
        assert r["lat_above"] == (stations[left] if left < n else None)


def test_no_axis(spark):
    where = spark.createDataFrame([(1, 4.0), (2, None)], "id int, x double")
    none = grid.axis_neighbours(where, "x", spark.createDataFrame([], "lat double"), "lat").collect()
    assert [tuple(r) for r in none] == [(1, 4.0, None, None)]


def test_single_axis_value(spark):
    where = spark.createDataFrame([(1, 4.0), (2, 5.0), (3, 6.0)], "id int, x double")
    axis = spark.createDataFrame([(5.0,)], "lat double")
    rows = {r["id"]: (r["lat_below"], r["lat_above"]) for r in grid.axis_neighbours(where, "x", axis, "lat").collect()}
    assert rows == {1: (None, 5.0), 2: (5.0, 5.0), 3: (5.0, None)}


def inside(px, py, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("tile,most", [(0.5, 256), (3.0, 256), (3.0, 4), (100.0, 4)])
def test_polygons_against_brute_force(spark, tile, most):
    rng = np.random.default_rng(7)
    rings = {}
    for i in range(12):
        cx, cy, n = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.integers(3, 9)
        angles = np.sort(rng.uniform(0, 2 * np.pi, n))
        radii = rng.uniform(0.3, 4, n)
        rings[f"p{i:02d}"] = [(cx + r * np.cos(a), cy + r * np.sin(a)) for a, r in zip(angles, radii)]
    edges = [(k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1])]
    xy = rng.uniform(-8, 8, (400, 2))
    where = spark.createDataFrame(pd.DataFrame({"location_id": range(400), "lat": xy[:, 1], "lon": xy[:, 0]}))
    edge_df = spark.createDataFrame(edges, "polygon_id string, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in spatial.points_in_polygons(where, edge_df, tile=tile, most=most).collect()}
    want = {(i, k) for i, (x, y) in enumerate(xy) for k, ring in rings.items() if inside(x, y, ring)}
    assert got == want and want
    first = {r["location_id"]: r["polygon_id"] for r in spatial.polygon_of_point(where, edge_df, tile=tile, most=most).collect()}
    assert len(first) == 400
    assert all(first[i] == min((k for j, k in want if j == i), default=None) for i in range(400))


def test_a_polygon_of_many_edges_in_one_tile(spark):
    """A star of 100 000 edges and all points in one tile: leaves hold few edges each."""
    n = 100_000
    angle = 2 * np.pi * np.arange(n) / n
    radius = 0.3 + 0.1 * np.cos(500 * angle)
    x, y = 0.5 + radius * np.cos(angle), 0.5 + radius * np.sin(angle)
    frame = pd.DataFrame({"polygon_id": "star", "x1": x, "y1": y, "x2": np.roll(x, -1), "y2": np.roll(y, -1)})
    index = spatial.polygon_index(spark.createDataFrame(frame))
    assert index.agg(F.max(F.size("_edges"))).first()[0] <= 256
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 1, (5000, 2))
    where = spark.createDataFrame(pd.DataFrame({"location_id": range(5000), "lat": xy[:, 1], "lon": xy[:, 0]}))
    got = {r["location_id"] for r in spatial.points_in_polygons(where, None, index=index).collect()}
    far = np.hypot(xy[:, 0] - 0.5, xy[:, 1] - 0.5)
    bound = 0.3 + 0.1 * np.cos(500 * np.arctan2(xy[:, 1] - 0.5, xy[:, 0] - 0.5))
    sure = np.abs(far - bound) > 0.002
    assert all((i in got) == (far[i] < bound[i]) for i in np.flatnonzero(sure))


def test_covering_polygons_and_no_polygons(spark):
    square = lambda k, a, b: [(k, a, a, b, a), (k, b, a, b, b), (k, b, b, a, b), (k, a, b, a, a)]
    rows = square("big", -10.3, 10.7) + square("small", 0.2, 0.4) + [("bad", None, 1.0, 2.0, 3.0)]
    schema = "polygon_id string, x1 double, y1 double, x2 double, y2 double"
    where = points(spark, [("in both", 0.3, 0.3), ("big only", 5.5, -7.7), ("out", 11.0, 0.0), ("nowhere", None, 1.0)])
    found = {tuple(r) for r in spatial.points_in_polygons(where, spark.createDataFrame(rows, schema)).collect()}
    assert found == {("in both", "big"), ("in both", "small"), ("big only", "big")}
    none = spatial.polygon_of_point(where, spark.createDataFrame([], schema)).collect()
    assert {r["polygon_id"] for r in none} == {None} and len(none) == 4


# --- seasons -----------------------------------------------------------------


def small_daily(spark):
    rows = [("loc1", date(2020, 1, 1), 25.0, 15.0, 0.0), ("loc1", date(2020, 1, 2), 27.0, 17.0, 2.0), ("loc2", date(2020, 1, 1), 26.0, 16.0, 1.0)]
    return spark.createDataFrame(rows, "location_id string, date date, tasmax double, tasmin double, pr double")


def test_growing_season_golden(spark):
    runs = spark.createDataFrame(
        [("a", "loc1", date(2020, 1, 1), date(2020, 1, 2)), ("b", "loc1", date(2019, 12, 30), date(2020, 1, 1)),
         ("c", "loc2", date(2021, 1, 1), date(2021, 3, 2)), ("d", "loc1", date(2020, 1, 2), date(2020, 1, 1)),
         ("e", "loc1", date(2020, 1, 1), date(2020, 1, 2))],
        "simulation_id string, location_id string, season_start date, season_end date",
    )
    rows = {r["simulation_id"]: r for r in season.growing_season_climate(runs, small_daily(spark), ["location_id"]).collect()}
    figures = ["GrowingDays", "TotalPrecip_mm", "AvgTmax_C", "AvgTmin_C", "TotalRad_MJ"]
    assert [rows["a"][f] for f in figures] == [2, 2.0, 26.0, 16.0, None]
    assert [rows["e"][f] for f in figures] == [2, 2.0, 26.0, 16.0, None]
    assert [rows["b"][f] for f in figures] == [1, 0.0, 25.0, 15.0, None]
    assert [rows["c"][f] for f in figures] == [0, 0.0, None, None, None]
    assert [rows["d"][f] for f in figures] == [0, 0.0, None, None, None]


def test_season_over_a_year_end(spark):
    days = [("l", date(2019, 1, 1) + timedelta(days=i), 1.0) for i in range(900)]
    daily = spark.createDataFrame(days, "location_id string, date date, pr double")
    runs = spark.createDataFrame([("a", "l", date(2019, 11, 20), date(2021, 2, 3))], "simulation_id string, location_id string, season_start date, season_end date")
    row = season.growing_season_climate(runs, daily, ["location_id"]).first()
    assert row["GrowingDays"] == (date(2021, 2, 3) - date(2019, 11, 20)).days + 1 == row["TotalPrecip_mm"]


def test_seasons_against_brute_force(spark):
    """Gaps of months and days, several rows a day, missing values, a season on every day."""
    rng = np.random.default_rng(9)
    days = [date(2019, 1, 1) + timedelta(days=int(i)) for i in rng.choice(900, 500, replace=False) if not 200 < i < 320]
    rows = [("hot" if rng.random() < 0.7 else "cold", d, float(rng.integers(0, 50)), None if rng.random() < 0.1 else float(rng.integers(0, 30))) for d in days for _ in range(2)]
    daily = spark.createDataFrame(rows, "k string, date date, pr double, tasmax double")
    seasons = [(k, date(2018, 12, 1) + timedelta(days=i), date(2018, 12, 1) + timedelta(days=i + int(rng.integers(-3, 400)))) for k in ("hot", "cold", "none") for i in range(0, 1000, 9)]
    runs = spark.createDataFrame(seasons, "k string, season_start date, season_end date")
    got = {(r["k"], r["season_start"], r["season_end"]): r for r in season.growing_season_climate(runs, daily, ["k"]).collect()}
    assert set(got) == set(seasons)
    for key, r in got.items():
        mine = [x for x in rows if x[0] == key[0] and key[1] <= x[1] <= key[2]]
        warm = [x[3] for x in mine if x[3] is not None]
        want = (len(mine), sum(x[2] for x in mine), sum(warm) / len(warm) if warm else None)
        assert (r["GrowingDays"], r["TotalPrecip_mm"], r["AvgTmax_C"]) == pytest.approx(want, nan_ok=True)
        assert r["AvgTmin_C"] is None and r["TotalRad_MJ"] is None


def test_climate_statistics(spark, wide):
    monthly = season.climate_statistics(wide, [], ["tasmax", "tasmin", "pr"], "M")
    assert monthly.count() == 12 and monthly.columns == ["period_start", "tasmax_mean", "tasmin_mean", "pr_sum"]
    assert season.climate_statistics(wide, [], ["pr"], "year").count() == 1
    with pytest.raises(ValueError):
        season.climate_statistics(wide, [], ["tasmax"], "invalid")


def test_extremes_and_spells(spark):
    dry = [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, None, 0.0, 9.0]
    rows = [("a", date(2020, 2, 25) + timedelta(days=i), 36.0 if i % 2 else 20.0, p) for i, p in enumerate(dry)]
    rows += [("b", date(2020, 1, 1), 1.0, 9.0), ("c", date(2020, 1, 1), 1.0, 0.0), ("c", date(2020, 1, 3), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, date date, tasmax double, pr double")
    got = {r["k"]: r[1:] for r in season.extreme_indices(df, ["k"]).collect()}
    assert got["a"] == (9, 4, 6)
    spells = dict(season.longest_spell(df, ["k"], F.col("pr") < 1, "dry").collect())
    assert spells == {"a": 3, "b": 0, "c": 1}
    doubled = df.unionAll(df)
    assert dict(season.longest_spell(doubled, ["k"], F.col("pr") < 1, "dry").collect()) == spells


@pytest.mark.parametrize("window", [1, 2, 5, 8])
@pytest.mark.parametrize("block", [10, 1000])
def test_centered_mean_against_pandas(spark, window, block):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 97 + ["b"] * 6, "year": [*range(1991, 2088), *range(1, 7)], "y": rng.normal(size=103)})
    pdf.loc[40, "y"] = np.nan
    want = pdf.assign(smoothed=pdf.groupby("g").y.transform(lambda s: s.rolling(window, center=True).mean()))
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=0))
    out = season.centered_mean(df, ["g"], "year", "y", window, block=block).toPandas()
    out = out.sort_values(["g", "year"], ignore_index=True)
    np.testing.assert_allclose(out.smoothed.astype(float), want.smoothed, rtol=1e-9)


def test_centered_mean_ungrouped(spark):
    df = spark.range(1991, 2051).select(F.col("id").alias("year"), F.col("id").cast("double").alias("y"))
    out = season.centered_mean(df, [], "year", "y", 3)
    assert out.filter("smoothed = y").count() == 58 and out.count() == 60


# --- quality, soil -------------------------------------------------------------


def test_quality_report_and_gate(spark):
    df = spark.createDataFrame(
        [("a", 20.0, 1.0), ("a", 100.0, None), ("b", -50.0, 0.0), ("b", 60.0, 0.0), ("c", float("nan"), 0.0)], "k string, tasmax double, pr double"
    )
    limits = {"tasmax": {"min": -50, "max": 60}}
    report = quality.quality_report(df, ["k"], ["tasmax", "pr"], limits)
    assert sorted(tuple(r) for r in report.collect()) == [("a", "above_max", "tasmax", 1), ("a", "null", "pr", 1), ("c", "null", "tasmax", 1)]
    assert {r["k"] for r in quality.valid_rows(df, report, ["k"]).collect()} == {"b"}
    assert quality.rejected_rows(df, report, ["k"]).count() == 3
    absent = quality.quality_report(df, ["k"], ["hurs"]).collect()
    assert {r["check"] for r in absent} == {"missing_variable"} and len(absent) == 3


def test_missing_inputs(spark):
    want = spark.createDataFrame([("a", "m1"), ("a", "m2")], "location_id string, climate_model string")
    rows = quality.missing_inputs(want, want.filter("climate_model = 'm1'"), ["location_id", "climate_model"]).collect()
    assert [tuple(r) for r in rows] == [("a", "m2", "SETUP_ERROR", "No climate data for a, m2")]


def test_configuration_checks():
    good = {"historical": ["1995-01-01", "2014-12-31"], "near": ["2024-01-01", "2050-12-31"]}
    assert quality.check_periods(good) == []
    bad = {"reversed": ["2050-01-01", "2024-01-01"], "short": ["2024-01-01"], "text": ["2024-01-01", "soon"]}
    assert len(quality.check_periods(bad)) == 3
    assert quality.check_names(["DSSAT", "X"], ["DSSAT"], "crop model") == ["unknown crop model: X"]


def test_empty_input(spark):
    with pytest.raises(ValueError):
        quality.require_rows(spark.range(0), "results")
    assert quality.require_rows(spark.range(1)).count() == 1


def test_soil_layers(spark):
    rows = [("SOIL1", [0.0, 10.0, 30.0], [60.0, 55.0, 50.0], [20.0, 25.0, 30.0]), ("SOIL2", [0.0, 15.0, 40.0], [70.0, 65.0], None)]
    df = spark.createDataFrame(rows, "soil_id string, depth array<double>, sand array<double>, clay array<double>")
    out = sorted(tuple(r) for r in soil.soil_layers(df.limit(1)).collect())
    assert out == [("SOIL1", 1, 0.0, 60.0, 20.0), ("SOIL1", 2, 10.0, 55.0, 25.0), ("SOIL1", 3, 30.0, 50.0, 30.0)]
    structs = spark.createDataFrame([("S", [(1.0, 2.0, 3.0)])], "soil_id string, layers array<struct<depth:double,sand:double,clay:double>>")
    assert tuple(soil.soil_layers(structs, layers_col="layers").first()) == ("S", 1, 1.0, 2.0, 3.0)


def test_large_axes_get_more_pieces(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100, raising=False)
    axis = spark.range(4000).select((F.col("id") * 2.0).alias("lat"))
    where = spark.range(1000).select("id", (F.col("id") * 8.0 + 1).alias("x"))
    out = grid.axis_neighbours(where, "x", axis, "lat")
    assert out.rdd.getNumPartitions() == 50
    rows = out.collect()
    assert len(rows) == 1000
    assert all((r["lat_below"], r["lat_above"]) == (r["x"] - 1, r["x"] + 1 if r["x"] < 7998 else None) for r in rows)


def test_polygons_are_not_sent_to_the_driver(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]
    edges = [(k, *a, *b) for k in ("a", "b", "c") for a, b in zip(ring, ring[1:] + ring[:1])]
    edge_df = spark.createDataFrame(edges, "polygon_id string, x1 double, y1 double, x2 double, y2 double")
    where = spark.createDataFrame([(1, 3.5, 3.5), (2, 0.5, 0.5), (3, 9.0, 9.0)], "location_id int, lat double, lon double")
    asked = []
    found = spatial.points_in_polygons

    def counted(*args, index=None, **options):
        asked.append(index.groupBy("_level", "_cx", "_cy").count().agg(F.max("count")).first()[0])
        asked.append(index.filter("_cx = 3 AND _cy = 3").count())
        return found(*args, index=index, **options)

    spatial.points_in_polygons = counted
    try:
        out = spatial.polygon_of_point(where, edge_df)
    finally:
        spatial.points_in_polygons = found
    assert "Broadcast" not in out._jdf.queryExecution().toString()
    assert asked == [3, 1]  # of the polygons that cover a cell the first one only
    assert sorted(tuple(r) for r in out.select("location_id", "polygon_id").collect()) == [(1, "a"), (2, "a"), (3, None)]
