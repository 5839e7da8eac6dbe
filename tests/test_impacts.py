import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import adaptation as ad
from harvestlens.operators import figures, impacts, regions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def results(spark):
    """Full product of location, model, scenario, period and adaptation, two replicates."""
    rng = np.random.default_rng(42)
    rows = [
        (f"loc_{i:02d}", m, s, p, a, float(rng.normal(4000, 800)), float(rng.normal(10000, 2000)))
        for i in range(10)
        for m in ("model_A", "model_B")
        for s in ("ssp245", "ssp585")
        for p in ("historical", "near_future", "far_future")
        for a in ("baseline", "early_sowing")
        for _ in range(2)
    ]
    return frame(
        spark,
        rows,
        "location_id string, climate_model string, scenario string, period string, adaptation string,"
        " yield_kg double, biomass double",
    )


def test_baseline_golden(spark):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 0.0), ("c", None), (None, 1.0)], "k string, y double")
    rows = {r["k"]: r for r in impacts.baseline_statistics(df, ["k"], ["y"], [50, 2.5]).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["y_mean"] == 2.0 and rows["a"]["y_std"] == pytest.approx(math.sqrt(2))
    assert rows["a"]["y_cv"] == pytest.approx(math.sqrt(2) / 2) and rows["a"]["y_p50"] == 2.0
    assert rows["a"]["y_p2.5"] == pytest.approx(1.05)
    assert rows["b"]["y_std"] is None and rows["b"]["y_p50"] == 5.0
    assert rows["c"]["y_mean"] == 0.0 and rows["c"]["y_cv"] is None and rows["c"]["y_p50"] is None


def test_approximate_percentiles(spark, results):
    out = impacts.baseline_statistics(results, ["scenario"], ["yield_kg"], [50], exact=False)
    assert out.columns == ["scenario", "yield_kg_mean", "yield_kg_std", "yield_kg_cv", "yield_kg_p50"]


def test_impacts_golden(spark):
    df = frame(
        spark,
        [
            ("a", "historical", 10.0), ("a", "historical", 30.0), ("a", "near", 30.0),
            ("b", "historical", 0.0), ("b", "near", 1.0), ("c", "near", 1.0), ("d", "historical", 1.0),
            ("e", "historical", None), ("e", "near", 2.0),
        ],
        "k string, period string, y double",
    )
    rows = {r["k"]: r for r in impacts.climate_impacts(df, ["k"], ["y"]).collect()}
    assert set(rows) == {"a", "b", "e"}
    assert rows["a"].asDict() == {
        "k": "a", "period": "near", "y_future": 30.0, "y_baseline": 20.0, "y_abs_change": 10.0, "y_rel_change": 50.0,
    }
    assert rows["b"]["y_abs_change"] == 1.0 and rows["b"]["y_rel_change"] is None
    assert rows["e"]["y_baseline"] is None and rows["e"]["y_abs_change"] is None


def test_one_pass_equals_join(spark, results):
    keys = ["location_id", "climate_model"]
    one = impacts.climate_impacts(results, keys, ["yield_kg", "biomass"], periods=["near_future"]).drop("period")
    two = impacts.impacts_between(
        results.filter("period = 'near_future'"), results.filter("period = 'historical'"), ["yield_kg", "biomass"], keys
    )
    a = one.toPandas().sort_values(keys, ignore_index=True)
    b = two.toPandas().sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_partitioning_does_not_matter(spark, results):
    keys = ["location_id", "climate_model"]
    frames = [
        impacts.ensemble_statistics(
            impacts.climate_impacts(results.repartition(n), keys, ["yield_kg"], future_keys=["scenario"]),
            ["location_id", "period"], ["yield_kg_rel_change"], "climate_model",
        ).toPandas().sort_values(["location_id", "period"], ignore_index=True)
        for n in (1, 13)
    ]
    pd.testing.assert_frame_equal(*frames)


def test_missing_period_column(spark):
    with pytest.raises(ValueError, match="period"):
        impacts.climate_impacts(frame(spark, [("s", 1000.0)], "simulation_id string, y double"), ["simulation_id"], ["y"])


def test_ensemble_golden(spark):
    df = frame(
        spark,
        [("a", "m1", 1.0), ("a", "m2", 2.0), ("a", "m3", 9.0), ("a", None, None), ("b", "m1", 4.0)],
        "k string, crop_model string, y double",
    )
    rows = {r["k"]: r for r in impacts.ensemble_statistics(df, ["k"], ["y"], threshold=0.2).collect()}
    assert rows["a"]["y_mean"] == 4.0 and rows["a"]["y_min"] == 1.0 and rows["a"]["y_max"] == 9.0
    assert rows["a"]["n_models"] == 3 and rows["a"]["y_agreement"] == 0.25 and rows["a"]["y_high_agreement"]
    assert rows["b"]["y_agreement"] == 0.0 and rows["b"]["y_std"] is None and not rows["b"]["y_high_agreement"]


def test_ensemble_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(np.arange(30_000) % 3 == 0, 0, np.arange(30_000)), "m": "x", "y": rng.normal(size=30_000)})
    out = impacts.ensemble_statistics(spark.createDataFrame(pdf), ["k"], ["y"], "m").filter("k = 0").first()
    hot = pdf[pdf.k == 0].y
    assert out["n_models"] == len(hot)
    assert out["y_agreement"] == pytest.approx((hot > hot.mean()).mean())


def test_direction_agreement(spark):
    df = frame(spark, [("a", 1.0), ("a", -2.0), ("a", -3.0), ("a", 0.0), ("b", None)], "k string, y double")
    rows = dict(impacts.direction_agreement(df, ["k"], ["y"]).collect())
    assert rows == {"a": 50.0, "b": None}


def test_quantile_order(spark, results):
    changes = impacts.climate_impacts(results, ["location_id", "climate_model"], ["yield_kg"], future_keys=["scenario"])
    rows = impacts.change_quantiles(changes, ["period"], {"yield_kg": "yield_kg_abs_change"}).collect()
    assert rows and all(r["yield_kg_change_q90"] >= r["yield_kg_change_q10"] for r in rows)


def test_regions_golden(spark):
    data = frame(spark, [("l1", 2.0), ("l1", 4.0), ("l2", 10.0), ("l3", 1.0), ("l9", 5.0), ("l2", None)], "location_id string, y double")
    mapping = frame(spark, [("l1", "A"), ("l2", "A"), ("l3", "B")], "location_id string, region_id string")
    weights = frame(spark, [("l1", 1.0), ("l2", 3.0)], "location_id string, weight double")
    assert dict(regions.region_means(data, mapping, ["y"]).collect()) == {"A": pytest.approx(16 / 3), "B": 1.0}
    assert dict(regions.region_weighted(data, mapping, weights, ["y"]).collect()) == {"A": 36.0, "B": 0.0}
    assert dict(regions.region_weighted(data, mapping, weights, ["y"], "mean").collect()) == {"A": pytest.approx(36 / 5), "B": None}
    assert regions.region_means(data, mapping, ["y"], suffix="_mean").columns == ["region_id", "y_mean"]
    with pytest.raises(ValueError):
        regions.region_weighted(data, mapping, weights, ["y"], "median")


def test_effectiveness_golden(spark):
    adapted = frame(
        spark, [("l1", "x", 1.0), ("l2", "x", 2.0), ("l3", "x", 3.0), ("l1", "n", None), ("l2", "n", 2.0), ("l1", "c", 5.0), ("l9", "z", 1.0)],
        "location_id string, adaptation string, y double",
    )
    base = frame(spark, [("l1", 3.0), ("l2", 4.0), ("l3", 8.0)], "location_id string, y_abs_change double")
    rows = {r["adaptation"]: r for r in ad.adaptation_effectiveness(adapted, base, ["y"], ["location_id"]).collect()}
    assert set(rows) == {"x", "n", "c"}
    x = rows["x"]
    assert x["mean_impact_reduction"] == 3.0 and x["relative_effectiveness"] == pytest.approx(-60.0)
    assert x["impact_reduction_std"] == pytest.approx(math.sqrt(7))
    # t = -3 / sqrt(4 * 2/3) with 4 degrees of freedom
    assert x["p_value"] == pytest.approx(0.1401, abs=1e-3) and x["significant"] is False
    assert rows["n"]["p_value"] is None and rows["n"]["significant"] is False
    assert rows["c"]["p_value"] is None


def test_constant_samples(spark):
    adapted = frame(spark, [(i, "x", 1.0) for i in range(3)] + [(i, "y", 2.0) for i in range(3)], "k int, adaptation string, y double")
    base = frame(spark, [(i, 2.0) for i in range(3)], "k int, y_abs_change double")
    rows = {r["adaptation"]: r["p_value"] for r in ad.adaptation_effectiveness(adapted, base, ["y"], ["k"]).collect()}
    assert rows == {"x": 0.0, "y": None}


def test_ranking(spark, results):
    effect = ad.effectiveness_vs_baseline(results, ["location_id", "climate_model", "scenario"], ["yield_kg"])
    assert effect.filter("relative_effectiveness is null").count() == 0
    ranks = ad.rank_adaptations(effect).collect()
    assert [r["rank"] for r in ranks] == [1] and ranks[0]["adaptation"] == "early_sowing"


def test_rank_ties_by_name(spark):
    rows = [("b", 1.0), ("a", 1.0), ("c", 5.0), ("baseline", 9.0)]
    df = frame(spark, rows, "adaptation string, absolute_effectiveness double")
    ranks = {r["adaptation"]: r["rank"] for r in ad.rank_adaptations(df).collect()}
    assert ranks == {"c": 1, "a": 2, "b": 3}


def test_ranking_table_and_chart_order(spark):
    df = frame(
        spark, [("x", 1.0, 10.0, True), ("x", 2.0, 20.0, False), ("y", -1.0, 5.0, None)],
        "adaptation string, mean_impact_reduction double, relative_effectiveness double, significant boolean",
    )
    table = {r["adaptation"]: r for r in ad.ranking_table(df).collect()}
    assert table["x"]["mean_impact_reduction_mean"] == 1.5 and table["x"]["mean_impact_reduction_std"] == 0.707
    assert table["x"]["significant_share"] == 0.5
    chart = ad.effectiveness_order(df, "mean_impact_reduction").collect()
    assert [r["adaptation"] for r in chart] == ["y", "x", "x"] and chart[0]["highlight"] is False


def test_settings(spark):
    table = [{"name": "baseline", "settings": {}}, {"name": "c", "settings": {"n": 70, "DSSAT": {"cultivar": "D"}, "days": ["06-01", "07-01"]}}]
    stored = {r["name"]: r["settings"] for r in ad.adaptation_table(spark, table).collect()}
    assert stored == {"baseline": {}, "c": {"n": "70", "DSSAT.cultivar": "D", "days": "06-01,07-01"}}
    runs = frame(spark, [("baseline", "DSSAT"), ("c", "DSSAT"), ("c", "APSIM"), ("unknown", "APSIM")], "adaptation string, crop_model string")
    out = ad.apply_settings(runs, table, {"n": F.lit("50"), "cultivar": F.lit("L"), "days": F.lit("-")})
    rows = {(r["adaptation"], r["crop_model"]): (r["n"], r["cultivar"], r["days"]) for r in out.collect()}
    assert rows == {
        ("baseline", "DSSAT"): ("50", "L", "-"), ("c", "DSSAT"): ("70", "D", "06-01,07-01"),
        ("c", "APSIM"): ("70", "L", "06-01,07-01"), ("unknown", "APSIM"): ("50", "L", "-"),
    }


def test_boxplot_golden(spark):
    df = frame(spark, [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None), ("b", 2.0)], "k string, v double")
    rows = {r["k"]: r for r in figures.boxplot_summary(df, ["k"], "v").collect()}
    a = rows["a"]
    assert (a["q1"], a["median"], a["q3"], a["whisker_low"], a["whisker_high"], a["n_outliers"]) == (2, 3, 4, 1, 4, 1)
    assert rows["b"]["n"] == 1 and rows["b"]["median"] == 2.0


def test_map_layer(spark):
    places = frame(spark, [("l1", 1.0, 2.0), ("l2", 3.0, 4.0)], "location_id string, lat double, lon double")
    data = frame(spark, [("l1", 9.0, 5.0)], "location_id string, lat double, y double")
    assert sorted(tuple(r) for r in figures.map_layer(places, data).collect()) == [("l1", 1.0, 2.0, 5.0), ("l2", 3.0, 4.0, None)]
