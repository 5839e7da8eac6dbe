import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens import session
from harvestlens.operators import surrogate as su


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 1500
    pdf = pd.DataFrame(
        {
            "simulation_id": [f"sim_{i:05d}" for i in range(n)],
            "lat": rng.uniform(11, 19, n),
            "rain": rng.exponential(5, n),
            "scenario": rng.choice(["ssp245", "ssp585"], n),
            "soil_id": rng.choice(["S1", "S2", "S3"], n),
            "sowing_date": rng.choice(["06-15", "06-30", "07-15"], n),
        }
    )
    pdf["Yield_kg_ha"] = 3000 + 100 * pdf.lat - 500 * (pdf.scenario == "ssp585") + rng.normal(0, 20, n)
    pdf["Irrigation_mm"] = 50 + 10 * pdf.rain
    return spark.createDataFrame(pdf)


NUMERIC, CATEGORICAL, TARGETS = ["lat", "rain"], ["scenario", "soil_id"], ["Yield_kg_ha", "Irrigation_mm"]
SMALL = {"n_estimators": 15, "max_depth": 8, "min_samples_leaf": 3, "max_features": 0.7, "min_samples_split": 5}


@pytest.fixture(scope="module")
def fitted(data):
    return su.fit_surrogate(data, NUMERIC, CATEGORICAL, TARGETS, hyperparameters=SMALL)


def test_one_hot_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "x")], "id int, scenario string, soil_id string")
    values = {"scenario": ["a", "b"], "soil_id": ["x", "y"]}
    rows = sorted(tuple(r) for r in su.one_hot(df, values).collect())
    assert rows == [(1, 1, 0, 1, 0), (2, 0, 0, 0, 1), (3, 0, 1, 1, 0)]


def test_engineer_features(data):
    lists = {"scenario": ["ssp585", "ssp245"], "climate_model": ["m"]}
    frame, features, absent = su.engineer_features(data, ["lat", "sowing_doy", "scenario", "gcm", "elev"], lists, TARGETS)
    assert features == ["lat", "scenario_ssp245", "scenario_ssp585", "sowing_doy"]
    assert absent == ["gcm", "elev"]
    assert frame.columns == [*features, *TARGETS, "simulation_id"]
    renamed = data.withColumn("climate_model", F.lit("m"))
    assert su.engineer_features(renamed, ["gcm"], lists)[1] == ["climate_model_m"]


def test_limits_and_unused_settings_are_reported(data):
    with pytest.raises(ValueError, match="deepest"):
        su.fit_surrogate(data, NUMERIC, [], TARGETS, hyperparameters={"max_depth": 40})
    with pytest.warns(UserWarning, match="min_samples_split"):
        su.fit_surrogate(data.limit(200), NUMERIC, [], TARGETS[:1], hyperparameters={"n_estimators": 2, "min_samples_split": 5})


def test_columns_that_the_model_does_not_use_are_named(data):
    model = su.fit_surrogate(data, NUMERIC, CATEGORICAL, TARGETS, hyperparameters=SMALL)
    with pytest.warns(UserWarning, match="notes"):
        model.predict(data.withColumn("notes", F.lit("x")))


def test_null_drop(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "f double, t double")
    rows, counts = su.drop_incomplete(df, ["f", "t"])
    assert counts == {"n_total": 3, "n_complete": 1, "n_dropped": 2} and rows.count() == 1
    assert su.complete_rows(df, ["f"], ["t"]).count() == 1
    with pytest.raises(ValueError):
        su.complete_rows(df.filter("f is null"), ["f"], ["t"])


def test_split_is_stable(data):
    one = su.hash_split(data).select("simulation_id", "is_test").toPandas().set_index("simulation_id").is_test
    two = su.hash_split(data.repartition(11)).select("simulation_id", "is_test").toPandas().set_index("simulation_id").is_test
    assert (one.sort_index() == two.sort_index()).all() and 0.16 < one.mean() < 0.24
    other = su.hash_split(data, seed=7).select("simulation_id", "is_test").toPandas().set_index("simulation_id").is_test
    assert (one.sort_index() != other.sort_index()).any()


def test_metrics_golden(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 5.0), (3.0, 3.0, 5.0, 5.0), (None, 1.0, 5.0, 5.0), (5.0, 4.0, 5.0, 5.0)], "y double, p double, c double, q double")
    rows = {r["target"]: r for r in su.regression_metrics(df.withColumn("none", F.lit(None).cast("double")), {"y": ("y", "p"), "c": ("c", "q"), "n": ("none", "p")}).collect()}
    assert rows["y"]["RMSE"] == pytest.approx((2 / 3) ** 0.5) and rows["y"]["MAE"] == pytest.approx(2 / 3)
    assert rows["y"]["R2"] == pytest.approx(1 - 2 / 8) and rows["y"]["Count"] == 3
    assert rows["c"]["R2"] == 1.0
    assert (rows["n"]["RMSE"], rows["n"]["R2"], rows["n"]["Count"]) == (None, None, 0)


def test_fit_is_better_than_the_mean(data):
    split = su.hash_split(data)
    model = su.fit_surrogate(split.filter("not is_test"), NUMERIC, CATEGORICAL, TARGETS, hyperparameters=SMALL)
    metrics = su.regression_metrics(model.predict(split.filter("is_test")), {t: (t, f"{t}_pred") for t in TARGETS})
    assert all(r["R2"] > 0.7 for r in metrics.collect())
    assert su.mean_r2(metrics).first()[0] > 0.7


def test_predict_unknown_and_missing(fitted, data):
    odd = data.limit(3).withColumn("soil_id", F.lit("new")).withColumn("scenario", F.lit(None).cast("string"))
    predicted = fitted.predict(odd)
    assert predicted.columns == [*data.columns, "Yield_kg_ha_pred", "Irrigation_mm_pred"]
    assert predicted.filter("Yield_kg_ha_pred is null").count() == 0
    with pytest.raises(ValueError, match="rain"):
        fitted.predict(data.drop("rain"))


def test_save_and_load(spark, fitted, data, tmp_path):
    fitted.save(str(tmp_path / "m"))
    again = su.Surrogate.load(spark, str(tmp_path / "m"))
    assert again.targets == TARGETS and again.features == NUMERIC + CATEGORICAL
    a, b = (m.predict(data).orderBy("simulation_id").toPandas() for m in (fitted, again))
    pd.testing.assert_frame_equal(a, b)


def test_importance_names(fitted, data):
    top = fitted.importance(data, "Irrigation_mm", top=3).collect()
    assert len(top) == 3 and top[0]["feature"] == "rain"
    assert {r["feature"] for r in fitted.importance(data, "Yield_kg_ha").collect()} > {"lat", "rain"}


def test_boosted_and_unknown_types(data):
    model = su.fit_surrogate(data, NUMERIC, [], ["Irrigation_mm"], "GBT", {"n_estimators": 5, "max_depth": 4})
    assert model.predict(data).filter("Irrigation_mm_pred is null").count() == 0
    with pytest.raises(NotImplementedError):
        su.fit_surrogate(data, NUMERIC, [], TARGETS, "MLP")


def test_clusters(spark):
    rows = [(f"l{i}", float(i % 2 * 50 + i * 0.1), float(i % 2 * 50), float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "location_id string, lat double, lon double, change double")
    out = su.impact_clusters(df, "change", k=2).toPandas()
    assert out.groupby("change").spatial_cluster.nunique().eq(1).all() and out.spatial_cluster.nunique() == 2


def test_clusters_work_their_input_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def change(i):
        read.add(1)
        return float(i % 2)

    df = spark.range(20).select(F.col("id").cast("string").alias("location_id"), "id", (F.col("id") * 1.0).alias("lat"))
    df = df.withColumn("lon", F.col("lat") / 2).withColumn("change", change.asNondeterministic()("id")).drop("id")
    assert len(su.impact_clusters(df, "change", k=2).collect()) == 20
    assert read.value == 20


def test_training_partitions_follow_the_rows(data, monkeypatch):
    """The vectors of all targets are made once, in partitions of a bounded size."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100, raising=False)
    seen = []

    class Fake:
        copy = lambda self: self
        setLabelCol = lambda self, name: self
        fit = lambda self, df: seen.append((df.rdd.getNumPartitions(), df.is_cached))

    monkeypatch.setattr(su, "_regressor", lambda *_: Fake())
    su.fit_surrogate(data, NUMERIC, CATEGORICAL, TARGETS)
    assert seen == [(15, True), (15, True)]
