import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from harvestlens.operators import forest as fo
from harvestlens.operators import surrogate as su

NUMERIC, CATEGORICAL = ["x"], ["kind"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    n = 400
    made = pd.DataFrame({"x": rng.integers(0, 20, n) * 1.0, "kind": rng.choice(["a", "b", "c"], n)})
    made["y"] = made.x * 3 + 40 * (made.kind == "b") + rng.normal(0, 1, n)
    made.loc[::50, "kind"] = None
    return made


@pytest.fixture(scope="module")
def data(spark, pdf):
    return spark.createDataFrame(pdf.where(pdf.notna(), None), "x double, kind string, y double").coalesce(1)


def test_a_forest_reads_blocks_of_rows(data, monkeypatch):
    """A training row is not an object of its own, with a number for every one-hot feature, in each pass."""
    seen = []

    class Fake:
        copy = lambda self: self
        setLabelCol = lambda self, name: self
        fit = lambda self, df: seen.append((df.count(), df.rdd.getNumPartitions()))

    monkeypatch.setattr(su, "_regressor", lambda *_: Fake())
    su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"])
    assert seen[0][0] <= seen[0][1]


def test_the_first_split_is_the_best_one(spark, pdf):
    """One tree, all features: the split of the root against all splits by brute force, on the same weights."""
    code = pdf.kind.map({"a": 0, "b": 1, "c": 2}).fillna(3)
    bits = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, len(pdf))
    frame = spark.createDataFrame(pd.DataFrame({"x": pdf.x, "k": code, fo.BAG: bits, "y": pdf.y}))
    rows = frame.select(fo.coded(F.col("x"), "x", 20, True), fo.coded(F.col("k"), "k", 4, False), fo.BAG, "y")
    model = fo.ForestRegressor(1, 1, 5, "all", 42).setLabelCol("y").fit(fo.blocks(rows, ["y"]))
    draw = np.random.default_rng(42).integers(1 << 62, size=1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
    w = fo._poisson_of_bits()[((bits.view(np.uint64) * draw) >> np.uint64(48)).astype(int)]
    assert 0.8 < w.mean() < 1.2

    def spread(part):
        return (w[part] * (pdf.y[part] - np.average(pdf.y[part], weights=w[part])) ** 2).sum()

    sides = [pdf.x >= c for c in range(1, 20)] + [code == c for c in range(3)]
    sides = [s for s in sides if min(w[s].sum(), w[~s].sum()) >= 5]
    best = min(sides, key=lambda s: spread(s) + spread(~s))
    everything = np.ones(len(pdf), bool)
    assert model.nodes["gain"][0] == pytest.approx(spread(everything) - spread(best) - spread(~best))
    predicted = model.transform(rows).select("prediction", "y").toPandas().sort_values("y").prediction.to_numpy()
    expected = np.where(best, np.average(pdf.y[best], weights=w[best]), np.average(pdf.y[~best], weights=w[~best]))
    np.testing.assert_allclose(predicted, expected[np.argsort(pdf.y.to_numpy())])


def test_nodes_in_turns_give_the_same_forest(data, monkeypatch):
    def fit():
        settings = {"n_estimators": 3, "max_depth": 5, "max_features": 0.7}
        return su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], hyperparameters=settings).regressors["y"].nodes

    at_once = fit()
    monkeypatch.setattr(fo, "HISTOGRAM_BYTES", 16 * 80 * 10)
    in_turns = fit()
    assert len(at_once["tree"]) > 60
    for k, v in at_once.items():
        np.testing.assert_allclose(in_turns[k], v)


def test_labels_must_be_there(data):
    with pytest.raises(ValueError, match="null"):
        su.fit_surrogate(data.withColumn("y", F.when(F.col("x") > 3, F.col("y"))), NUMERIC, CATEGORICAL, ["y"])


def test_missing_features_and_single_kinds(data):
    """Null and unknown categories and missing numbers are predicted; either kind of feature may be absent."""
    odd = data.limit(2).withColumns({"x": F.lit(None).cast("double"), "kind": F.lit("new")})
    for numeric, categorical in ((NUMERIC, CATEGORICAL), ([], CATEGORICAL), (NUMERIC, [])):
        model = su.fit_surrogate(data, numeric, categorical, ["y"], hyperparameters={"n_estimators": 2})
        assert model.predict(odd).filter("y_pred is not null").count() == 2


@pytest.mark.parametrize(
    "strategy, trees, expected",
    [("auto", 1, 28), ("auto", 10, 10), ("0.7", 10, 20), ("1.0", 10, 28), ("sqrt", 10, 6), ("log2", 10, 5), ("40", 10, 28)],
)
def test_features_per_node(strategy, trees, expected):
    assert fo._features_per_node(strategy, 28, trees) == expected


def test_thresholds():
    assert fo.thresholds(np.array([1.0, 2.0, 2.0, 4.0, np.nan]), 32) == [1.5, 3.0]
    many = fo.thresholds(np.arange(1000.0), 32)
    assert len(many) == 31 and np.ptp(np.diff(many)) <= 1
    assert fo.thresholds(np.array([7.0]), 32) == []


def test_models_of_mllib_are_still_read(spark, data, tmp_path):
    base = f"{tmp_path}/old/RandomForest"
    encoder = su._encoder(NUMERIC, CATEGORICAL).fit(data)
    forest = RandomForestRegressor(featuresCol="_features", labelCol="y", numTrees=2).fit(encoder.transform(data))
    encoder.write().save(f"{base}/encoder")
    forest.write().save(f"{base}/target-0")
    meta = {"numeric": NUMERIC, "categorical": CATEGORICAL, "targets": ["y"], "model_type": "RandomForest"}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.text(f"{base}/metadata")
    assert su.Surrogate.load(spark, f"{tmp_path}/old").predict(data).filter("y_pred is null").count() == 0


def test_codes_are_those_of_the_indexer_and_the_bucketizer(spark):
    """On a cut, beyond all cuts, null, NaN, unknown: as MLlib's stages with ``handleInvalid="keep"``."""
    numbers = [float(i) for i in range(60)] + [1.5, -7.0, float("inf"), float("-inf"), float("nan"), None]
    rows = [(x, "abc"[i % 3] if i % 4 else None, i % 5) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "x double, kind string, k int")
    encoder, n = su._fit_encoder(df.filter("x between 0 and 50 and kind <> 'c'"), ["x"], ["kind", "k"])
    bins = su._fit_bins(df.filter("x between 0 and 50"), ["x"], n)
    coding, last = su._coding(encoder, bins, ["x"], ["kind", "k"]), len(bins.getSplitsArray()[0]) - 2
    binned = bins.transform(encoder.stages[0].transform(df.withColumn("_n_x", F.col("x"))))
    codes = [F.least(F.coalesce(F.col("_b_x"), F.lit(last)), F.lit(last)), F.col("_i_kind"), F.col("_i_k")]
    expected = binned.select(*[c.cast("int") for c in codes]).toPandas().to_numpy().T
    raw = df.select(*[c.alias(str(i)) for i, c in enumerate(coding.inputs)]).toArrow()
    np.testing.assert_array_equal(coding.codes(raw.columns), expected)
    assert coding.layout.bins == [last + 1, 3, 6]


def test_scales_are_those_of_the_scaler(data):
    both = [su._encoder(NUMERIC, CATEGORICAL).fit(data), su._fit_encoder(data, NUMERIC, CATEGORICAL)[0]]
    one, two = ([r[0].toArray() for r in e.transform(data).select("_features").collect()] for e in both)
    np.testing.assert_allclose(one, two)


def test_rows_are_coded_where_the_trees_are(data, monkeypatch):
    """No encoding of row after row ahead of the trees, one way to Python for all targets, no second copy of stored rows."""
    monkeypatch.setattr(su, "store", lambda *_: pytest.fail("stored again"))
    targets, rows = ["y", "z"], data.withColumn("z", -F.col("y"))
    model = su.fit_surrogate(rows, NUMERIC, CATEGORICAL, targets, hyperparameters={"n_estimators": 2}, stored=True)
    plan = model.predict(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "UDF(" not in plan
    found = model.predict(rows).selectExpr("max(abs(y_pred + z_pred)) as gap", "count(y_pred) as n").first()
    assert found.gap < 1e-6 and found.n == rows.count()


BOOSTED = {"n_estimators": 5, "max_depth": 3, "min_samples_leaf": 4, "learning_rate": 0.3}


def test_boosting_reads_blocks_of_rows(data, monkeypatch):
    """A training row is no vector; the rows of a task follow from the bytes that it reads."""
    seen = []

    class Fake:
        copy = lambda self: self
        setLabelCol = lambda self, name: self
        fit = lambda self, df: seen.append((df.count(), df.rdd.getNumPartitions(), df.columns))

    monkeypatch.setattr(su, "_regressor", lambda *_: Fake())
    su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], "GBT")
    assert seen[0][0] <= seen[0][1] and fo.BAG not in seen[0][2]
    monkeypatch.setattr(fo, "TASK_BYTES", 250)  # 25 rows of two codes and a label
    su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], "GBT")
    assert seen[1][1] == 16


@pytest.mark.parametrize("chain", [2, 10])
def test_boosted_trees_are_those_of_mllib(spark, data, monkeypatch, chain):
    """Same bins, so the same trees, importances and predictions; the errors on disk are gone afterwards."""
    monkeypatch.setattr(fo, "CHAIN", chain)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    model = su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], "GBT", BOOSTED)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == kept
    vectors = model.encoder.transform(data)
    gbt = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=5, maxDepth=3, minInstancesPerNode=4, stepSize=0.3)
    other = gbt.fit(vectors)
    both = model.predict(other.transform(vectors)).toPandas()
    np.testing.assert_allclose(both.y_pred, both.prediction, rtol=1e-9)
    ours, theirs = model.regressors["y"].featureImportances, other.featureImportances
    np.testing.assert_allclose(ours.toArray(), theirs.toArray(), atol=1e-9)
    assert both.y_pred.nunique() > 8


def test_boosted_models_are_stored(spark, data, tmp_path):
    """Trees of this package and of MLlib, which earlier versions stored."""
    model = su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], "GBT", BOOSTED)
    gbt = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=2).fit(model.encoder.transform(data))
    old = su.Surrogate(model.encoder, {"y": gbt}, NUMERIC, CATEGORICAL, "GBT")
    for name, made in (("new", model), ("old", old)):
        made.save(f"{tmp_path}/{name}")
        again = su.Surrogate.load(spark, f"{tmp_path}/{name}", "GBT")
        a, b = (m.predict(data).orderBy("x", "y").toPandas() for m in (made, again))
        pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("settings", [{"n_estimators": 0}, {"max_depth": -1}, {"learning_rate": 0}, {"learning_rate": 1.5}])
def test_settings_of_boosting(data, settings):
    with pytest.raises(ValueError, match="maxIter"):
        su.fit_surrogate(data, NUMERIC, CATEGORICAL, ["y"], "GBT", settings)


def test_boosting_without_a_split(spark):
    """Equal labels leave nothing to split, and no tree but the first predicts anything."""
    flat = spark.createDataFrame([(float(i), 3.5) for i in range(20)], "x double, y double")
    for settings in ({}, {"max_depth": 0}):
        model = su.fit_surrogate(flat, ["x"], [], ["y"], "GBT", {"n_estimators": 3, **settings})
        assert {r["y_pred"] for r in model.predict(flat).collect()} == {3.5}
    with pytest.raises(ValueError, match="null or not finite"):
        su.fit_surrogate(flat.withColumn("y", F.expr("nullif(x, 3)")), ["x"], [], ["y"], "GBT")
