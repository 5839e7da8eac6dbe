"""Regression surrogate of the crop models: MLlib's encoding, a forest and boosted trees on coded columns."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.columns import (
    col,
    hash_number,
    missing_and_extra,
    number,
    ratio,
    require_columns,
    sowing_day_of_year,
)
from harvestlens.operators.forest import (
    BAG,
    Boosted,
    BoostedRegressor,
    Coding,
    Forest,
    ForestRegressor,
    blocks,
    predictions,
    thresholds,
)
from harvestlens.session import partitions_for, store

CATEGORICAL = ("climate_source", "climate_model", "scenario", "period", "soil_id", "adaptation")
ALIASES = {"gcm": "climate_model"}
MAX_TREE_DEPTH = 30  # of MLlib
MAX_BINS = 32  # of a numeric feature, as in MLlib
SAMPLE = 40_000  # about as many rows set the cuts between bins; MLlib takes 10,000


def with_sowing_day(df: DataFrame) -> DataFrame:
    if "sowing_date" not in df.columns:
        return df
    return df.withColumn("sowing_doy", sowing_day_of_year(F.col("sowing_date")))


def one_hot(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{feature}_{value}`` columns of 0 and 1 instead of the features; NULL gives zeros."""
    encoded = {
        f"{f}_{v}": F.when(col(f) == v, 1).otherwise(0) for f, vs in values.items() for v in vs
    }
    return df.withColumns(encoded).drop(*values) if encoded else df


def expand_features(
    requested: Sequence[str], columns: Sequence[str], values: Mapping[str, Sequence[str]]
) -> tuple[list[str], list[str]]:
    """(sorted feature columns, requested features that cannot be had)."""
    final, absent = set(), []
    for f in requested:
        name = ALIASES.get(f, f)
        if name in values and values[name]:
            final.update(f"{name}_{v}" for v in values[name])
        elif name in columns and name not in values:
            final.add(name)
        else:
            absent.append(f)
    return sorted(final), absent


def engineer_features(
    df: DataFrame,
    requested: Sequence[str],
    values: Mapping[str, Sequence[str]],
    targets: Sequence[str] = (),
) -> tuple[DataFrame, list[str], list[str]]:
    """Encoded features, targets and ``simulation_id``: (frame, features, missing).

    ``values`` lists the configured values of the categorical features, which become one
    column each. Features with values that no configuration lists take the vector encoding
    of ``fit_surrogate``.
    """
    prepared = with_sowing_day(df)
    values = {f: sorted(map(str, vs)) for f, vs in values.items() if f in prepared.columns}
    encoded = one_hot(prepared, values)
    features, absent = expand_features(requested, encoded.columns, values)
    wanted = [*features, *[t for t in targets if t not in features], "simulation_id"]
    return encoded.select(*[col(c) for c in wanted if c in encoded.columns]), features, absent


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """The rows without a null in ``columns``, stored, and ``n_total, n_complete, n_dropped`` from the same pass."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & number(c).isNotNull()
    seen = Observation()
    counted = df.observe(
        seen,
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(complete).alias("n_complete"),
        F.count_if(~complete).alias("n_dropped"),
    )
    return store(counted.filter(complete), "complete-rows"), {n: int(v) for n, v in seen.get.items()}


def complete_rows(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], check: bool = True
) -> DataFrame:
    """Rows with all features and targets; an error when none is left."""
    require_columns(df, [*features, *targets], "surrogate data")
    rows = df.dropna(subset=[*features, *targets])
    if check and rows.isEmpty():
        raise ValueError("no row has all features and targets")
    return rows


def hash_split(
    df: DataFrame, test_share: float = 0.2, seed: int = 42, key: str = "simulation_id"
) -> DataFrame:
    """Add ``is_test`` from a hash of the key: the same for any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), col(key).cast("string"))
    return df.withColumn("is_test", hash_number(text) % 1000 < round(test_share * 1000))


def regression_metrics(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``target, RMSE, MAE, R2, Count`` of (true, predicted) columns per target.

    One wide aggregate, unfolded afterwards. Without spread in the true values R2
    is 1 for a perfect prediction and 0 otherwise.
    """
    figures, entries = [], []
    for i, (target, (true, predicted)) in enumerate(pairs.items()):
        error = number(predicted) - number(true)
        paired = F.when(error.isNotNull(), number(true))
        figures += [
            F.count(error).alias(f"_n{i}"),
            F.sum(error * error).alias(f"_sse{i}"),
            F.avg(F.abs(error)).alias(f"_mae{i}"),
            (F.var_pop(paired) * F.count(paired)).alias(f"_sst{i}"),
        ]
        n, sse, sst = F.col(f"_n{i}"), F.col(f"_sse{i}"), F.col(f"_sst{i}")
        entries.append(
            F.struct(
                F.lit(target).alias("target"),
                F.sqrt(ratio(sse, n)).alias("RMSE"),
                F.col(f"_mae{i}").alias("MAE"),
                F.when(n < 2, F.lit(None).cast("double"))
                .when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0))
                .otherwise(1 - ratio(sse, sst))
                .alias("R2"),
                n.alias("Count"),
            )
        )
    return df.agg(*figures).select(F.explode(F.array(*entries)).alias("_")).select("_.*")


def mean_r2(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("R2").alias("mean_r2"))


@dataclass
class Surrogate:
    """Fitted encoding and one regressor per target."""

    encoder: PipelineModel
    regressors: dict
    numeric: list[str]
    categorical: list[str]
    model_type: str
    bins: Bucketizer | None = None  # of the numeric features, for trees on coded columns

    @property
    def targets(self) -> list[str]:
        return list(self.regressors)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def predict(self, df: DataFrame, suffix: str = "_pred") -> DataFrame:
        """Add one prediction per target; other columns stay, those the model doesn't use with a warning."""
        absent, extra = missing_and_extra([*self.features, *self.targets, "simulation_id", "is_test"], df.columns)
        absent = [c for c in absent if c in self.features]
        if extra:
            warnings.warn(f"columns that the model does not use: {extra}", stacklevel=2)
        if absent:
            raise ValueError(f"prediction data lack features: {absent}")
        if all(isinstance(model, Forest) for model in self.regressors.values()):
            coding = _coding(self.encoder, self.bins, self.numeric, self.categorical)
            out = predictions(df, {f"{t}{suffix}": model for t, model in self.regressors.items()}, coding)
        else:
            out = self.encoder.transform(df)
            for target, model in self.regressors.items():
                model.setPredictionCol(f"{target}{suffix}").setFeaturesCol("_features")
                out = model.transform(out)
        keep = [*df.columns, *[f"{t}{suffix}" for t in self.regressors]]
        return out.select(*[col(c) for c in keep])

    def importance(self, df: DataFrame, target: str, top: int | None = None) -> DataFrame:
        """Feature importances, highest first; ``df`` supplies the encoded schema."""
        attrs = self.encoder.transform(df).schema["_raw"].metadata["ml_attr"]["attrs"]
        names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
        weights = self.regressors[target].featureImportances.toArray()
        rows = [(names.get(i, str(i)), float(w)) for i, w in enumerate(weights)]
        table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
        ordered = table.orderBy(F.col("importance").desc(), "feature")
        return ordered.limit(top) if top else ordered

    def save(self, path: str) -> None:
        base = path.rstrip("/")
        self.encoder.write().overwrite().save(f"{base}/{self.model_type}/encoder")
        spark = SparkSession.getActiveSession()
        forests = []
        for i, model in enumerate(self.regressors.values()):
            if isinstance(model, Forest):
                model.save(spark, f"{base}/{self.model_type}/target-{i}")
                forests.append([model.names, model.bins, model.features, model.trees, model.depth])
            else:
                model.write().overwrite().save(f"{base}/{self.model_type}/target-{i}")
        if self.bins:
            self.bins.write().overwrite().save(f"{base}/{self.model_type}/bins")
        meta = json.dumps(
            {
                "numeric": self.numeric,
                "categorical": self.categorical,
                "targets": self.targets,
                "model_type": self.model_type,
                "forests": forests,
                "binned": self.bins is not None,
            }
        )
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{base}/{self.model_type}/metadata"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_type: str = "RandomForest") -> "Surrogate":
        base = f"{path.rstrip('/')}/{model_type}"
        meta = json.loads(spark.read.text(f"{base}/metadata").first()[0])
        # models stored without "forests" are MLlib's
        reader = {"RandomForest": RandomForestRegressionModel, "GBT": GBTRegressionModel}[model_type]
        paths = {t: f"{base}/target-{i}" for i, t in enumerate(meta["targets"])}
        if forests := meta.get("forests"):
            kind = {"RandomForest": Forest, "GBT": Boosted}[model_type]
            regressors = {t: kind.load(spark, p, *f) for (t, p), f in zip(paths.items(), forests, strict=True)}
        else:
            regressors = {t: reader.load(p) for t, p in paths.items()}
        return cls(
            PipelineModel.load(f"{base}/encoder"),
            regressors,
            meta["numeric"],
            meta["categorical"],
            model_type,
            Bucketizer.load(f"{base}/bins") if meta.get("binned") else None,
        )


def _encoder(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Index, one-hot and assemble.

    Unknown and null categories share an extra index whose slot is the dropped
    last one, so they encode as zeros. Features are scaled but not centered:
    trees split the same way, and the one-hot vectors stay sparse.
    """
    stages = []
    inputs = list(numeric)
    if categorical:
        indexed = [f"_i_{c}" for c in categorical]
        hot = [f"_h_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=False))
    return Pipeline(stages=stages)


def _fit_encoder(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[PipelineModel, int]:
    """The fitted ``_encoder`` and the number of rows.

    The scale of a 0/1 feature follows from the count of its category, so no row is made a vector to fit the scaler.
    """
    *stages, scaler = _encoder(numeric, categorical).getStages()
    encoder = Pipeline(stages=stages).fit(rows)
    # a missing number leaves its feature without a scale, as in the scaler
    spreads = [F.stddev_samp(F.coalesce(col(c), F.lit(float("nan")))) for c in numeric]
    n, *deviations = rows.agg(F.count(F.lit(1)), *spreads).first()
    if categorical:
        texts = rows.select(*[col(c).cast("string").alias(str(i)) for i, c in enumerate(categorical)])
        found = texts.unpivot([], texts.columns, "feature", "label").groupBy("feature", "label").count().collect()
        counts = {(r["feature"], r["label"]): r["count"] for r in found}
        for i, labels in enumerate(encoder.stages[0].labelsArray):
            for k in (counts[str(i), label] for label in labels):
                deviations.append(((k - k * k / n) / (n - 1)) ** 0.5 if n > 1 else 0.0)
    scales = Vectors.dense([1 / d if d else 0.0 for d in deviations])
    product = ElementwiseProduct(scalingVec=scales, inputCol=scaler.getInputCol(), outputCol=scaler.getOutputCol())
    return PipelineModel([*encoder.stages, product]), n


def _fit_bins(rows: DataFrame, numeric: Sequence[str], n: int) -> Bucketizer | None:
    """Bins of the numeric features; like MLlib's forest, by a bounded sample of the rows."""
    if not numeric:
        return None
    share = min(1.0, SAMPLE / max(n, 1))
    sample = rows.select(*[col(c) for c in numeric]).sample(fraction=share, seed=42).toPandas()
    infinity = float("inf")
    cuts = [thresholds(sample[c].to_numpy("float64", na_value=float("nan")), MAX_BINS) or [0.0] for c in numeric]
    return Bucketizer(
        splitsArray=[[-infinity, *c, infinity] for c in cuts],
        inputCols=[f"_n_{c}" for c in numeric],
        outputCols=[f"_b_{c}" for c in numeric],
        handleInvalid="keep",
    )


def _coding(
    encoder: PipelineModel, bins: Bucketizer | None, numeric: Sequence[str], categorical: Sequence[str]
) -> Coding:
    """The columns that a forest reads, in the order of the assembled features: bins, then categories."""
    cuts = [splits[1:-1] for splits in bins.getSplitsArray()] if bins else []
    labels = encoder.stages[0].labelsArray if categorical else []
    return Coding(
        dict(zip(numeric, cuts, strict=True)), {c: list(x) for c, x in zip(categorical, labels, strict=True)}
    )


# Hyperparameter name -> setter argument; names without an equivalent are reported.
_FOREST = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
    "random_state": "seed",
}
_BOOSTED = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "learning_rate": "stepSize",
    "random_state": "seed",
}


def _regressor(model_type: str, hyperparameters: Mapping):
    known = {"RandomForest": _FOREST, "GBT": _BOOSTED}
    if model_type not in known:
        raise NotImplementedError(f"model type {model_type!r}: use one of {sorted(known)}")
    params = {
        known[model_type][k]: v
        for k, v in hyperparameters.items()
        if k in known[model_type] and v is not None
    }
    unused = sorted(k for k, v in hyperparameters.items() if k not in known[model_type] and v is not None)
    if unused:
        warnings.warn(f"{model_type} has no equivalent of {unused}", stacklevel=3)
    if int(params.get("maxDepth", 0)) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {params['maxDepth']} is beyond {MAX_TREE_DEPTH}, the deepest tree there is")
    if "featureSubsetStrategy" in params:
        params["featureSubsetStrategy"] = str(params["featureSubsetStrategy"])
    return ForestRegressor(**params) if model_type == "RandomForest" else BoostedRegressor(**params)


def fit_surrogate(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    model_type: str = "RandomForest",
    hyperparameters: Mapping | None = None,
    stored: bool = False,
) -> Surrogate:
    """Fit the encoding on the training rows and one regressor per target; ``stored`` rows are not stored again."""
    require_columns(train, [*numeric, *categorical, *targets], "training data")
    make = _regressor(model_type, {"random_state": 42, **(hyperparameters or {})})
    casts = {c: number(c) for c in [*numeric, *targets]}
    rows = train.withColumns(casts).select(*[col(c) for c in dict.fromkeys([*numeric, *categorical, *targets])])
    if not stored:
        rows = store(rows, "training-rows")
    encoder, n = _fit_encoder(rows, numeric, categorical)
    bins = _fit_bins(rows, numeric, n)
    # every target reads the inputs several times: they are made once, in partitions of a bounded size, and kept on disk
    forest, coding = model_type == "RandomForest", _coding(encoder, bins, numeric, categorical)
    if forest:
        rows = rows.withColumn(BAG, F.xxhash64(F.monotonically_increasing_id()))
    encoded = blocks(rows, targets, coding)
    parts = partitions_for(encoded.sparkSession, n, None if forest else coding.layout.rows_a_task)
    encoded = encoded.repartition(parts) if parts else encoded
    encoded = encoded.persist(StorageLevel.DISK_ONLY)
    try:
        regressors = {t: make.copy().setLabelCol(t).fit(encoded) for t in targets}
    finally:
        encoded.unpersist()
    return Surrogate(encoder, regressors, list(numeric), list(categorical), model_type, bins)


def impact_clusters(
    impacts: DataFrame,
    change_col: str,
    k: int = 4,
    lat_col: str = "lat",
    lon_col: str = "lon",
    seed: int = 42,
    name: str = "spatial_cluster",
) -> DataFrame:
    """K-means clusters of standardized position and change.

    The rows are stored first: scaling, every round of K-means and the result read them.
    """
    inputs = [lat_col, lon_col, change_col]
    rows = store(impacts.dropna(subset=inputs), "cluster-rows")
    prepared = Pipeline(
        stages=[
            VectorAssembler(inputCols=inputs, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        ]
    ).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=name).fit(prepared)
    return model.transform(prepared).drop("_raw", "_features")
