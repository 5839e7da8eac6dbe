"""The pipeline's steps, each from stored tables to stored tables.

A step keeps no data on the driver and hands over through files in a folder the
caller names, so it can be repeated after a failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.columns import keyed, require_columns
from harvestlens.operators import adaptation, impacts, quality, regions, results, scenario, season, surrogate
from harvestlens.operators.grid import extract_points
from harvestlens.operators.runs import latest_status
from harvestlens.sources import tables

CLIMATE_KEYS = ["location_id", *tables.CLIMATE_FOLDERS]
IMPACT_KEYS = ["location_id", "climate_source", "climate_model"]
RUN_COLUMNS = ["location_id", "crop_model", *tables.CLIMATE_FOLDERS, "adaptation", "sowing_date", "soil_id"]


def prepare_climate(
    spark: SparkSession,
    cells_path: str,
    locations: DataFrame,
    out: str,
    variables: Sequence[str],
    choices: Mapping[str, Sequence[str]] | None = None,
    lat_range: tuple | None = None,
    lon_range: tuple | None = None,
    date_range: tuple | None = None,
    names: Mapping[str, str] | None = None,
    conversions: Mapping | None = None,
    limits: Mapping[str, Mapping[str, float]] | None = None,
    method: str = "nearest",
) -> dict[str, DataFrame]:
    """Gridded cells to checked point series.

    The series are extracted once and stored; the report comes from the stored table. It is
    stored too before it is used: read back, its size is known and Spark can broadcast the
    rejected groups instead of shuffling the series.
    """
    cells = tables.read_climate(
        spark,
        cells_path,
        variables,
        lat_range=lat_range,
        lon_range=lon_range,
        date_range=date_range,
        **(choices or {}),
    )
    points = extract_points(locations, cells, variables, [*tables.CLIMATE_FOLDERS, "date"], method)
    series = season.process_point_series(points, names or {}, conversions)
    required = [(names or {}).get(v, v) for v in variables]
    report_path, series_path = f"{out}/climate_report", f"{out}/climate_points"
    tables.write_point_series(series, f"{out}/climate_series")
    series = tables.read_point_series(spark, f"{out}/climate_series", schema=series.schema)
    report = quality.quality_report(series, CLIMATE_KEYS, required, limits)
    report.write.mode("overwrite").parquet(report_path)
    report = spark.read.parquet(report_path)
    tables.write_point_series(quality.valid_rows(series, report, CLIMATE_KEYS), series_path)
    stored = tables.read_point_series(spark, series_path, schema=series.schema)
    return {"points": stored, "report": report}


def set_up_runs(
    spark: SparkSession,
    locations: DataFrame,
    dimensions: Mapping[str, Sequence[str]],
    sowing_dates: Sequence[str],
    series: DataFrame,
    out: str,
    adaptation_sowing: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The run matrix with status READY_TO_RUN, or SETUP_ERROR without climate."""
    matrix = scenario.simulation_matrix(locations, dimensions, sowing_dates, adaptation_sowing)
    available = series.select(*CLIMATE_KEYS).distinct().withColumn("_has", F.lit(True))
    message = F.concat(F.lit("No climate data for "), F.concat_ws(", ", *CLIMATE_KEYS))
    runs = (
        matrix.join(available, CLIMATE_KEYS, "left")
        .withColumn("status", F.when(F.col("_has"), "READY_TO_RUN").otherwise("SETUP_ERROR"))
        .withColumn("message", F.when(F.col("_has").isNull(), message))
        .drop("_has")
    )
    runs.write.mode("overwrite").parquet(f"{out}/runs")
    return spark.read.parquet(f"{out}/runs")


def record_status(runs: DataFrame, path: str, sequence: int) -> None:
    """Append the runs' status to the event table."""
    tables.append_status_events(
        runs.select(
            "simulation_id",
            F.current_timestamp().alias("ts"),
            F.lit(sequence).cast("bigint").alias("seq"),
            "status",
            "message",
        ),
        path,
    )


def collect_results(
    spark: SparkSession,
    outputs: DataFrame,
    runs: DataFrame,
    status_path: str,
    locations: DataFrame,
    out: str,
    mapping: Mapping[str, Mapping[str, str]] = results.VARIABLE_NAMES,
    codec: str | None = "gzip",
) -> DataFrame:
    """Raw outputs of completed runs as the standard result table."""
    state = latest_status(tables.read_status_events(spark, status_path)).select("simulation_id", "status")
    columns = [c for c in RUN_COLUMNS if c in runs.columns]
    current = runs.drop("status", "message").join(state, "simulation_id")
    joined = results.attach_run_metadata(outputs, current, columns)
    standard = results.standardize_wide(joined, mapping)
    placed = scenario.attach_attributes(standard, locations, ["lat", "lon"])
    tables.write_results(placed, f"{out}/results", codec)
    return tables.read_results(spark, f"{out}/results")


def analyze_impacts(
    spark: SparkSession,
    data: DataFrame,
    value_cols: Sequence[str],
    out: str,
    baseline: str = "historical",
    keys: Sequence[str] = IMPACT_KEYS,
    future_keys: Sequence[str] = ("scenario",),
    model_col: str = "climate_model",
    region_map: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Baseline statistics, impacts, ensemble and regions of all periods.

    The impacts are stored first and read back for what builds on them.
    """
    require_columns(data, ["period", *keys, *value_cols], "simulation results")
    base = scenario.one_period(data, baseline)
    changes = impacts.climate_impacts(data, keys, value_cols, baseline, future_keys=future_keys)
    tables.write_period_tables({"impacts": changes}, out)
    stored = tables.read_period_tables(spark, out, ["impacts"])["impacts"]
    figures = [f"{v}_{kind}" for v in value_cols for kind in ("abs_change", "rel_change")]
    group = ["location_id", *future_keys, "period"]
    ensemble = impacts.ensemble_statistics(stored, group, figures, model_col)
    written = {
        "baseline": impacts.baseline_statistics(base, keys, value_cols).withColumn("period", F.lit(baseline)),
        "ensemble": ensemble,
    }
    if region_map is not None:
        written["regions"] = regions.region_means(
            ensemble, region_map, [f"{f}_mean" for f in figures], keys=[*future_keys, "period"]
        )
    tables.write_period_tables(written, out)
    return tables.read_period_tables(spark, out, ["baseline", "impacts", "ensemble", "regions"])


def analyze_adaptations(
    spark: SparkSession,
    data: DataFrame,
    value_cols: Sequence[str],
    out: str,
    baseline_adaptation: str = "baseline",
    region_map: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Effectiveness per ensemble member, its ensemble and regions, and the ranking."""
    keys = ["location_id", "climate_model", "adaptation"]
    changes = impacts.climate_impacts(data, keys, value_cols, future_keys=["scenario"])
    members = adaptation.effectiveness_of_impacts(
        changes,
        value_cols,
        ["location_id", "climate_model", "scenario", "period"],
        ["location_id", "climate_model"],
        baseline_adaptation,
    )
    members.write.mode("overwrite").parquet(f"{out}/effectiveness")
    members = spark.read.parquet(f"{out}/effectiveness")
    figures = ["mean_impact_reduction", "relative_effectiveness"]
    made = {
        "ensemble": impacts.ensemble_statistics(
            members, ["adaptation", "location_id", "variable"], figures, "climate_model"
        ),
        "ranking": adaptation.ranking_table(members, ["variable"]),
    }
    if region_map is not None:
        made["regions"] = regions.region_means(
            members, region_map, figures, keys=["adaptation", "variable"]
        )
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return {"effectiveness": members, **{n: spark.read.parquet(f"{out}/{n}") for n in made}}


def train_surrogate(
    data: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    model_path: str,
    model_type: str = "RandomForest",
    hyperparameters: Mapping | None = None,
    test_share: float = 0.2,
    seed: int = 42,
) -> tuple[surrogate.Surrogate, DataFrame]:
    """Fit on the training share, store the model, and measure it on the test share."""
    prepared = surrogate.with_sowing_day(data)
    rows = surrogate.complete_rows(prepared, [*numeric, *categorical], targets)
    split = surrogate.hash_split(rows, test_share, seed)
    model = surrogate.fit_surrogate(
        split.filter(~F.col("is_test")), numeric, categorical, targets, model_type, hyperparameters
    )
    model.save(model_path)
    predicted = model.predict(split.filter(F.col("is_test")))
    return model, surrogate.regression_metrics(predicted, {t: (t, f"{t}_pred") for t in targets})


def predict_file(
    spark: SparkSession,
    features_path: str,
    model_path: str,
    out_path: str,
    model_type: str = "RandomForest",
    key: str = "simulation_id",
) -> str:
    """Predict a CSV or Parquet file of features; the result keeps the key."""
    model = surrogate.Surrogate.load(spark, model_path, model_type)
    rows = surrogate.with_sowing_day(tables.read_by_suffix(spark, features_path))
    predicted = model.predict(rows)
    columns = [key] if key in rows.columns else []
    return tables.write_by_suffix(
        predicted.select(*columns, *[F.col(f"`{t}_pred`").alias(t) for t in model.targets]), out_path
    )


def status_overview(spark: SparkSession, status_path: str) -> DataFrame:
    """Latest status of all runs of an event table."""
    return keyed(latest_status(tables.read_status_events(spark, status_path)), ["simulation_id"])
