"""Readers and writers of the pipeline's tables.

Layouts put the columns that jobs choose by into folders (climate source, model,
scenario, variable, period), so that choosing them prunes files. Writers ask
Spark to rebalance: a large folder is split over tasks and small ones share one.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens import schemas
from harvestlens.functions.columns import keyed, require_columns
from harvestlens.operators.grid import climate_window, pivot_variables
from harvestlens.operators.quality import require_rows
from harvestlens.operators.scenario import choose
from harvestlens.operators.soil import soil_layers

CLIMATE_FOLDERS = ["climate_source", "climate_model", "scenario"]
CODECS = ("gzip", "snappy", "brotli", "zstd", "none")


Choice = str | Sequence[str] | None


def _chosen(df: DataFrame, wanted: Mapping[str, Choice]) -> DataFrame:
    """Filter by single values or lists; on folder columns this prunes files."""
    lists = {n: [v] if isinstance(v, str) else v for n, v in wanted.items()}
    return choose(df, lists)


def _write(df: DataFrame, path: str, folders: Sequence[str], mode: str, codec: str = "snappy") -> None:
    codec = "none" if codec is None else codec
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}, not {codec!r}")
    df.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).option(
        "compression", codec
    ).parquet(path)


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, escape='"')


def _csv_by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns found by name; absent ones are left out, types come from the schema."""
    header = spark.read.csv(path, header=True)
    return header.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in header.columns]
    )


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """``location_id, lat, lon`` and, where the file has them, ``soil_id`` and ``elev``."""
    table = _csv_by_header(spark, path, schemas.LOCATION)
    return require_columns(table, ["location_id", "lat", "lon"], "locations")


def unreadable_locations(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a locations file whose coordinates are missing or no numbers, as text."""
    rows = require_columns(spark.read.csv(path, header=True), ["location_id", "lat", "lon"], "locations")
    bad = F.col("lat").try_cast("double").isNull() | F.col("lon").try_cast("double").isNull()
    return rows.filter(bad).select("location_id", "lat", "lon")


def read_region_map(spark: SparkSession, path: str) -> DataFrame:
    return _csv_by_header(spark, path, schemas.REGION_MAP)


def write_climate_cells(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long cells in ``source/model/scenario/variable`` folders, sorted by place and day."""
    folders = [*CLIMATE_FOLDERS, "variable"]
    df.hint("rebalance", *folders).sortWithinPartitions(
        *folders, "lat", "lon", "date"
    ).write.mode(mode).partitionBy(*folders).parquet(path)


def read_climate(
    spark: SparkSession,
    path: str,
    variables: Sequence[str],
    climate_source: Choice = None,
    climate_model: Choice = None,
    scenario: Choice = None,
    lat_range: tuple | None = None,
    lon_range: tuple | None = None,
    date_range: tuple | None = None,
) -> DataFrame:
    """Cells of the chosen folders, box and dates with one column per variable."""
    cells = spark.read.schema(schemas.CLIMATE_CELL).parquet(path)
    chosen = {
        "climate_source": climate_source,
        "climate_model": climate_model,
        "scenario": scenario,
    }
    window = climate_window(_chosen(cells, chosen), lat_range, lon_range, date_range, variables)
    return pivot_variables(window, [*CLIMATE_FOLDERS, "lat", "lon", "date"], variables)


def write_point_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write(df, path, CLIMATE_FOLDERS, mode)


def read_point_series(
    spark: SparkSession,
    path: str,
    location_id: Choice = None,
    climate_source: Choice = None,
    climate_model: Choice = None,
    scenario: Choice = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Stored series; with a ``schema`` a folder without any file is an empty table."""
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    chosen = {
        "location_id": location_id,
        "climate_source": climate_source,
        "climate_model": climate_model,
        "scenario": scenario,
    }
    return _chosen(df, chosen)


def read_run_status(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.RUN_STATUS)


def append_status_events(df: DataFrame, path: str) -> None:
    """Status changes are appended; ``latest_status`` gives the current table."""
    df.write.mode("append").parquet(path)


def read_status_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATUS_EVENT).parquet(path)


def write_results(df: DataFrame, path: str, codec: str | None = "gzip", mode: str = "overwrite") -> None:
    codec = "none" if codec is None else codec
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}, not {codec!r}")
    df.write.mode(mode).option("compression", codec).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result table, checked for its columns and for having rows."""
    df = require_columns(spark.read.parquet(path), schemas.RESULT_REQUIRED, "simulation results")
    return require_rows(df, "simulation results")


def write_period_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One table per kind of result in ``period`` folders; empty periods leave none."""
    for name, df in tables.items():
        _write(keyed(df, ["period"]), f"{path.rstrip('/')}/{name}", ["period"], mode)


def read_period_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables that exist, with ``period`` as a column."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return out


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.csv(path, header=True, inferSchema=schema is None)
    raise ValueError(f"unsupported file type: {path}")


def write_by_suffix(df: DataFrame, path: str, codec: str = "snappy", mode: str = "overwrite") -> str:
    """Write Parquet or CSV by suffix and return the format; others become CSV."""
    if path.endswith(".parquet"):
        df.write.mode(mode).option("compression", codec).parquet(path)
        return "parquet"
    if not path.endswith(".csv"):
        warnings.warn(f"unknown file type, written as CSV: {path}", stacklevel=2)
    df.write.mode(mode).csv(path, header=True)
    return "csv"


def read_soil_layers(spark: SparkSession, path: str, soil_id: str | None = None) -> DataFrame:
    """Layers of soil profiles stored as JSON rows, each with parallel arrays or with a list of layers."""
    profiles = spark.read.schema(schemas.SOIL_PROFILE).json(path)
    zipped = F.arrays_zip("depth", "sand", "clay").cast(schemas.SOIL_PROFILE["layers"].dataType)
    profiles = profiles.withColumn("layers", F.coalesce("layers", zipped))
    if soil_id is not None:
        profiles = profiles.filter(F.col("soil_id") == soil_id)
    return soil_layers(profiles, layers_col="layers")
