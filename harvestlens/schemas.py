"""Explicit schemas of the fixed columns; value columns are a caller's choice."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


LOCATION = T.StructType(
    _fields(T.StringType(), "location_id")
    + _fields(T.DoubleType(), "lat", "lon")
    + _fields(T.StringType(), "soil_id")
    + _fields(T.DoubleType(), "elev")
)

CLIMATE_CELL = T.StructType(
    _fields(T.StringType(), "climate_source", "climate_model", "scenario", "variable")
    + _fields(T.DoubleType(), "lat", "lon")
    + _fields(T.DateType(), "date")
    + _fields(T.DoubleType(), "value")
)

RESULT_KEYS = T.StructType(
    _fields(
        T.StringType(),
        "simulation_id",
        "location_id",
        "crop_model",
        "climate_source",
        "climate_model",
        "scenario",
        "period",
        "adaptation",
        "sowing_date",
        "soil_id",
    )
    + _fields(T.DoubleType(), "lat", "lon")
)

RUN_STATUS = T.StructType(
    _fields(T.StringType(), "simulation_id", "status", "message")
    + _fields(T.DoubleType(), "setup_time", "run_time")
)

STATUS_EVENT = T.StructType(
    _fields(T.StringType(), "simulation_id")
    + _fields(T.TimestampType(), "ts")
    + _fields(T.LongType(), "seq")
    + _fields(T.StringType(), "status", "message")
)

REGION_MAP = T.StructType(_fields(T.StringType(), "location_id", "region_id"))

ADAPTATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("settings", T.MapType(T.StringType(), T.StringType())),
    ]
)

SOIL_PROFILE_ARRAYS = T.StructType(
    _fields(T.StringType(), "soil_id")
    + _fields(T.ArrayType(T.DoubleType()), "depth", "sand", "clay")
)

_LAYER = T.StructType(_fields(T.DoubleType(), "depth", "sand", "clay"))
# either the arrays or the list of layers
SOIL_PROFILE = T.StructType([*SOIL_PROFILE_ARRAYS.fields, T.StructField("layers", T.ArrayType(_LAYER))])

RESULT_REQUIRED = [
    "location_id",
    "crop_model",
    "climate_source",
    "climate_model",
    "scenario",
    "sowing_date",
]
