"""From raw crop-model outputs to the standard result table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions import status as st
from harvestlens.functions.columns import col, number, require_columns

# Standard name -> output name, per crop model.
VARIABLE_NAMES = {
    "DSSAT": {
        "Yield_kg_ha": "GWAD",
        "ETc_mm": "ETCP",
        "Irrigation_mm": "IRCM",
        "Anthesis_DOY": "ADAP",
        "Maturity_DOY": "MDAP",
        "Biomass_kg_ha": "HWAM",
        "SoilEvap_mm": "EPCM",
        "NUptake_kg_ha": "NICM",
    },
    "APSIM": {
        "Yield_kg_ha": "Yield",
        "ETc_mm": "Maize.Evapotranspiration",
        "Irrigation_mm": "Maize.Irrigation",
        "Anthesis_DOY": "Maize.Phenology.AnthesisDay",
        "Maturity_DOY": "Maize.Phenology.MaturityDay",
        "Biomass_kg_ha": "Maize.AboveGround.Wt",
        "SoilEvap_mm": "Maize.SoilEvap",
        "NUptake_kg_ha": "Maize.NUptake",
    },
    "STICS": {
        "Yield_kg_ha": "masec(n)",
        "ETc_mm": "cumulbetr",
        "Irrigation_mm": "cumulirrig",
        "Anthesis_DOY": "istagefloraison",
        "Maturity_DOY": "istagematurite",
        "Biomass_kg_ha": "maerienne(n)",
        "SoilEvap_mm": "cumulesol",
        "NUptake_kg_ha": "QNplanteabsorb",
    },
}

# Weather input name -> standard climate variable, per crop model.
WEATHER_NAMES = {
    "DSSAT": {
        "SRAD": "rsds",
        "TMAX": "tasmax",
        "TMIN": "tasmin",
        "RAIN": "pr",
        "WIND": "sfcWind",
        "RHUM": "hurs",
    },
    "APSIM": {
        "maxt": "tasmax",
        "mint": "tasmin",
        "rain": "pr",
        "radn": "rsds",
        "vp": "hurs",
        "wind": "sfcWind",
    },
    "STICS": {
        "tmax": "tasmax",
        "tmin": "tasmin",
        "rain": "pr",
        "rg": "rsds",
        "wind": "sfcWind",
        "rhum": "hurs",
    },
}
OPTIONAL_WEATHER = ("sfcWind", "hurs")


def standard_names(mapping: Mapping[str, Mapping[str, str]]) -> list[str]:
    return list(dict.fromkeys(std for names in mapping.values() for std in names))


def standardize_wide(
    outputs: DataFrame,
    mapping: Mapping[str, Mapping[str, str]] = VARIABLE_NAMES,
    variables: Sequence[str] | None = None,
    crop_model_col: str = "crop_model",
    keep_raw: bool = False,
) -> DataFrame:
    """Standard columns from one raw column per output name, in one projection."""
    require_columns(outputs, [crop_model_col], "model outputs")
    standard = {}
    for std in variables or standard_names(mapping):
        sources = [
            F.when(col(crop_model_col) == model, number(names[std]))
            for model, names in mapping.items()
            if names.get(std) in outputs.columns
        ]
        standard[std] = F.coalesce(*sources) if sources else F.lit(None).cast("double")
    out = outputs.withColumns(standard)
    if keep_raw:
        return out
    raw = {n for names in mapping.values() for n in names.values()} - set(standard)
    return out.select(*[col(c) for c in out.columns if c not in raw])


def unmapped_variables(
    columns: Sequence[str],
    mapping: Mapping[str, Mapping[str, str]] = VARIABLE_NAMES,
    models: Sequence[str] | None = None,
) -> list[tuple[str, str]]:
    """(model, standard name) pairs whose output name is not among the columns."""
    return [
        (model, std)
        for model in models or mapping
        for std, raw in mapping.get(model, {}).items()
        if raw not in columns
    ]


def standardize_long(
    outputs: DataFrame,
    variables: Sequence[str],
    mapping: Mapping[str, Mapping[str, str]] = VARIABLE_NAMES,
    keys: Sequence[str] = ("simulation_id", "crop_model"),
    variable_col: str = "model_var",
    value_col: str = "value",
    crop_model_col: str = "crop_model",
) -> DataFrame:
    """Standard columns from ``(keys, model_var, value)`` rows; runs without a mapped output stay.

    The names are literals in conditional aggregates: nothing is joined, and rows combine
    before the one shuffle.
    """
    def mapped(standard: str) -> Column:
        hit = F.lit(False)
        for model, names in mapping.items():
            if standard in names:
                hit = hit | ((col(crop_model_col) == model) & (col(variable_col) == names[standard]))
        return hit

    return outputs.groupBy(*keys).agg(
        *[F.max(F.when(mapped(v), number(value_col))).alias(v) for v in variables]
    )


def attach_run_metadata(
    outputs: DataFrame, runs: DataFrame, columns: Sequence[str], key: str = "simulation_id"
) -> DataFrame:
    """Parsed outputs of completed runs with their metadata."""
    done = runs.filter(st.is_completed(F.col("status"))) if "status" in runs.columns else runs
    return done.select(key, *columns).join(outputs.drop(*columns), key)


def model_weather(
    climate: DataFrame,
    crop_model: str,
    keys: Sequence[str],
    names: Mapping[str, Mapping[str, str]] = WEATHER_NAMES,
) -> DataFrame:
    """Daily climate under a crop model's input names; optional variables may be absent."""
    wanted = names[crop_model]
    absent = [v for v in wanted.values() if v not in climate.columns and v not in OPTIONAL_WEATHER]
    if absent:
        raise ValueError(f"{crop_model} needs climate variables: {absent}")
    present = [col(std).alias(raw) for raw, std in wanted.items() if std in climate.columns]
    return climate.select(*keys, *present)
