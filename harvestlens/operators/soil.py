"""Soil profiles as one row per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.columns import require_columns


def soil_layers(
    profiles: DataFrame,
    id_col: str = "soil_id",
    properties: tuple[str, ...] = ("depth", "sand", "clay"),
    layers_col: str | None = None,
) -> DataFrame:
    """Unfold parallel arrays, or a column of layer structs, from layer 1 on.

    Shorter arrays leave NULL in the deeper layers.
    """
    if layers_col is None:
        require_columns(profiles, [id_col, *properties], "soil profiles")
        zipped = F.arrays_zip(*properties)
    else:
        require_columns(profiles, [id_col, layers_col], "soil profiles")
        zipped = F.col(layers_col)
    unfolded = profiles.select(id_col, F.posexplode(zipped).alias("_i", "_layer"))
    return unfolded.select(
        id_col,
        (F.col("_i") + 1).alias("layer_no"),
        *[F.col(f"_layer.{p}").cast("double").alias(p) for p in properties],
    )
