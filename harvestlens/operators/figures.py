"""The tables behind the figures: box plots and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.columns import keyed, number
from harvestlens.operators.grouping import group_percentiles, split_join
from harvestlens.session import store


def boxplot_summary(data: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 interquartile ranges, and outlier count."""
    rows = keyed(data, keys).select(*keys, number(value_col).alias("_v"))
    rows = store(rows.filter(F.col("_v").isNotNull()), "boxplot-rows")
    figures = group_percentiles(rows, keys, ["_v"], [0.25, 0.5, 0.75])
    quartiles = figures.select(
        *keys, F.col("_v._n").alias("n"), *[F.col("_v._q")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))]
    )
    quartiles = store(quartiles, "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        split_join(rows, quartiles, keys, sizes=quartiles.select(*keys, F.col("n").alias("_size")))
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def map_layer(locations: DataFrame, results: DataFrame, key: str = "location_id") -> DataFrame:
    """Every location with its results; locations without results stay.

    Locations are points: their lon and lat (EPSG:4326) are columns.
    """
    duplicates = [c for c in results.columns if c in locations.columns and c != key]
    return locations.join(results.drop(*duplicates), key, "left")
