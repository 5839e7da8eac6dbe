"""Aggregation of locations to regions.

Rows are first reduced to one sum per location, so that neither a hot location
nor a hot region moves more than one row per location through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number, ratio, require_columns


def _location_sums(
    data: DataFrame, value_cols: Sequence[str], location_col: str, keys: Sequence[str]
) -> DataFrame:
    require_columns(data, [location_col, *keys, *value_cols], "point results")
    sums = []
    for v in value_cols:
        sums += [F.sum(number(v)).alias(f"_s_{v}"), F.count(number(v)).alias(f"_n_{v}")]
    return keyed(data, [location_col, *keys]).groupBy(location_col, *keys).agg(*sums)


def region_means(
    data: DataFrame,
    region_map: DataFrame,
    value_cols: Sequence[str],
    location_col: str = "location_id",
    region_col: str = "region_id",
    keys: Sequence[str] = (),
    suffix: str = "",
) -> DataFrame:
    mapping = keyed(region_map, [region_col]).select(location_col, region_col)
    cells = _location_sums(data, value_cols, location_col, keys).join(mapping, location_col)
    return cells.groupBy(region_col, *keys).agg(
        *[
            ratio(F.sum(col(f"_s_{v}")), F.sum(col(f"_n_{v}"))).alias(f"{v}{suffix}")
            for v in value_cols
        ]
    )


def region_weighted(
    data: DataFrame,
    region_map: DataFrame,
    weights: DataFrame,
    value_cols: Sequence[str],
    mode: str = "sum",
    location_col: str = "location_id",
    region_col: str = "region_id",
    weight_col: str = "weight",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``sum``: weighted sum, 0 where nothing counts. ``mean``: that over the weights used."""
    if mode not in ("sum", "mean"):
        raise ValueError(f"mode must be sum or mean, not {mode!r}")
    mapping = keyed(region_map, [region_col]).select(location_col, region_col)
    w = number(weight_col)
    cells = (
        _location_sums(data, value_cols, location_col, keys)
        .join(mapping, location_col)
        .join(weights.select(location_col, weight_col), location_col, "left")
    )

    def figure(v: str):
        total = F.sum(w * col(f"_s_{v}"))
        if mode == "sum":
            return F.coalesce(total, F.lit(0.0)).alias(v)
        return ratio(total, F.sum(w * col(f"_n_{v}"))).alias(v)

    return cells.groupBy(region_col, *keys).agg(*[figure(v) for v in value_cols])
