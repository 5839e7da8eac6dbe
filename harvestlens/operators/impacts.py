"""Baseline statistics, impacts against a baseline period and ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number, ratio, relative_change, require_columns
from harvestlens.operators.grouping import group_percentiles, split_join
from harvestlens.session import store

PERCENTILES = (10, 25, 50, 75, 90)


def baseline_statistics(
    data: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    percentiles: Sequence[float] = PERCENTILES,
    exact: bool = True,
    nulls: str = "propagate",
) -> DataFrame:
    """``{v}_mean, {v}_std, {v}_cv, {v}_p10 ...`` per group."""
    require_columns(data, [*keys, *value_cols], "baseline data")
    if exact and percentiles:
        figures = group_percentiles(data, keys, value_cols, [p / 100 for p in percentiles], nulls)
        moments, ranks = [], []
        for v in value_cols:
            x = col(v)
            moments += [
                x["_mean"].alias(f"{v}_mean"),
                x["_std"].alias(f"{v}_std"),
                ratio(x["_std"], x["_mean"]).alias(f"{v}_cv"),
            ]
            ranks += [x["_q"][i].alias(f"{v}_p{p:g}") for i, p in enumerate(percentiles)]
        return figures.select(*keys, *moments, *ranks)
    aggregates = []
    for v in value_cols:
        x = number(v)
        aggregates += [
            F.avg(x).alias(f"{v}_mean"),
            F.stddev_samp(x).alias(f"{v}_std"),
            ratio(F.stddev_samp(x), F.avg(x)).alias(f"{v}_cv"),
        ]
    for v in value_cols:
        aggregates += [F.percentile_approx(number(v), p / 100).alias(f"{v}_p{p:g}") for p in percentiles]
    return keyed(data, keys).groupBy(*keys).agg(*aggregates)


def _changes(value_cols: Sequence[str]) -> dict[str, Column]:
    out = {}
    for v in value_cols:
        future, base = col(f"{v}_future"), col(f"{v}_baseline")
        out[f"{v}_abs_change"] = future - base
        out[f"{v}_rel_change"] = relative_change(future, base)
    return out


def impacts_between(
    future: DataFrame, baseline: DataFrame, value_cols: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Changes of group means between two data sets; groups present in both."""
    require_columns(future, [*keys, *value_cols], "future data")
    require_columns(baseline, [*keys, *value_cols], "baseline data")

    def means(df: DataFrame, suffix: str) -> DataFrame:
        return (
            keyed(df, keys)
            .groupBy(*keys)
            .agg(*[F.avg(number(v)).alias(f"{v}_{suffix}") for v in value_cols])
        )

    joined = means(future, "future").join(means(baseline, "baseline"), list(keys))
    return joined.withColumns(_changes(value_cols))


def climate_impacts(
    results: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    baseline: str = "historical",
    periods: Sequence[str] | None = None,
    future_keys: Sequence[str] = (),
    period_col: str = "period",
) -> DataFrame:
    """Impacts of all future periods in one scan of the results.

    ``future_keys`` split the future side only (for example the emission
    scenario, which the baseline does not have). The rows are summed by group,
    ``future_keys`` and period first; the baseline then reaches its group by a
    window over those sums, whose size is periods times future key values.
    """
    require_columns(results, [*keys, *future_keys, period_col, *value_cols], "results")
    wanted = results
    if periods is not None:
        wanted = results.filter(col(period_col).isin([baseline, *periods]))
    level = [*keys, *future_keys, period_col]
    sums = [F.count(F.lit(1)).alias("_rows")]
    for v in value_cols:
        sums += [F.sum(number(v)).alias(f"_s_{v}"), F.count(number(v)).alias(f"_n_{v}")]
    cells = keyed(wanted, [*keys, period_col]).groupBy(*level).agg(*sums)
    group = Window.partitionBy(*keys)
    is_base = col(period_col) == baseline

    def base_sum(name: str) -> Column:
        return F.sum(F.when(is_base, col(name))).over(group)

    out = cells.withColumns(
        {
            "_base_rows": base_sum("_rows"),
            **{f"{v}_future": ratio(col(f"_s_{v}"), col(f"_n_{v}")) for v in value_cols},
            **{
                f"{v}_baseline": ratio(base_sum(f"_s_{v}"), base_sum(f"_n_{v}"))
                for v in value_cols
            },
        }
    ).filter(~is_base & (F.col("_base_rows") > 0))
    if future_keys:
        out = keyed(out, future_keys)
    out = out.select(*level, *[f"{v}_{side}" for v in value_cols for side in ("future", "baseline")])
    return out.withColumns(_changes(value_cols))


def ensemble_statistics(
    data: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    model_col: str = "crop_model",
    threshold: float = 0.75,
) -> DataFrame:
    """Mean, spread and share of members above the group mean, per group.

    All variables share two aggregations: the means, and the comparison of each
    row with them. The members are stored first and read for both. Null members count in
    the denominator of the share.
    """
    require_columns(data, [*keys, *value_cols, model_col], "ensemble members")
    rows = keyed(data, keys).select(
        *keys, col(model_col).alias("_model"), *[number(v).alias(v) for v in value_cols]
    )
    rows = store(rows, "ensemble-members")
    figures = {}
    for v in value_cols:
        figures[f"{v}_mean"] = F.avg(col(v))
        figures[f"{v}_std"] = F.stddev_samp(col(v))
        figures[f"{v}_min"] = F.min(col(v))
        figures[f"{v}_max"] = F.max(col(v))
    figures["n_models"] = F.count("_model")
    stats = rows.groupBy(*keys).agg(*[f.alias(n) for n, f in figures.items()], F.count(F.lit(1)).alias("_size"))
    stats = store(stats, "ensemble-figures")
    joined = split_join(rows.drop("_model"), stats.drop("_size"), keys, sizes=stats.select(*keys, "_size"))
    compared = joined.groupBy(*keys).agg(
        *[F.max(col(n)).alias(n) for n in figures],
        *[
            (F.count_if(col(v) > col(f"{v}_mean")) / F.count(F.lit(1))).alias(f"{v}_agreement")
            for v in value_cols
        ],
    )
    return compared.withColumns(
        {f"{v}_high_agreement": col(f"{v}_agreement") > threshold for v in value_cols}
    )


def direction_agreement(data: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Percentage of members that agree on the more common sign."""
    def agree(v: str) -> Column:
        x = number(v)
        same = F.greatest(F.count_if(x > 0), F.count_if(x < 0)).cast("double")
        return ratio(same * 100, F.count(x).cast("double")).alias(f"{v}_agreement_direction")

    return keyed(data, keys).groupBy(*keys).agg(*[agree(v) for v in value_cols])


def change_quantiles(
    changes: DataFrame,
    keys: Sequence[str],
    change_cols: dict[str, str],
    probabilities: Sequence[float] = (0.1, 0.9),
) -> DataFrame:
    """``{v}_change_q10`` and ``_q90``; ``change_cols`` maps a variable to its change column."""
    named = changes.select(*keys, *[col(c).alias(v) for v, c in change_cols.items()])
    figures = group_percentiles(named, keys, list(change_cols), probabilities, nulls="omit")
    return figures.select(
        *keys, *[col(v)["_q"][i].alias(f"{v}_change_q{p * 100:g}") for v in change_cols for i, p in enumerate(probabilities)]
    )


def yearly_means(
    data: DataFrame, keys: Sequence[str], year: Column, value_cols: Sequence[str]
) -> DataFrame:
    rows = keyed(data, keys).withColumn("year", year)
    return rows.groupBy(*keys, "year").agg(*[F.avg(number(v)).alias(f"{v}_mean") for v in value_cols])
