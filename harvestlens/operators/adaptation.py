"""Adaptation settings, effectiveness and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens import schemas
from harvestlens.functions.columns import col, keyed, number, ratio, require_columns
from harvestlens.functions.significance import add_t_test
from harvestlens.operators.grouping import split_join
from harvestlens.session import store


def flat_settings(item: Mapping) -> dict[str, str]:
    """Settings of one adaptation as text; nested per-model ones become ``MODEL.key`` entries."""
    flat = {}
    for key, value in (item.get("settings") or {}).items():
        if isinstance(value, Mapping):
            flat.update({f"{key}.{k}": str(v) for k, v in value.items()})
        elif isinstance(value, (list, tuple)):
            flat[key] = ",".join(str(v) for v in value)
        else:
            flat[key] = str(value)
    return flat


def adaptation_table(spark: SparkSession, adaptations: Sequence[Mapping]) -> DataFrame:
    """The configured adaptations as rows with their settings as a MAP."""
    rows = [(item["name"], item.get("description"), flat_settings(item)) for item in adaptations]
    return spark.createDataFrame(rows, schemas.ADAPTATION)


def effective_setting(
    adaptations: Sequence[Mapping], name: str, baseline: Column, adaptation: Column, crop_model: Column
) -> Column:
    """A setting of the crop model, else of the adaptation, else the baseline value."""
    out = baseline
    for item in adaptations:
        flat = flat_settings(item)
        own = F.lit(flat[name]) if name in flat else baseline
        for key, value in flat.items():
            model, dot, setting = key.rpartition(".")
            if dot and setting == name:
                own = F.when(crop_model == model, F.lit(value)).otherwise(own)
        out = F.when(adaptation == item["name"], own).otherwise(out)
    return out


def apply_settings(
    runs: DataFrame,
    adaptations: Sequence[Mapping],
    baselines: Mapping[str, Column],
    adaptation_col: str = "adaptation",
    crop_model_col: str = "crop_model",
) -> DataFrame:
    """Effective management parameters of each run, from the configured settings as literals."""
    return runs.withColumns(
        {
            name: effective_setting(adaptations, name, base, col(adaptation_col), col(crop_model_col))
            for name, base in baselines.items()
        }
    )


def adaptation_effectiveness(
    adapted: DataFrame,
    baseline_impacts: DataFrame,
    target_vars: Sequence[str],
    keys: Sequence[str],
    by: Sequence[str] = (),
    adaptation_col: str = "adaptation",
    alpha: float = 0.05,
) -> DataFrame:
    """Effectiveness and t-test per (adaptation, variable) and optional ``by`` keys.

    Adapted values ``v`` meet ``{v}_abs_change`` of the baseline on ``keys``. Both sides are stored
    first, so what they come from is worked out once.
    """
    require_columns(adapted, [*keys, adaptation_col, *target_vars], "adaptation results")
    require_columns(baseline_impacts, [*keys, *[f"{v}_abs_change" for v in target_vars]], "impacts")
    left = keyed(adapted, [*keys, adaptation_col]).select(
        *keys, adaptation_col, *[number(v).alias(f"_a_{v}") for v in target_vars]
    )
    right = keyed(baseline_impacts, keys).select(
        *keys, *[number(f"{v}_abs_change").alias(f"_b_{v}") for v in target_vars]
    )
    left, right = store(left, "adapted"), store(right, "baseline-impacts")
    pairs = split_join(left, right, keys)
    return _summarize_pairs(pairs, target_vars, [*by, adaptation_col], alpha)


def effectiveness_of_impacts(
    changes: DataFrame,
    target_vars: Sequence[str],
    keys: Sequence[str],
    by: Sequence[str] = (),
    baseline: str = "baseline",
    adaptation_col: str = "adaptation",
    alpha: float = 0.05,
) -> DataFrame:
    """The same figures from one table of ``{v}_abs_change`` for all adaptations.

    ``changes`` holds one row per (keys, adaptation). The baseline's value comes
    from a window over the adaptations of a key, so that the results behind
    ``changes`` are read once.
    """
    require_columns(changes, [*keys, adaptation_col, *[f"{v}_abs_change" for v in target_vars]], "impacts")
    group = Window.partitionBy(*keys)
    is_base = col(adaptation_col) == baseline
    values = {f"_a_{v}": number(f"{v}_abs_change") for v in target_vars}
    base = {f"_b_{v}": F.max(F.when(is_base, number(f"{v}_abs_change"))).over(group) for v in target_vars}
    pairs = (
        keyed(changes, [*keys, adaptation_col])
        .select(
            *keys,
            adaptation_col,
            *[x.alias(n) for n, x in {**values, **base}.items()],
            F.count_if(is_base).over(group).alias("_has"),
        )
        .filter((F.col("_has") > 0) & ~is_base)
    )
    return _summarize_pairs(pairs, target_vars, [*by, adaptation_col], alpha)


def _summarize_pairs(
    pairs: DataFrame, target_vars: Sequence[str], group: Sequence[str], alpha: float
) -> DataFrame:
    """Figures of (``_a_{v}``, ``_b_{v}``) pairs: aggregated wide, then one row per variable."""
    wide = []
    for v in target_vars:
        for side in ("a", "b"):
            x = col(f"_{side}_{v}")
            wide.append(
                F.struct(
                    F.count(F.lit(1)).cast("double").alias("rows"),
                    F.count(x).cast("double").alias("n"),
                    F.avg(x).alias("mean"),
                    F.var_samp(x).alias("var"),
                    F.stddev_samp(x).alias("std"),
                ).alias(f"_{side}_{v}")
            )
    totals = pairs.groupBy(*group).agg(*wide)
    unfolded = totals.select(
        *group,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("variable"),
                        col(f"_a_{v}").alias("_a"),
                        col(f"_b_{v}").alias("_b"),
                    )
                    for v in target_vars
                ]
            )
        ).alias("_"),
    ).select(*group, "_.*")
    a, b = F.col("_a"), F.col("_b")
    return (
        add_t_test(unfolded, "_a", "_b").withColumns(
            {
                "mean_impact_reduction": b["mean"] - a["mean"],
                "impact_reduction_std": b["std"],
                "relative_effectiveness": ratio(a["mean"] - b["mean"], F.abs(b["mean"])) * 100,
            }
        )
        .withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .drop("_a", "_b")
    )


def effectiveness_vs_baseline(
    results: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    baseline: str = "baseline",
    adaptation_col: str = "adaptation",
) -> DataFrame:
    """Difference of each adaptation's group mean from the baseline adaptation's.

    One row per (group, adaptation, variable); groups without the baseline drop
    out. The window runs over group means, one row per adaptation.
    """
    level = [*keys, adaptation_col]
    means = (
        keyed(results, level).groupBy(*level).agg(*[F.avg(number(v)).alias(v) for v in value_cols])
    )
    group = Window.partitionBy(*keys)
    base = {
        f"_b_{v}": F.max(F.when(col(adaptation_col) == baseline, col(v))).over(group)
        for v in value_cols
    }
    cells = means.withColumns(
        {**base, "_has": F.count_if(col(adaptation_col) == baseline).over(group)}
    ).filter((F.col("_has") > 0) & (col(adaptation_col) != baseline))
    entries = [
        F.struct(
            F.lit(v).alias("variable"), col(v).alias("value"), col(f"_b_{v}").alias("baseline_value")
        )
        for v in value_cols
    ]
    rows = cells.select(*level, F.explode(F.array(*entries)).alias("_")).select(*level, "_.*")
    difference = F.col("value") - F.col("baseline_value")
    return rows.withColumns(
        {
            "absolute_effectiveness": difference,
            "relative_effectiveness": ratio(difference, F.abs(F.col("baseline_value"))) * 100,
        }
    )


def rank_adaptations(
    effectiveness: DataFrame,
    by: Sequence[str] = (),
    value_col: str = "absolute_effectiveness",
    adaptation_col: str = "adaptation",
    baseline: str = "baseline",
) -> DataFrame:
    """Rank by mean effect, best first, ties by name; the baseline is not ranked.

    The ranking window sees one row per adaptation, a list from the configuration.
    """
    means = (
        effectiveness.filter(col(adaptation_col) != baseline)
        .groupBy(*by, adaptation_col)
        .agg(F.avg(number(value_col)).alias("mean_effect"))
    )
    order = Window.partitionBy(*by).orderBy(F.col("mean_effect").desc_nulls_last(), col(adaptation_col))
    return means.withColumn("rank", F.row_number().over(order))


def ranking_table(
    effectiveness: DataFrame, by: Sequence[str] = (), adaptation_col: str = "adaptation"
) -> DataFrame:
    figures = []
    for v in ("mean_impact_reduction", "relative_effectiveness"):
        figures += [
            F.round(F.avg(number(v)), 3).alias(f"{v}_mean"),
            F.round(F.stddev_samp(number(v)), 3).alias(f"{v}_std"),
        ]
    share = F.round(F.avg(F.col("significant").cast("double")), 3).alias("significant_share")
    return effectiveness.groupBy(*by, adaptation_col).agg(*figures, share)


def effectiveness_order(
    effectiveness: DataFrame,
    value_col: str,
    adaptation_col: str = "adaptation",
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of the effectiveness charts: ascending within each chart ``by``, with the colour flag."""
    return effectiveness.withColumn("highlight", F.coalesce(F.col("significant"), F.lit(False))).orderBy(
        *[col(c) for c in by], col(value_col).asc(), col(adaptation_col)
    )
