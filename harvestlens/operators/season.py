"""Summaries of daily climate: seasons, months, extremes, spells, smoothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number, require_columns
from harvestlens.operators.ordering import global_positions
from harvestlens.session import store

_FREQUENCIES = {"month": "month", "M": "month", "year": "year", "Y": "year"}


def _season_figures(columns: Sequence[str]) -> dict[str, tuple[str, Column]]:
    """Partial sums behind the season figures of the variables present."""
    figures = {"_days": ("days", F.count("date"))}
    for v in ("pr", "tasmax", "tasmin", "rsds"):
        if v in columns:
            figures[f"_s_{v}"] = (v, F.sum(number(v)))
            figures[f"_n_{v}"] = (v, F.count(number(v)))
    return figures


def totals_up_to(daily: DataFrame, days: DataFrame, keys: Sequence[str], figures: Mapping[str, Column]) -> DataFrame:
    """``keys, _date`` of ``days`` with the sums of ``figures`` over all data up to that day, that day included.

    Sums of a day are gathered to months, a month's days being one short list, and running totals
    of the months give what came before each. A day takes the last month that began by then:
    both windows hold at most the calendar's months and days for a key, whatever the rows.
    """
    names = list(figures)
    by_day = keyed(daily, [*keys, "date"]).groupBy(*keys, F.col("date").cast("date").alias("_date")).agg(
        *[f.alias(n) for n, f in figures.items()]
    )
    months = by_day.groupBy(*keys, F.trunc("_date", "month").alias("_month")).agg(
        *[F.sum(n).alias(n) for n in names], F.collect_list(F.struct("_date", *names)).alias("_list")
    )
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before{n}") for n in names]
    blocks = months.select(*keys, "_month", F.struct(F.col("_month").alias("start"), "_list", *names, *before).alias("_block"))
    asked = days.withColumn("_month", F.trunc("_date", "month"))
    line = blocks.withColumn("_date", F.lit(None).cast("date")).unionByName(asked.withColumn("_block", F.lit(None).cast(blocks.schema["_block"].dataType)))
    upto = Window.partitionBy(*keys).orderBy("_month", F.col("_date").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("_block", F.last("_block", ignorenulls=True).over(upto)).filter(F.col("_date").isNotNull())
    in_month = F.col("_block.start") == F.col("_month")

    def total(n: str) -> Column:
        part = F.aggregate(
            F.filter("_block._list", lambda d: d["_date"] <= F.col("_date")), F.lit(0).cast("double"), lambda acc, d: acc + F.coalesce(d[n].cast("double"), F.lit(0.0))
        )
        own = F.when(in_month, part).otherwise(F.coalesce(F.col(f"_block.{n}").cast("double"), F.lit(0.0)))
        return F.coalesce(F.col(f"_block._before{n}") + own, F.lit(0.0)).alias(n)

    return found.select(*keys, "_date", *[total(n) for n in names])


def growing_season_climate(
    runs: DataFrame,
    daily: DataFrame,
    keys: Sequence[str],
    start_col: str = "season_start",
    end_col: str = "season_end",
) -> DataFrame:
    """Season figures of every run; both ends of the season count.

    A season is the difference of two running totals of its series, that of its last day and that
    of the day before its first. The work is one pass over the days and two look-ups for each
    season; runs that share a season are computed once.
    """
    require_columns(runs, [*keys, start_col, end_col], "runs")
    require_columns(daily, [*keys, "date"], "daily climate")
    season = [*keys, start_col, end_col]
    seasons = keyed(runs, season).select(*season).distinct().filter(col(start_col) <= col(end_col))
    seasons = store(seasons.withColumn("_eve", F.date_sub(col(start_col).cast("date"), 1)), "seasons")
    figures = {n: f for n, (_, f) in _season_figures(daily.columns).items()}
    last = col(end_col).cast("date")
    ends = seasons.select(*keys, last.alias("_date")).union(seasons.select(*keys, "_eve")).distinct()
    sums = store(totals_up_to(daily, ends, keys, figures), "season-totals")
    until = sums.select(*keys, F.col("_date").alias("_last"), *[F.col(n).alias(f"_u{n}") for n in figures])
    since = sums.select(*keys, F.col("_date").alias("_eve"), *[F.col(n).alias(f"_s{n}") for n in figures])
    totals = seasons.withColumn("_last", last).join(until, [*keys, "_last"]).join(since, [*keys, "_eve"])
    totals = totals.select(*season, *[(F.col(f"_u{n}") - F.col(f"_s{n}")).alias(n) for n in figures])

    def total(v: str) -> Column:
        if f"_s_{v}" not in figures:
            return F.lit(None).cast("double")
        return F.coalesce(F.col(f"_s_{v}"), F.lit(0.0))

    def mean(v: str) -> Column:
        if f"_s_{v}" not in figures:
            return F.lit(None).cast("double")
        return F.try_divide(F.col(f"_s_{v}"), F.col(f"_n_{v}"))

    return (
        runs.join(totals, season, "left")
        .withColumns(
            {
                "GrowingDays": F.coalesce(F.col("_days"), F.lit(0.0)).cast("bigint"),
                "TotalPrecip_mm": total("pr"),
                "AvgTmax_C": mean("tasmax"),
                "AvgTmin_C": mean("tasmin"),
                "TotalRad_MJ": total("rsds"),
            }
        )
        .drop(*figures)
    )


def climate_statistics(
    daily: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    freq: str = "month",
    summed: Sequence[str] = ("pr",),
    date_col: str = "date",
) -> DataFrame:
    """Monthly or yearly ``{v}_mean``, and ``{v}_sum`` for precipitation."""
    if freq not in _FREQUENCIES:
        raise ValueError(f"freq must be one of {sorted(_FREQUENCIES)}, not {freq!r}")
    require_columns(daily, [*keys, date_col, *variables], "daily climate")
    figures = [
        F.coalesce(F.sum(number(v)), F.lit(0.0)).alias(f"{v}_sum")
        if v in summed
        else F.avg(number(v)).alias(f"{v}_mean")
        for v in variables
    ]
    start = F.trunc(col(date_col), _FREQUENCIES[freq]).alias("period_start")
    return keyed(daily, [*keys, date_col]).groupBy(*keys, start).agg(*figures)


def extreme_indices(
    daily: DataFrame,
    keys: Sequence[str],
    hot_above: float = 35.0,
    dry_below: float = 1.0,
) -> DataFrame:
    """Days with data, heatwave days (tasmax at least ``hot_above``) and dry days."""
    return keyed(daily, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(number("tasmax") >= hot_above).alias("heatwave_days"),
        F.count_if(number("pr") < dry_below).alias("dry_days"),
    )


def longest_spell(
    daily: DataFrame, keys: Sequence[str], condition: Column, name: str, date_col: str = "date"
) -> DataFrame:
    """Longest run of consecutive dates on which the condition holds, 0 for none.

    Dates are made unique first, so a window group is bounded by the calendar
    (one row per day), whatever the share of rows a group holds. A missing day
    or an unknown condition ends a run.
    """
    days = (
        keyed(daily, [*keys, date_col])
        .groupBy(*keys, col(date_col).cast("date").alias("_d"))
        .agg(F.min(F.coalesce(condition, F.lit(False))).alias("_holds"))
    )
    order = Window.partitionBy(*keys, "_holds").orderBy("_d")
    island = F.when(F.col("_holds"), F.date_sub("_d", F.row_number().over(order)))
    return (
        days.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.count_if(F.col("_holds")).alias("_len"))
        .groupBy(*keys)
        .agg(F.max("_len").alias(name))
    )


def centered_mean(
    series: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value_col: str,
    window: int,
    name: str = "smoothed",
    block: int = 100_000,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Centered moving average over ``window`` rows; incomplete windows give NULL.

    Rows are numbered in order and cut into blocks; the rows near a block's edge
    are copied into its neighbour, so a series of any length is averaged block by
    block. ``ties`` completes the order where ``order_col`` repeats.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    before, after = window // 2, (window - 1) // 2
    block = max(block, window)
    y = number(value_col)
    order = [col(order_col), *[col(t) for t in ties]]
    numbered = global_positions(store(keyed(series, [*keys, order_col]), "series"), keys, order, "_pos")
    at = (F.col("_pos") - 1) % block
    home = F.floor((F.col("_pos") - 1) / block)
    copies = F.array_compact(
        F.array(
            home,
            F.when((at < before) | (at < after), home - 1),
            F.when((at >= block - before) | (at >= block - after), home + 1),
        )
    )
    spread = numbered.withColumns({"_home": home, "_block": F.explode(copies)})
    frame = (
        Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-before, after)
    )
    return (
        spread.withColumns({"_n": F.count(y).over(frame), "_mean": F.avg(y).over(frame)})
        .filter(F.col("_block") == F.col("_home"))
        .withColumn(name, F.when(F.col("_n") == window, F.col("_mean")))
        .drop("_pos", "_home", "_block", "_n", "_mean")
    )


def process_point_series(
    points: DataFrame,
    names: Mapping[str, str],
    conversions: Mapping | None = None,
) -> DataFrame:
    """Rename the variables of point series and convert their units."""
    from harvestlens.functions.columns import convert_units, rename_variables

    return convert_units(rename_variables(points, names), conversions or {})
