"""The matrix of simulation runs and the assignment of periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, require_columns, simulation_key
from harvestlens.operators.grouping import split_join

ID_ORDER = ("location_id", "crop_model", "climate_source", "climate_model", "scenario", "adaptation")


def simulation_matrix(
    locations: DataFrame,
    dimensions: Mapping[str, Sequence[str]],
    sowing_dates: Sequence[str],
    adaptation_sowing: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All runs: every location with every combination of the configured values.

    The configured lists are array literals unfolded on each location row, so
    nothing is shuffled or joined. An adaptation may replace the sowing dates.
    """
    require_columns(locations, ["location_id"], "locations")
    out = locations
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    sowing = F.array(*[F.lit(d) for d in sowing_dates])
    if "adaptation" in dimensions:
        for name, dates in (adaptation_sowing or {}).items():
            own = F.array(*[F.lit(d) for d in dates])
            sowing = F.when(F.col("adaptation") == name, own).otherwise(sowing)
    out = out.withColumn("sowing_date", F.explode(sowing))
    parts = [col(c) for c in ID_ORDER if c == "location_id" or c in dimensions]
    return out.withColumn("simulation_id", simulation_key(*parts, sowing=F.col("sowing_date")))


def attach_attributes(
    runs: DataFrame, dimension: DataFrame, columns: Sequence[str], key: str = "location_id"
) -> DataFrame:
    """Bring attributes such as ``soil_id`` or ``lat, lon`` to runs or results.

    A location with a large share of the runs is joined in parts.
    """
    require_columns(dimension, [key, *columns], "dimension")
    return split_join(runs.drop(*columns), dimension.select(key, *columns), [key])


def choose(df: DataFrame, wanted: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Keep chosen sources, models and scenarios; ``None`` keeps all.

    On partition columns the filter prunes folders.
    """
    for name, values in wanted.items():
        if values is not None:
            df = df.filter(col(name).isin(list(values)))
    return df


def one_period(df: DataFrame, period: str, period_col: str = "period") -> DataFrame:
    require_columns(df, [period_col], "results")
    return df.filter(col(period_col) == period)


def without_baseline(df: DataFrame, baseline: str = "baseline", adaptation_col: str = "adaptation") -> DataFrame:
    return df.filter(col(adaptation_col) != baseline)


def period_of(date: Column, periods: Mapping[str, Sequence[str]]) -> Column:
    """Name of the period that contains a date, NULL in the gaps (no overlaps allowed)."""
    spans = sorted((str(s), str(e)) for s, e in periods.values())
    if any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("periods overlap: use assign_periods")
    out = F.lit(None).cast("string")
    for name, (start, end) in periods.items():
        inside = date.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def assign_periods(
    df: DataFrame, date_col: str, periods: Mapping[str, Sequence[str]] | DataFrame
) -> DataFrame:
    """Add ``period``; dates in no period drop out, overlaps give several rows.

    A configured mapping becomes expressions. A stored table ``(period, start_date,
    end_date)`` is unfolded to the years it covers and joined on the year, heavy years in parts, with
    the exact dates as a residual condition; read from storage, its size is known.
    """
    if isinstance(periods, DataFrame):
        years = periods.select(
            "period",
            "start_date",
            "end_date",
            F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("_year"),
        )
        dated = df.withColumn("_year", F.year(col(date_col)))
        day = col(date_col).cast("date")
        return (
            split_join(dated, years, ["_year"])
            .filter(day.between(F.col("start_date"), F.col("end_date")))
            .drop("_year", "start_date", "end_date")
        )
    day = col(date_col).cast("date")
    # the outer bounds are a plain comparison, which reaches the scan
    first = min(str(s) for s, _ in periods.values())
    last = max(str(e) for _, e in periods.values())
    df = df.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    overlap = any(
        str(a[0]) <= str(b[1]) and str(b[0]) <= str(a[1])
        for a, b in combinations(periods.values(), 2)
    )
    if not overlap:
        return df.withColumn("period", period_of(day, periods)).filter(F.col("period").isNotNull())
    names = [F.when(period_of(day, {n: s}).isNotNull(), F.lit(n)) for n, s in periods.items()]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*names))))
