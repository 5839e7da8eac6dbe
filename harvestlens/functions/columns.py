"""Scalar column expressions and schema-level helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date layouts, first match wins.
DATE_LAYOUTS = ["yyyy-M-d", "yyyyMMdd", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d"]

_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(name: str) -> Column:
    """Column by exact name; model output names contain dots and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column | str) -> Column:
    """Double with NaN turned into NULL, so that aggregates skip it."""
    c = col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def relative_change(future: Column, baseline: Column) -> Column:
    return ratio(future - baseline, baseline) * 100


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "DataFrame") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks required columns: {missing}")
    return df


def keyed(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows with a null (or NaN) group key belong to no group."""
    keys = list(keys)
    if not keys:
        return df
    kinds = df.schema
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).isNotNull()
        if isinstance(kinds[k].dataType, (T.DoubleType, T.FloatType)):
            condition = condition & ~F.isnan(col(k))
    return df.filter(condition)


def parse_date(c: Column, strict: bool = False) -> Column:
    parsed = F.coalesce(*[F.try_to_date(c, layout) for layout in DATE_LAYOUTS])
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("no accepted date layout fits "), c)).cast("date")
    return F.when(c.isNotNull() & parsed.isNull(), problem).otherwise(parsed)


def sowing_day_of_year(month_day: Column) -> Column:
    """Day of year of an ``MM-dd`` text in a non-leap year; 02-29 has none."""
    return F.dayofyear(F.try_to_date(F.concat(F.lit("1900-"), month_day), "yyyy-MM-dd"))


def as_numeric(df: DataFrame, columns: Iterable[str], errors: str = "coerce") -> DataFrame:
    """Cast present columns to double.

    ``coerce`` turns bad values into NULL, ``raise`` fails on the first one and
    ``ignore`` leaves a column that has any bad value as it is. Only ``ignore``
    needs to look at the data (one aggregate over all columns).
    """
    if errors not in ("coerce", "raise", "ignore"):
        raise ValueError(f"errors must be coerce, raise or ignore, not {errors!r}")
    present = [c for c in columns if c in df.columns]
    if errors == "ignore":
        bad = (
            df.agg(*[
                F.count_if(col(c).isNotNull() & _to_double(df, c, "coerce").isNull()).alias(c)
                for c in present
            ]).first()
            if present
            else None
        )
        present = [c for c in present if bad[c] == 0]
    return df.withColumns({c: _to_double(df, c, errors) for c in present})


def _to_double(df: DataFrame, name: str, errors: str) -> Column:
    c = col(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return number(c)
    # The pattern keeps texts such as "1d" or "Infinity" from counting as numbers.
    parsed = F.when(c.rlike(_NUMERIC_TEXT), F.trim(c).try_cast("double"))
    if errors != "raise":
        return parsed
    problem = F.raise_error(F.concat(F.lit(f"Unable to parse {name}: "), c)).cast("double")
    return F.when(c.isNotNull() & parsed.isNull(), problem).otherwise(parsed)


def rename_variables(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def convert_units(df: DataFrame, conversions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    present = {v: f(col(v)) for v, f in conversions.items() if v in df.columns}
    return df.withColumns(present) if present else df


def kelvin_to_celsius(c: Column) -> Column:
    return c - 273.15


def flux_to_mm_per_day(c: Column) -> Column:
    """kg m-2 s-1 to mm per day."""
    return c * 86400.0


def watt_to_megajoule_per_day(c: Column) -> Column:
    """W m-2 to MJ m-2 per day."""
    return c * 0.0864


def water_productivity(yield_kg: Column, evapotranspiration_mm: Column) -> Column:
    return ratio(yield_kg, evapotranspiration_mm)


def within_box(lat: Column, lon: Column, lat_range: tuple, lon_range: tuple) -> Column:
    return lat.between(*lat_range) & lon.between(*lon_range)


def within_dates(date: Column, date_range: tuple | None) -> Column:
    if date_range is None:
        return F.lit(True)
    return date.between(F.lit(date_range[0]).cast("date"), F.lit(date_range[1]).cast("date"))


def simulation_key(*parts: Column, sowing: Column) -> Column:
    return F.concat_ws("_", *parts, F.regexp_replace(sowing, "-", ""))


def hash_number(text: Column, digits: int = 8) -> Column:
    """Integer from the leading hexadecimal digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def missing_and_extra(expected: Iterable[str], given: Iterable[str]) -> tuple[list[str], list[str]]:
    expected, given = list(expected), list(given)
    return (
        [c for c in expected if c not in given],
        [c for c in given if c not in expected],
    )
