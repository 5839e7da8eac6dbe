"""Data-quality checks whose findings are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number
from harvestlens.session import store


def _checks(df: DataFrame, required: Sequence[str], limits: Mapping[str, Mapping[str, float]]):
    """(check, variable, count expression) for everything that can be wrong."""
    found = [("missing_variable", v, F.count(F.lit(1))) for v in required if v not in df.columns]
    checked = [v for v in dict.fromkeys([*required, *limits]) if v in df.columns]
    for v in checked:
        x = number(v)
        found.append(("null", v, F.count_if(x.isNull())))
        bounds = limits.get(v, {})
        if "min" in bounds:
            found.append(("below_min", v, F.count_if(x < bounds["min"])))
        if "max" in bounds:
            found.append(("above_max", v, F.count_if(x > bounds["max"])))
    return found


def quality_report(
    df: DataFrame,
    keys: Sequence[str],
    required: Sequence[str],
    limits: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Issues as ``(keys..., check, variable, n_bad)``; groups in order have no row.

    Every check is a counter of one aggregation, unfolded afterwards.
    """
    checks = _checks(df, required, limits or {})
    if not checks:
        checks = [("none", "", F.lit(0).cast("bigint"))]
    rows = keyed(df, keys)
    counted = rows.groupBy(*keys).agg(*[c.alias(f"_c{i}") for i, (_, _, c) in enumerate(checks)])
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(variable).alias("variable"),
            F.col(f"_c{i}").cast("bigint").alias("n_bad"),
        )
        for i, (check, variable, _) in enumerate(checks)
    ]
    return (
        counted.select(*keys, F.explode(F.array(*entries)).alias("_"))
        .select(*keys, "_.*")
        .filter(F.col("n_bad") > 0)
    )


def valid_rows(df: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the groups without any issue."""
    return keyed(df, keys).join(report.select(*keys).distinct(), list(keys), "left_anti")


def rejected_rows(df: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(report.select(*keys).distinct(), list(keys), "left_semi")


@dataclass(frozen=True)
class Gate:
    """The checked table, stored, its findings, and its rows and rows with a null, counted while it was written."""

    rows: DataFrame
    report: DataFrame
    keys: tuple[str, ...]
    n_rows: int
    n_null: int

    @property
    def accepted(self) -> DataFrame:
        return valid_rows(self.rows, self.report, self.keys)

    @property
    def rejected(self) -> DataFrame:
        return rejected_rows(self.rows, self.report, self.keys)


def gate(
    df: DataFrame,
    keys: Sequence[str],
    required: Sequence[str],
    limits: Mapping[str, Mapping[str, float]] | None = None,
) -> Gate:
    """Check a table that is made once: it is stored, and findings and both kinds of rows are read from there."""
    missing = F.lit(False)
    for v in required:
        if v in df.columns:
            missing = missing | number(v).isNull()
    seen = Observation()
    rows = store(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_null")), "checked-rows")
    report = store(quality_report(rows, keys, required, limits), "quality-report")
    return Gate(rows, report, tuple(keys), int(seen.get["n_rows"]), int(seen.get["n_null"]))


def undefined_values(used: DataFrame, defined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values in use without a definition, with their row counts."""
    counts = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(defined.select(*keys).distinct(), list(keys), "left_anti")


def missing_inputs(expected: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations without data, as set-up errors."""
    absent = expected.join(available.select(*keys).distinct(), list(keys), "left_anti")
    message = F.concat(F.lit("No climate data for "), F.concat_ws(", ", *[col(k).cast("string") for k in keys]))
    return absent.withColumns({"status": F.lit("SETUP_ERROR"), "message": message})


def require_rows(df: DataFrame, name: str = "DataFrame") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_null)`` of all columns from one aggregate."""
    wide = df.agg(*[F.count_if(number(c).isNull()).alias(f"_c{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("n_null"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("_")).select("_.*")


def check_periods(periods: Mapping[str, Sequence]) -> list[str]:
    """Problems of a configured period table (a handful of entries)."""
    problems = []
    for name, span in periods.items():
        if not isinstance(span, (list, tuple)) or len(span) != 2:
            problems.append(f"{name}: needs a start and an end date")
            continue
        try:
            start, end = (
                d if isinstance(d, date) else datetime.strptime(d, "%Y-%m-%d").date() for d in span
            )
        except (TypeError, ValueError):
            problems.append(f"{name}: dates must read YYYY-MM-DD")
            continue
        if start >= end:
            problems.append(f"{name}: start must come before end")
    return problems


def check_names(names: Sequence[str], known: Sequence[str], what: str) -> list[str]:
    return [f"unknown {what}: {n}" for n in names if n not in known]
