"""Two-sample t-test on aggregated moments, as plain columns.

Spark has no Student distribution. P(|T| > |t|) is a regularized incomplete beta function;
its continued fraction (Abramowitz and Stegun 26.5.8) is evaluated from the inside out at a
fixed depth, in the one of its two mirrored forms that converges for the value of t. One
formula and one cost, whatever the degrees of freedom.

Each step is a column of its own: an expression used in several places would
otherwise be repeated in all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEPTH = 100
_SHIFT = 16


def _log_gamma_ratio(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)): shifted upwards by a fixed number of steps, then its asymptotic series."""
    shifted = F.aggregate(
        F.sequence(F.lit(0), F.lit(_SHIFT - 1)),
        F.lit(0.0),
        lambda acc, k: acc + F.log((a + k) / (a + k + 0.5)),
    )
    z = a + _SHIFT
    terms = (-1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)
    series = F.lit(0.0)
    for c in reversed(terms):
        series = (series + c) / z
    return shifted + 0.5 * F.log(z) + F.log1p(series)


def _fraction(p: Column, q: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, without its leading factor."""

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd) / (1 + acc)

    return F.aggregate(
        F.sequence(F.lit(_DEPTH), F.lit(1), F.lit(-1)), F.lit(0.0), step, lambda acc: 1 / (1 + acc)
    )


def add_student_two_sided(df: DataFrame, t: str, dof: str, name: str) -> DataFrame:
    """Add P(|T| > |t|) for columns of statistics and degrees of freedom (1 or more, else NULL)."""
    v, t2 = F.col("_v"), F.col("_t2")
    staged = df.withColumns(
        {"_v": F.when(F.col(dof) >= 1, F.col(dof).cast("double")), "_t2": (F.col(t) * F.col(t)).cast("double")}
    )
    staged = staged.withColumns(
        {
            # the central form converges where t is small against the freedom and in itself
            "_central": (t2 < v) & (t2 < 20),
            "_factor": F.exp(
                -(v / 2) * F.log1p(t2 / v)
                + 0.5 * F.log(t2 / (v + t2))
                - 0.5 * math.log(math.pi)
                + _log_gamma_ratio(v / 2)
            ),
        }
    )
    central = F.col("_central")
    staged = staged.withColumns(
        {
            "_p": F.when(central, 0.5).otherwise(v / 2),
            "_q": F.when(central, v / 2).otherwise(0.5),
            "_x": F.when(central, t2 / (v + t2)).otherwise(v / (v + t2)),
        }
    )
    staged = staged.withColumn("_beta", F.col("_factor") / F.col("_p") * _fraction(F.col("_p"), F.col("_q"), F.col("_x")))
    tail = F.when(central, 1 - F.col("_beta")).otherwise(F.col("_beta"))
    p = F.when(v.isNotNull() & (t2 == 0), 1.0).otherwise(F.greatest(F.lit(0.0), tail))
    p = F.when(v.isNotNull() & t2.isNotNull(), p)
    return staged.withColumn(name, p).drop("_v", "_t2", "_central", "_factor", "_p", "_q", "_x", "_beta")


def add_t_test(df: DataFrame, a: str, b: str, name: str = "p_value") -> DataFrame:
    """Two-sided p of Student's t with pooled variance.

    ``a`` and ``b`` are struct columns ``(rows, n, mean, var)``. A null in a sample
    leaves p NULL; two constant samples that differ have p = 0.
    """
    a, b = F.col(a), F.col(b)
    dof = a["n"] + b["n"] - 2
    pooled = F.try_divide((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"], dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), a["n"]) + F.try_divide(F.lit(1.0), b["n"])))
    complete = (a["n"] == a["rows"]) & (b["n"] == b["rows"])
    staged = df.withColumns(
        {
            "_t": F.when(complete, F.try_divide(a["mean"] - b["mean"], error)),
            "_dof": dof,
            "_constant": complete & (a["var"] == 0) & (b["var"] == 0) & (a["mean"] != b["mean"]),
        }
    )
    tested = add_student_two_sided(staged, "_t", "_dof", "_tail")
    return tested.withColumn(
        name, F.when(F.col("_constant"), F.lit(0.0)).otherwise(F.col("_tail"))
    ).drop("_t", "_dof", "_constant", "_tail")
