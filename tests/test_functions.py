import math
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestlens.functions import columns as fc
from harvestlens.functions import significance, weather
from harvestlens.functions import status as st


def values(df):
    return [r[0] for r in df.collect()]


def test_date_layouts(spark):
    texts = ["2024-01-05", "20240105", "05-01-2024", "05/01/2024", "2024/01/05", "2024-1-5", "5 Jan", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert values(df.select(fc.parse_date(F.col("s")))) == [date(2024, 1, 5)] * 6 + [None, None]


def test_strict_date_raises(spark):
    df = spark.createDataFrame([("5 Jan",)], "s string")
    with pytest.raises(PySparkException):
        df.select(fc.parse_date(F.col("s"), strict=True)).collect()


def test_sowing_day(spark):
    df = spark.createDataFrame([("06-15",), ("01-01",), ("02-29",), ("x",)], "s string")
    assert values(df.select(fc.sowing_day_of_year(F.col("s")))) == [166, 1, None, None]


def test_numeric_modes(spark):
    df = spark.createDataFrame([("1.5", "7"), ("invalid", "8"), (None, " 9 ")], "a string, b string")
    assert [tuple(r) for r in fc.as_numeric(df, ["a", "b", "c"]).collect()] == [(1.5, 7.0), (None, 8.0), (None, 9.0)]
    left = fc.as_numeric(df, ["a", "b"], "ignore")
    assert dict(left.dtypes) == {"a": "string", "b": "double"}
    with pytest.raises(PySparkException):
        fc.as_numeric(df, ["a"], "raise").collect()
    with pytest.raises(ValueError):
        fc.as_numeric(df, ["a"], "other")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="period"):
        fc.require_columns(spark.range(1), ["id", "period"], "results")


def test_ratio_and_change_by_zero(spark):
    df = spark.createDataFrame([(5.0, 0.0), (6.0, 4.0), (float("nan"), 4.0)], "f double, b double")
    assert values(df.select(fc.relative_change(fc.number("f"), fc.number("b")))) == [None, 50.0, None]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double").toDF("Maize.AboveGround.Wt", "masec(n)")
    assert df.select(fc.col("Maize.AboveGround.Wt") + fc.col("masec(n)")).first()[0] == 3.0


def test_units(spark):
    df = spark.createDataFrame([(300.0, 1e-5, 100.0)], "t double, p double, r double")
    row = fc.convert_units(
        df,
        {
            "t": fc.kelvin_to_celsius,
            "p": fc.flux_to_mm_per_day,
            "r": fc.watt_to_megajoule_per_day,
            "absent": fc.kelvin_to_celsius,
        },
    ).first()
    assert row == pytest.approx((26.85, 0.864, 8.64))


def test_simulation_key_skips_nothing(spark):
    df = spark.createDataFrame([("loc", "DSSAT", "06-15")], "l string, m string, s string")
    key = fc.simulation_key(F.col("l"), F.col("m"), sowing=F.col("s"))
    assert values(df.select(key)) == ["loc_DSSAT_0615"]


def test_status_predicates(spark):
    df = spark.createDataFrame([(s,) for s in [*st.STATUS_DESCRIPTIONS, "FAILED"]], "s string")
    s = F.col("s")
    rows = {
        r[0]: r[1:]
        for r in df.select(
            s, st.is_error(s), st.is_final(s), st.is_success(s), st.is_runnable(s), st.description(s)
        ).collect()
    }
    assert rows["MISSING_FILES"][:2] == (False, True)
    assert rows["TIMEOUT"][:2] == (True, True)
    assert rows["OUTPUT_PARSED"][2] and not rows["RUNNING"][1]
    assert [k for k, v in rows.items() if v[3]] == ["READY_TO_RUN"]
    assert sorted(k for k, v in rows.items() if v[0]) == sorted(st.ERRORS)
    assert sorted(k for k, v in rows.items() if v[1]) == sorted(st.FINAL)
    assert rows["FAILED"] == (False, False, False, False, None)


def p_values(spark, pairs):
    df = spark.createDataFrame([(i, float(t), float(n)) for i, (t, n) in enumerate(pairs)], "i int, t double, n double")
    out = significance.add_student_two_sided(df, "t", "n", "p").orderBy("i")
    return [r["p"] for r in out.collect()]


def test_student_table(spark):
    pairs = [(2.228139, 10), (12.7062, 1), (2.570582, 5), (3.182446, 3), (4.302653, 2), (-2.228139, 10)]
    assert p_values(spark, pairs) == pytest.approx([0.05] * 6, abs=1e-6)


def student_by_integration(t, n):
    """Two-sided tail by Simpson's rule on the density."""
    x = np.linspace(0, abs(t), 200_001)
    log_c = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi)
    y = np.exp(log_c - (n + 1) / 2 * np.log1p(x * x / n))
    h = x[1] - x[0]
    return 1 - 2 * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_student_against_integration(spark):
    pairs = [(t, n) for t in (0.3, 1.0, 2.0, 3.5, 5.0) for n in (1, 2, 7, 30, 301, 2000, 2001, 50_000)]
    want = [student_by_integration(t, n) for t, n in pairs]
    assert p_values(spark, pairs) == pytest.approx(want, abs=1e-9)


def test_student_far_tail_and_huge_samples(spark):
    got = p_values(spark, [(10.0, 10**9), (1.959963985, 10**11), (0.0, 10**9), (0.0, 4)])
    assert got == pytest.approx([1.5239706e-23, 0.05, 1.0, 1.0], rel=1e-6)


def test_extraterrestrial_radiation_published_example(spark):
    # FAO-56 example 8: 20 degrees south, 3 September, 32.2 MJ
    df = spark.createDataFrame([(date(2023, 9, 3), -20.0)], "d date, lat double")
    assert df.select(weather.extraterrestrial_radiation(F.col("d"), F.col("lat"))).first()[0] == pytest.approx(32.2, abs=0.1)


def test_derived_variables(spark):
    df = spark.createDataFrame(
        [(date(2023, 9, 3), -20.0, 30.0, 20.0), (date(2023, 9, 3), 80.0, 10.0, 12.0), (date(2023, 9, 3), 0.0, None, 1.0)],
        "date date, lat double, tasmax double, tasmin double",
    )
    rows = weather.add_derived_variables(df).collect()
    assert rows[0]["rsds"] == pytest.approx(0.16 * math.sqrt(10) * 32.2, abs=0.1)
    assert rows[1]["rsds"] == 0.0
    assert rows[2]["rsds"] is None and rows[2]["et0"] is None
    assert "et0" not in weather.add_derived_variables(df, ["rsds"]).columns
    kept = weather.add_derived_variables(df.withColumn("rsds", F.lit(1.0)), ["rsds"])
    assert values(kept.select("rsds")) == [1.0] * 3
