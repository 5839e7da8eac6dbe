import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestlens import session
from harvestlens.operators import grouping, ordering
from harvestlens.operators.impacts import baseline_statistics


@pytest.fixture(scope="module")
def skewed():
    """One group with half of the rows, one value repeated very often, small groups, nulls."""
    rng = np.random.default_rng(42)
    frames = [
        pd.DataFrame({"g": "hot", "v": rng.normal(size=40_000)}),
        pd.DataFrame({"g": "same", "v": np.r_[np.full(20_000, 7.0), rng.random(500)]}),
        pd.DataFrame({"g": "one", "v": [3.5]}),
        pd.DataFrame({"g": "two", "v": [1.0, 2.0]}),
        pd.DataFrame({"g": "null", "v": [1.0, 2.0, np.nan, 4.0]}),
        pd.DataFrame({"g": "empty", "v": [np.nan, np.nan]}),
        pd.DataFrame({"g": [None], "v": [1.0]}),
    ]
    return pd.concat(frames, ignore_index=True)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def quantiles(spark, pdf, nulls):
    df = spark.createDataFrame(pdf, "g string, v double").repartition(7)
    out = grouping.group_percentiles(df, ["g"], ["v"], PROBS, nulls)
    return {r["g"]: list(r["v"]["_q"]) for r in out.collect()}


@pytest.mark.parametrize("nulls", ["propagate", "omit"])
@pytest.mark.parametrize("accuracy", [10_000, 1000, 100])
def test_percentiles_are_exact(spark, skewed, nulls, accuracy, monkeypatch):
    """Groups of all sizes take the same way, with fine and with coarse sketches."""
    monkeypatch.setattr(grouping, "ACCURACY", accuracy)
    got = quantiles(spark, skewed, nulls)
    assert set(got) == {"hot", "same", "one", "two", "null", "empty"}
    for g, found in got.items():
        v = skewed[skewed.g == g].v
        if v.notna().sum() == 0 or (nulls == "propagate" and v.isna().any()):
            assert found == [None] * len(PROBS)
        else:
            assert found == pytest.approx(list(np.quantile(v.dropna(), PROBS)), rel=1e-12)


def test_bracketing_of_a_large_group(spark):
    values = pd.DataFrame({"g": "a", "v": np.random.default_rng(1).exponential(size=300_000)})
    df = spark.createDataFrame(values, "g string, v double")
    out = grouping.group_percentiles(df, ["g"], ["v"], [0.01, 0.5, 0.999]).first()
    assert list(out["v"]["_q"]) == pytest.approx(list(np.quantile(values.v, [0.01, 0.5, 0.999])), rel=1e-12)
    assert out["v"]["_n"] == 300_000 and out["v"]["_mean"] == pytest.approx(values.v.mean())


def test_every_small_size(spark):
    """Ranks are rounded differently by the sketch: all sizes up to 120, with and without ties."""
    probabilities = [0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 0.99]
    rng = np.random.default_rng(4)
    rows = [(n, float(x), float(round(x))) for n in range(1, 121) for x in rng.normal(0, 5, n)]
    df = spark.createDataFrame(rows, "n int, v double, w double").repartition(5)
    out = {r["n"]: r for r in grouping.group_percentiles(df, ["n"], ["v", "w"], probabilities).collect()}
    for n, r in out.items():
        for i, c in ((1, "v"), (2, "w")):
            assert list(r[c]["_q"]) == pytest.approx(list(np.quantile([x[i] for x in rows if x[0] == n], probabilities)), rel=1e-12)
    assert len(out) == 120


def test_coarse_and_fine_sketches_give_the_same_statistics(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed, "g string, v double")
    fine = baseline_statistics(df, ["g"], ["v"]).orderBy("g").toPandas()
    monkeypatch.setattr(grouping, "ACCURACY", 100)
    coarse = baseline_statistics(df, ["g"], ["v"]).orderBy("g").toPandas()
    pd.testing.assert_frame_equal(fine, coarse[fine.columns])


def test_positions(spark):
    """Every kind of group at once: one of a third of the rows, one of equal rows, a null key."""
    rng = np.random.default_rng(3)
    keys = [*["hot"] * 700, *["same"] * 600, *["a", "b"] * 40, *[None] * 50]
    pdf = pd.DataFrame({"g": keys, "x": [*rng.permutation(700), *[5] * 600, *rng.permutation(80), *rng.permutation(50)]})
    pdf["w"] = rng.integers(0, 9, len(pdf))
    df = spark.createDataFrame(pdf, "g string, x long, w long").repartition(6)
    out = ordering.global_positions(df, ["g"], [F.col("x")], "pos", "n", {"before": "w"}).toPandas()
    assert list(out.columns) == ["g", "x", "w", "pos", "before", "n"]
    for g, mine in out.fillna({"g": "null"}).groupby("g"):
        mine = mine.sort_values("pos")
        assert list(mine.pos) == list(range(1, len(mine) + 1)) and set(mine.n) == {len(mine)}
        assert mine.x.is_monotonic_increasing
        assert list(mine.before) == list(mine.w.cumsum() - mine.w)


def test_pieces_stay_even(spark):
    """A third of the rows are equal: they are cut too."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"))
        sizes = [r["count"] for r in ordering.sorted_pieces(df, [F.col("x")]).groupBy("_piece").count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_split_join_keeps_all_rows(spark):
    rows = spark.range(10_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    stats = rows.groupBy("k").agg(F.avg("id").alias("m"))
    joined = grouping.split_join(rows, stats, ["k"])
    assert joined.count() == 10_000
    assert joined.columns == ["k", "id", "m"]
    assert grouping.split_join(rows.limit(0), stats, ["k"]).count() == 0


def test_only_heavy_groups_are_split_by_their_size(spark):
    """One location owns a third of the rows, all of them equal; the others are many and small."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_size"))
    assert [tuple(r) for r in grouping.heavy_groups(sizes, ["k"]).collect()] == [(-1, 34)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = sizes.select("k", F.col("_size").alias("m"))
        joined = grouping.split_join(rows, stats, ["k"], sizes=sizes)
        parts = [r["count"] for r in joined.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) >= 4 and max(parts) <= 10_000 and joined.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_table_is_spread_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    df = spark.range(5000).withColumn("g", F.lit(1))
    assert session.spread(df, 800) is df
    for keys in ((), ("id",)):
        dealt = session.spread(df, 5000, *keys)
        assert dealt.rdd.getNumPartitions() == 50 and dealt.columns == ["id", "g"]
        assert dealt.agg(F.sum("id")).first()[0] == 4999 * 2500


def test_percentiles_sort_no_rows_by_group(spark, monkeypatch):
    """All rows are counted by a hash aggregate, and the sketches are made in tasks of a bounded size."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100, raising=False)
    seen = []
    monkeypatch.setattr(grouping, "store", lambda df, purpose: seen.append((purpose, df)) or session.store(df, purpose))
    df = spark.range(5000).select((F.col("id") % 200).alias("g"), F.col("id").cast("double").alias("v"))
    out = grouping.group_percentiles(df, ["g"], ["v"], [0.5])
    plan = out._jdf.queryExecution().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "partial_count" in line]
    assert "REPARTITION_BY_NUM, " in dict(seen)["percentile-brackets"]._jdf.queryExecution().toString()
    assert {r["g"]: r["v"]["_q"][0] for r in out.collect()} == {g: g + 2400.0 for g in range(200)}
