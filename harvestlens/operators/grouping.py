"""Building blocks that stay safe when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number
from harvestlens.session import spread, store

HEAVY = 0.01  # share of all rows above which a group is split, by its own size
# Quantile sketches bracket a rank to within 1 / ACCURACY of a group, at any size.
ACCURACY = 10_000


def heavy_groups(sizes: DataFrame, keys: Sequence[str], share: float = HEAVY) -> DataFrame:
    """``keys, _parts`` of the groups with more than ``share`` of all rows: 1 / ``share`` rows at most.

    ``sizes`` has ``keys`` and ``_size``. A group gets as many parts as it holds such shares.
    """
    fair = sizes.agg((F.sum("_size") * share).alias("_fair")).select("_fair").scalar()
    found = sizes.filter(F.col("_size") > fair)
    return found.select(*keys, F.ceil(F.col("_size") / fair).cast("int").alias("_parts"))


def split_join(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    sizes: DataFrame | None = None,
    share: float = HEAVY,
) -> DataFrame:
    """Join per-group figures back to the rows of the groups, heavy groups in parts.

    A following aggregation on the same keys would normally reuse the join's partitioning
    and put a hot group into one task. Groups that hold more than ``share`` of the rows, a bounded
    number of them, are cut into parts by their own size; only their figures are repeated, once a
    part. Equal rows go to the parts by the partition they come from. ``sizes`` (``keys,
    _size``) saves counting the rows; both it and ``side`` are read twice, so they should come from
    storage or be small. Small figures are broadcast by Spark as usual.
    """
    keys = list(keys)
    if sizes is None:
        sizes = store(keyed(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), "group-sizes")
    heavy = F.broadcast(heavy_groups(sizes, keys, share))  # 1 / share rows at most
    parts = F.coalesce("_parts", F.lit(1))
    spread = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    part = F.pmod(F.xxhash64(*[col(c) for c in spread], F.spark_partition_id()), parts).cast("int")
    marked = rows.join(heavy, keys, "left").withColumn("_part", part).drop("_parts")
    repeated = side.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return marked.join(repeated, [*keys, "_part"], how).drop("_part")


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value_cols: Sequence[str],
    probabilities: Sequence[float],
    nulls: str = "propagate",
) -> DataFrame:
    """One row per group with a struct ``_n, _rows, _mean, _std, _q`` for each variable; ``_q`` has exact percentiles.

    One way for groups of any size. The narrow rows are stored and read twice:

    1. Counts, moments and a quantile sketch of rank error 1 / ``ACCURACY`` per group, combined on
       the map side. For each probability two values of the sketch bracket the order statistics
       wanted.
    2. Against these brackets the rows are counted: below a bracket, with the value next to it on
       either side, in one wide aggregate; inside, about 8 / ``ACCURACY`` of a group, by value. Only
       such counts are shuffled. Running sums over the few values inside find the order
       statistics. In small groups, where the sketch is exact but its rank rounded, a
       wanted value may be the one next to the bracket. A rank that was missed would raise.
    """
    if nulls not in ("propagate", "omit"):
        raise ValueError(f"nulls must be propagate or omit, not {nulls!r}")
    keys, values = list(keys), list(value_cols)
    rows = store(keyed(df, keys).select(*keys, *[number(v).alias(v) for v in values]), "percentile-rows")
    slack = 4.0 / ACCURACY
    ends = [e for p in probabilities for e in (max(0.0, p - slack), min(1.0, p + slack))]
    facts = ["_n", "_rows", "_mean", "_std"]

    def summary(v: str) -> list[Column]:
        x = col(v)
        return [
            F.struct(
                F.count(x).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std")
            ).alias(f"_f_{v}"),
            F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile_approx(x, ends, ACCURACY).alias("e")).alias(f"_b_{v}"),
        ]

    # with many groups Spark sorts a task's rows to build the sketches
    plan = spread(rows, rows.count()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *[s for v in values for s in summary(v)])
    plan = store(plan, "percentile-brackets")
    placed = split_join(rows, plan.drop("_size"), keys, sizes=plan.select(*keys, "_size"))
    slots = []  # (variable, value, lower end, upper end, probability)
    for v in values:
        b = f"_b_{v}"
        for i, p in enumerate(probabilities):
            lo = col(b)["lo"] if p <= slack else col(b)["e"][2 * i]
            hi = col(b)["hi"] if p >= 1 - slack else col(b)["e"][2 * i + 1]
            slots.append((v, col(v), lo, hi, float(p)))
    around = []
    for _, x, lo, hi, _ in slots:
        around.append(F.struct(F.count_if(x < lo).alias("below"), F.max(F.when(x < lo, x)).alias("before"), F.min(F.when(x > hi, x)).alias("after")))
    # only numbers are summed up here: with a struct among them Spark would sort all rows by group
    side = placed.groupBy(*keys).agg(*[a.alias(f"_a{i}") for i, a in enumerate(around)])
    side = side.join(plan.select(*keys, *[f"_f_{v}" for v in values]), keys).select(*keys, *[f"_f_{v}" for v in values], F.array(*[f"_a{i}" for i in range(len(slots))]).alias("_around"))
    hits = [F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("_i"), x.alias("_w"))) for i, (_, x, lo, hi, _) in enumerate(slots)]
    inside = placed.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("_h")).select(*keys, "_h.*")
    inside = inside.groupBy(*keys, "_i", "_w").agg(F.count(F.lit(1)).alias("_c"))
    met = side.join(inside, keys, "left")
    running = Window.partitionBy(*keys, "_i").orderBy("_w").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.array(*[col(f"_f_{v}")["_n"] for v, *_ in slots])
    position = (F.get(counts, F.col("_i")) - 1) * F.get(F.array(*[F.lit(p) for *_, p in slots]), F.col("_i"))
    met = met.withColumns(
        {
            "_near": F.get("_around", F.col("_i")),
            "_rank": F.floor(position),
            "_frac": position - F.floor(position),
            "_upto": F.sum("_c").over(running),
        }
    ).withColumn("_upto", F.col("_upto") + F.col("_near.below"))
    first = [F.first(c).alias(c) for c in (*[f"_f_{v}" for v in values], "_near", "_rank", "_frac")]
    found = met.groupBy(*keys, "_i").agg(
        F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_w"))).alias("_low"),
        F.min(F.when(F.col("_upto") > F.col("_rank") + 1, F.col("_w"))).alias("_high"),
        F.max("_upto").alias("_reach"),
        *first,
    )

    def statistic(rank: Column, held: Column) -> Column:
        missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
        below, reach = F.col("_near.below"), F.col("_reach")
        return (
            F.when(rank == below - 1, F.col("_near.before"))
            .when(rank == reach, F.col("_near.after"))
            .when((rank < below) | (rank > reach), missed)
            .otherwise(held)
        )

    low, high = statistic(F.col("_rank"), F.col("_low")), statistic(F.col("_rank") + 1, F.col("_high"))
    blend = F.when(F.col("_frac") > 0, (1 - F.col("_frac")) * low + F.col("_frac") * high).otherwise(low)
    found = found.withColumn("_x", F.when(F.col("_i").isNotNull(), blend))
    wide = found.groupBy(*keys).agg(
        *[F.first(f"_f_{v}").alias(f"_f_{v}") for v in values],
        *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"_q{i}") for i in range(len(slots))],
    )
    out = []
    for k, v in enumerate(values):
        f = col(f"_f_{v}")
        mine = range(k * len(probabilities), (k + 1) * len(probabilities))
        q = [F.col(f"_q{i}") if nulls == "omit" else F.when(f["_n"] == f["_rows"], F.col(f"_q{i}")) for i in mine]
        out.append(F.struct(*[f[n].alias(n) for n in facts], F.array(*q).alias("_q")).alias(v))
    return wide.select(*keys, *out)
