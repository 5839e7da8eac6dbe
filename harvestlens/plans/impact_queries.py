"""Impacts, ensembles, regions and adaptation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.significance import add_t_test
from harvestlens.operators import adaptation as ad
from harvestlens.operators import figures, impacts, regions, scenario
from harvestlens.plans.registry import query
from harvestlens.plans.testbed import KEYS, SIM, VALUES, points, r, sim_results, table, tidy

_K = ", ".join(KEYS)


def _impact_sql(keys: str, extra: str, values: list[str], where: str = "true", source: str = "sim") -> str:
    """CTE body with the impacts, not rounded."""
    level = f"{keys}, {extra}period" if extra else f"{keys}, period"
    means = ", ".join(f"avg({v}) as {v}" for v in values)
    out = []
    for v in values:
        out += [
            f"f.{v} as {v}_future",
            f"b.{v} as {v}_baseline",
            f"f.{v} - b.{v} as {v}_abs_change",
            f"(f.{v} - b.{v}) / nullif(b.{v}, 0) * 100 as {v}_rel_change",
        ]
    return f"""select {', '.join('f.' + k.strip() for k in level.split(','))}, {', '.join(out)}
 from (select {level}, {means} from {source} where period <> 'historical' and {where} group by all) f
 join (select {keys}, {means} from {source} where period = 'historical' group by all) b
 using ({keys})"""


def _rounded(columns: list[str]) -> str:
    return ", ".join(r(c, c) for c in columns)


_CHANGES = [
    f"{v}_{side}" for v in VALUES for side in ("future", "baseline", "abs_change", "rel_change")
]


def all_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.climate_impacts(
        sim_results(spark, sf_dir), KEYS, VALUES, future_keys=["scenario"]
    )


_IMPACTS = f"{SIM}, impacts as ({_impact_sql(_K, 'scenario, ', VALUES)})"


@query(
    "impacts_all_periods",
    f"with {_IMPACTS} select {_K}, scenario, period, {_rounded(_CHANGES)} from impacts",
)
def impacts_all_periods(spark, sf_dir):
    return tidy(all_impacts(spark, sf_dir))


@query(
    "impacts_reference_keys",
    f"with {SIM}, i as ({_impact_sql(_K, '', VALUES)}) select {_K}, period, {_rounded(_CHANGES)} "
    "from i where period = 'near_future'",
)
def impacts_reference_keys(spark, sf_dir):
    sim = sim_results(spark, sf_dir)
    return tidy(impacts.climate_impacts(sim, KEYS, VALUES, periods=["near_future"]))


@query(
    "impacts_two_tables",
    f"with {SIM}, i as ({_impact_sql(_K, '', VALUES)}) select {_K}, {_rounded(_CHANGES)} "
    "from i where period = 'far_future'",
)
def impacts_two_tables(spark, sf_dir):
    sim = sim_results(spark, sf_dir)
    future = scenario.one_period(sim, "far_future")
    baseline = scenario.one_period(sim, "historical")
    return tidy(impacts.impacts_between(future, baseline, VALUES, KEYS))


_BASE_FIGURES = []
for _v in VALUES:
    _BASE_FIGURES += [
        r(f"avg({_v})", f"{_v}_mean"),
        r(f"stddev_samp({_v})", f"{_v}_std"),
        r(f"stddev_samp({_v}) / nullif(avg({_v}), 0)", f"{_v}_cv"),
        *[r(f"quantile_cont({_v}, {p / 100})", f"{_v}_p{p}") for p in impacts.PERCENTILES],
    ]


@query(
    "baseline_statistics",
    f"with {SIM} select {_K}, {', '.join(_BASE_FIGURES)} from sim where period = 'historical' group by all",
)
def baseline_statistics(spark, sf_dir):
    base = scenario.one_period(sim_results(spark, sf_dir), "historical")
    return tidy(impacts.baseline_statistics(base, KEYS, VALUES))


@query(
    "baseline_statistics_large_groups",
    f"with {SIM} select climate_source, {', '.join(_BASE_FIGURES)} from sim "
    "where period = 'historical' group by all",
)
def baseline_statistics_large_groups(spark, sf_dir):
    """Few, large groups."""
    base = scenario.one_period(sim_results(spark, sf_dir), "historical")
    return tidy(impacts.baseline_statistics(base, ["climate_source"], VALUES))


_ENS_KEYS = "location_id, scenario, period"
_ENS = ["yield_kg_rel_change", "etc_mm_rel_change"]
_CHANGED = [f"{v}_{kind}_change" for v in VALUES for kind in ("abs", "rel")]


def _ensemble_sql(source: str, keys: str, values: list[str], model: str) -> str:
    k = keys
    means = ", ".join(f"avg({v}) over (partition by {k}) as m{i}" for i, v in enumerate(values))
    cols = []
    for i, v in enumerate(values):
        share = f"count(*) filter ({v} > m{i}) / count(*)::double"
        cols += [
            r(f"avg({v})", f"{v}_mean"),
            r(f"stddev_samp({v})", f"{v}_std"),
            r(f"min({v})", f"{v}_min"),
            r(f"max({v})", f"{v}_max"),
            r(share, f"{v}_agreement"),
            f'{share} > 0.75 as "{v}_high_agreement"',
        ]
    return (
        f"select {k}, {', '.join(cols)}, count({model}) as n_models "
        f"from (select *, {means} from {source}) group by {k}"
    )


def _ensemble(spark, sf_dir):
    return impacts.ensemble_statistics(
        all_impacts(spark, sf_dir), _ENS_KEYS.split(", "), _ENS, "climate_model"
    )


@query(
    "ensemble_statistics",
    f"with {_IMPACTS} {_ensemble_sql('impacts', _ENS_KEYS, _ENS, 'climate_model')}",
)
def ensemble_statistics(spark, sf_dir):
    return tidy(_ensemble(spark, sf_dir))


_CROP_KEYS = ["location_id", "climate_source", "crop_model"]


@query(
    "ensemble_of_crop_models",
    f"with {SIM}, impacts as ({_impact_sql(', '.join(_CROP_KEYS), 'scenario, ', VALUES)}) "
    f"{_ensemble_sql('impacts', _ENS_KEYS, _CHANGED, 'crop_model')}",
)
def ensemble_of_crop_models(spark, sf_dir):
    """The members are crop models, the usual case, and all variables are taken."""
    changes = impacts.climate_impacts(sim_results(spark, sf_dir), _CROP_KEYS, VALUES, future_keys=["scenario"])
    return tidy(impacts.ensemble_statistics(changes, _ENS_KEYS.split(", "), _CHANGED))


@query(
    "direction_agreement",
    f"with {_IMPACTS} select {_ENS_KEYS}, "
    + ", ".join(
        r(
            f"100 * greatest(count(*) filter ({v} > 0), count(*) filter ({v} < 0)) / "
            f"nullif(count({v}), 0)::double",
            f"{v}_agreement_direction",
        )
        for v in _ENS
    )
    + " from impacts group by all",
)
def direction_agreement(spark, sf_dir):
    changes = all_impacts(spark, sf_dir)
    return tidy(impacts.direction_agreement(changes, _ENS_KEYS.split(", "), _ENS))


@query(
    "impact_quantiles",
    f"with {_IMPACTS} select location_id, period, "
    + ", ".join(
        r(f"quantile_cont({v}_abs_change, {q})", f"{v}_change_q{round(q * 100)}")
        for v in ("yield_kg", "etc_mm")
        for q in (0.1, 0.9)
    )
    + " from impacts group by all",
)
def impact_quantiles(spark, sf_dir):
    return tidy(
        impacts.change_quantiles(
            all_impacts(spark, sf_dir),
            ["location_id", "period"],
            {v: f"{v}_abs_change" for v in ("yield_kg", "etc_mm")},
        )
    )


@query(
    "boxplot_summary",
    f"""with {_IMPACTS}, q as (select scenario, period, quantile_cont(yield_kg_rel_change, 0.25) as q1,
 quantile_cont(yield_kg_rel_change, 0.5) as q2, quantile_cont(yield_kg_rel_change, 0.75) as q3
 from impacts group by all),
 x as (select scenario, period, q1, q2, q3, yield_kg_rel_change as v,
 v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
 from impacts join q using (scenario, period) where yield_kg_rel_change is not null)
 select scenario, period, count(*) as n, {r('any_value(q1)', 'q1')}, {r('any_value(q2)', 'median')},
 {r('any_value(q3)', 'q3')}, {r('min(v) filter (inside)', 'whisker_low')},
 {r('max(v) filter (inside)', 'whisker_high')}, count(*) filter (not inside) as n_outliers
 from x group by scenario, period""",
)
def boxplot_summary(spark, sf_dir):
    return tidy(
        figures.boxplot_summary(all_impacts(spark, sf_dir), ["scenario", "period"], "yield_kg_rel_change")
    )


@query(
    "region_mean",
    f"with {SIM} select region_id, scenario, period, "
    + ", ".join(r(f"avg({v})", f"{v}_mean") for v in VALUES)
    + " from sim group by all",
)
def region_mean(spark, sf_dir):
    sim = sim_results(spark, sf_dir).drop("region_id")
    return tidy(
        regions.region_means(sim, _region_map(spark, sf_dir), VALUES, keys=["scenario", "period"], suffix="_mean")
    )


def _region_map(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("location_id"),
        F.col("n_regionkey").cast("string").alias("region_id"),
    )


def _weights(spark, sf_dir):
    """Weight of a location: its number of suppliers, none for locations without."""
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").cast("string").alias("location_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


_WEIGHTED = f"""with {SIM}, weight as (select s_nationkey::varchar as location_id,
 count(*)::double as w from supplier group by all),
 x as (select * from sim left join weight using (location_id))"""


@query(
    "region_weighted_sum",
    f"{_WEIGHTED} select region_id, period, "
    + ", ".join(r(f"coalesce(sum(w * {v}), 0)", v) for v in VALUES)
    + " from x group by all",
)
def region_weighted_sum(spark, sf_dir):
    sim = sim_results(spark, sf_dir).drop("region_id")
    return tidy(
        regions.region_weighted(
            sim, _region_map(spark, sf_dir), _weights(spark, sf_dir), VALUES, "sum", keys=["period"]
        )
    )


@query(
    "region_weighted_mean",
    f"{_WEIGHTED} select region_id, period, "
    + ", ".join(
        r(f"sum(w * {v}) / nullif(sum(w) filter ({v} is not null), 0)", v) for v in VALUES
    )
    + " from x group by all",
)
def region_weighted_mean(spark, sf_dir):
    sim = sim_results(spark, sf_dir).drop("region_id")
    return tidy(
        regions.region_weighted(
            sim, _region_map(spark, sf_dir), _weights(spark, sf_dir), VALUES, "mean", keys=["period"]
        )
    )


@query(
    "region_ensemble",
    f"""with {_IMPACTS}, e as (select {_ENS_KEYS}, {', '.join(f'avg({v}) as {v}_mean' for v in _ENS)}
 from impacts group by all) select n_regionkey::varchar as region_id, scenario, period,
 {', '.join(r(f'avg({v}_mean)', f'{v}_mean') for v in _ENS)}
 from e join nation on location_id = n_nationkey::varchar group by all""",
)
def region_ensemble(spark, sf_dir):
    """Regional means of the ensemble means."""
    return tidy(
        regions.region_means(
            _ensemble(spark, sf_dir),
            _region_map(spark, sf_dir),
            [f"{v}_mean" for v in _ENS],
            keys=["scenario", "period"],
        )
    )


@query(
    "map_layer",
    f"""with {_IMPACTS}, e as ({_ensemble_sql('impacts', _ENS_KEYS, _ENS, 'climate_model')}),
 loc as (select s_suppkey % 40 as k, (s_suppkey % 40)::varchar as location_id,
 min((s_suppkey * 37 % 1400) / 100.0::double) as lat, min((s_suppkey * 53 % 900) / 100.0::double) as lon
 from supplier group by all)
 select loc.location_id, {r('lat', 'lat')}, {r('lon', 'lon')}, e.scenario, e.period,
 e.yield_kg_rel_change_mean, e.yield_kg_rel_change_high_agreement
 from loc left join e using (location_id)""",
)
def map_layer(spark, sf_dir):
    locations = (
        points(spark, sf_dir)
        .groupBy((F.col("location_id") % 40).cast("string").alias("location_id"))
        .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    )
    layer = _ensemble(spark, sf_dir).select(
        "location_id", "scenario", "period", "yield_kg_rel_change_mean", "yield_kg_rel_change_high_agreement"
    )
    return tidy(figures.map_layer(locations, layer))


# --- adaptation -------------------------------------------------------------

_AD_KEYS = ["location_id", "climate_model", "scenario", "period"]
_AD_VARS = ["yield_kg", "etc_mm"]


def _adaptation_impacts(spark, sf_dir):
    return impacts.climate_impacts(
        sim_results(spark, sf_dir),
        ["location_id", "climate_model", "adaptation"],
        _AD_VARS,
        future_keys=["scenario"],
    )


def _effectiveness(spark, sf_dir, by=()):
    changes = _adaptation_impacts(spark, sf_dir)
    return ad.effectiveness_of_impacts(changes, _AD_VARS, _AD_KEYS, by)


def _effectiveness_by_join(spark, sf_dir):
    changes = _adaptation_impacts(spark, sf_dir)
    adapted = scenario.without_baseline(changes).select(
        *_AD_KEYS, "adaptation", *[F.col(f"{v}_abs_change").alias(v) for v in _AD_VARS]
    )
    baseline = changes.filter(F.col("adaptation") == "baseline")
    return ad.adaptation_effectiveness(adapted, baseline, _AD_VARS, _AD_KEYS)


def _effectiveness_ctes(by: list[str]) -> str:
    """SQL of effectiveness and t-test up to CTE ``eff``; p by the finite series."""
    g = ", ".join([*by, "adaptation", "variable"])
    pairs = " union all ".join(
        f"select {', '.join('a.' + k for k in [*by, 'adaptation'])}, '{v}' as variable, "
        f"a.{v}_abs_change as a, b.{v}_abs_change as b from ch a join ch b using ({', '.join(_AD_KEYS)}) "
        "where a.adaptation <> 'baseline' and b.adaptation = 'baseline'"
        for v in _AD_VARS
    )
    using = f"using ({g})"
    return f"""{SIM}, ch as ({_impact_sql('location_id, climate_model, adaptation', 'scenario, ', _AD_VARS)}),
 pairs as ({pairs}),
 agg as (select {g}, count(*) as n, count(a) as na, count(b) as nb, avg(a) as ma, avg(b) as mb,
  var_samp(a) as va, var_samp(b) as vb, stddev_samp(b) as sb from pairs group by all),
 tt as (select *, na + nb - 2 as df, (ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb)
  / nullif(na + nb - 2, 0) * (1.0 / na + 1.0 / nb)), 0) as t from agg where na = n and nb = n and n > 1),
 term as (select {g}, k, case when k = 0 then case when df % 2 = 0 then 0 else 0.5 * ln(df / (df + t * t)) end
  else ln(case when df % 2 = 0 then (2 * k - 1) / (2.0 * k) else 2 * k / (2.0 * k + 1) end * df / (df + t * t)) end as lt
  from (select *, unnest(generate_series(0, case when df % 2 = 0 then (df - 2) // 2 else (df - 3) // 2 end)) as k
  from tt where df >= 2 and t is not null)),
 series as (select {g}, sum(e) as s from (select {g}, exp(sum(lt) over (partition by {g} order by k)) as e from term)
  group by all),
 pv as (select {g}, case when df = 1 then 1 - 2 * atan(abs(t)) / pi()
  when df % 2 = 0 then 1 - sin(atan(abs(t) / sqrt(df))) * s
  else 1 - 2 / pi() * (atan(abs(t) / sqrt(df)) + sin(atan(abs(t) / sqrt(df))) * s) end as p
  from tt left join series {using} where t is not null),
 eff as (select {g}, mb - ma as mean_impact_reduction, sb as impact_reduction_std,
  (ma - mb) / nullif(abs(mb), 0) * 100 as relative_effectiveness, case when p is not null then greatest(p, 0) end as p_value,
  coalesce(p < 0.05, false) as significant from agg left join pv {using})"""


_EFF_COLS = ["mean_impact_reduction", "impact_reduction_std", "relative_effectiveness", "p_value"]


@query(
    "adaptation_effectiveness",
    f"with {_effectiveness_ctes([])} select adaptation, variable, {_rounded(_EFF_COLS)}, significant from eff",
)
def adaptation_effectiveness(spark, sf_dir):
    return tidy(_effectiveness(spark, sf_dir))


@query(
    "adaptation_effectiveness_by_join",
    f"with {_effectiveness_ctes([])} select adaptation, variable, {_rounded(_EFF_COLS)}, significant from eff",
)
def adaptation_effectiveness_by_join(spark, sf_dir):
    """Adapted results and baseline impacts given as two tables."""
    return tidy(_effectiveness_by_join(spark, sf_dir))


@query(
    "adaptation_effectiveness_by_member",
    f"with {_effectiveness_ctes(['location_id', 'climate_model'])} select location_id, climate_model, "
    f"adaptation, variable, {_rounded(_EFF_COLS)}, significant from eff",
)
def adaptation_effectiveness_by_member(spark, sf_dir):
    return tidy(_effectiveness(spark, sf_dir, ["location_id", "climate_model"]))


@query(
    "effectiveness_chart",
    f"with {_effectiveness_ctes([])} select variable, adaptation, "
    f"{r('mean_impact_reduction', 'mean_impact_reduction')}, significant, significant as highlight from eff",
)
def effectiveness_chart(spark, sf_dir):
    """One chart per variable."""
    chart = _effectiveness(spark, sf_dir).select("variable", "adaptation", "mean_impact_reduction", "significant")
    return tidy(ad.effectiveness_order(chart, "mean_impact_reduction", by=["variable"]))


@query(
    "adaptation_ranking_table",
    f"with {_effectiveness_ctes(['location_id', 'climate_model'])} select variable, adaptation, "
    + ", ".join(
        f"{r(f'avg({v})', f'{v}_mean', 3)}, {r(f'stddev_samp({v})', f'{v}_std', 3)}"
        for v in ("mean_impact_reduction", "relative_effectiveness")
    )
    + f", {r('avg(significant::int)', 'significant_share', 3)} from eff group by all",
)
def adaptation_ranking_table(spark, sf_dir):
    members = _effectiveness(spark, sf_dir, ["location_id", "climate_model"])
    return tidy(ad.ranking_table(members, ["variable"]), 3)


_AE = ["mean_impact_reduction", "relative_effectiveness"]
_AE_KEYS = "adaptation, location_id, variable"


@query(
    "adaptation_ensemble",
    f"with {_effectiveness_ctes(['location_id', 'climate_model'])} "
    + _ensemble_sql("eff", _AE_KEYS, _AE, "climate_model"),
)
def adaptation_ensemble(spark, sf_dir):
    members = _effectiveness(spark, sf_dir, ["location_id", "climate_model"])
    return tidy(impacts.ensemble_statistics(members, _AE_KEYS.split(", "), _AE, "climate_model"))


@query(
    "adaptation_regions",
    f"with {_effectiveness_ctes(['location_id', 'climate_model'])} select n_regionkey::varchar as region_id, "
    f"adaptation, variable, {', '.join(r(f'avg({v})', v) for v in _AE)} "
    "from eff join nation on location_id = n_nationkey::varchar group by all",
)
def adaptation_regions(spark, sf_dir):
    members = _effectiveness(spark, sf_dir, ["location_id", "climate_model"])
    return tidy(
        regions.region_means(members, _region_map(spark, sf_dir), _AE, keys=["adaptation", "variable"])
    )


_VS_KEYS = ["location_id", "climate_model", "scenario"]
_VS = f"""{SIM}, m as (select {', '.join(_VS_KEYS)}, adaptation, avg(yield_kg) as yield_kg,
 avg(etc_mm) as etc_mm from sim group by all),
 w as (select * from (unpivot m on yield_kg, etc_mm into name variable value value)),
 vs as (select a.*, b.value as baseline_value, a.value - b.value as absolute_effectiveness,
 (a.value - b.value) / nullif(abs(b.value), 0) * 100 as relative_effectiveness
 from w a join w b using ({', '.join(_VS_KEYS)}, variable)
 where a.adaptation <> 'baseline' and b.adaptation = 'baseline')"""


def _vs_baseline(spark, sf_dir):
    return ad.effectiveness_vs_baseline(sim_results(spark, sf_dir), _VS_KEYS, _AD_VARS)


@query(
    "adaptation_vs_baseline",
    f"with {_VS} select {', '.join(_VS_KEYS)}, adaptation, variable, "
    + _rounded(["value", "baseline_value", "absolute_effectiveness", "relative_effectiveness"])
    + " from vs",
)
def adaptation_vs_baseline(spark, sf_dir):
    return tidy(_vs_baseline(spark, sf_dir))


@query(
    "adaptation_rank",
    f"""with {_VS}, m2 as (select scenario, variable, adaptation, avg(absolute_effectiveness) as e
 from vs group by all) select scenario, variable, adaptation, {r('e', 'mean_effect')},
 row_number() over (partition by scenario, variable order by e desc, adaptation)::int as rank from m2""",
)
def adaptation_rank(spark, sf_dir):
    return tidy(ad.rank_adaptations(_vs_baseline(spark, sf_dir), ["scenario", "variable"]))


@query(
    "yearly_series",
    f"with {SIM} select scenario, year, {', '.join(r(f'avg({v})', f'{v}_mean') for v in VALUES)} "
    "from sim group by all",
)
def yearly_series(spark, sf_dir):
    sim = sim_results(spark, sf_dir)
    return tidy(impacts.yearly_means(sim, ["scenario"], F.col("year"), VALUES))


@query(
    "t_test_large_groups",
    f"""with agg as (select l_linenumber % 2 as parity, count(*) filter (l_linestatus = 'F') as na,
 count(*) filter (l_linestatus = 'O') as nb, avg(l_quantity) filter (l_linestatus = 'F') as ma,
 avg(l_quantity) filter (l_linestatus = 'O') as mb, var_samp(l_quantity) filter (l_linestatus = 'F') as va,
 var_samp(l_quantity) filter (l_linestatus = 'O') as vb from lineitem group by all),
 tt as (select *, na + nb - 2 as df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) as t
 from agg),
 term as (select parity, k, case when k = 0 then case when df % 2 = 0 then 0 else 0.5 * ln(df / (df + t * t)) end
  else ln(case when df % 2 = 0 then (2 * k - 1) / (2.0 * k) else 2 * k / (2.0 * k + 1) end * df / (df + t * t)) end as lt
  from (select *, unnest(generate_series(0, case when df % 2 = 0 then (df - 2) // 2 else (df - 3) // 2 end)) as k from tt)),
 series as (select parity, sum(e) as s from (select parity, exp(sum(lt) over (partition by parity order by k)) as e from term)
  group by all)
 select parity, na as n_a, nb as n_b, {r("case when df % 2 = 0 then 1 - sin(atan(abs(t) / sqrt(df))) * s "
 "else 1 - 2 / pi() * (atan(abs(t) / sqrt(df)) + sin(atan(abs(t) / sqrt(df))) * s) end", 'p_value')}
 from tt join series using (parity)""",
)
def t_test_large_groups(spark, sf_dir):
    """Two samples of tens of thousands of rows in each group; the SQL sums the finite series."""
    def sample(status):
        x = F.when(F.col("l_linestatus") == status, F.col("l_quantity"))
        return F.struct(
            F.count(x).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")
        )

    groups = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 2).alias("parity"))
    tested = add_t_test(groups.agg(sample("F").alias("a"), sample("O").alias("b")), "a", "b")
    return tidy(tested.select("parity", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), "p_value"))
