"""The driver's tables read as the tables of this domain.

Measures become whole numbers, so that sums do not depend on their order and an
independent engine can be compared digit by digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.operators.grid import pivot_variables
from harvestlens.operators.scenario import assign_periods
from harvestlens.session import spread

KEYS = ["location_id", "climate_source", "climate_model"]
VALUES = ["yield_kg", "etc_mm", "irrigation_mm"]

PERIODS = {
    "historical": ("1990-01-01", "1997-12-31"),
    "near_future": ("1998-01-01", "1999-12-31"),
    "far_future": ("2000-01-01", "2010-12-31"),
}
ADAPTATION_OF_SEGMENT = {
    "BUILDING": "baseline",
    "AUTOMOBILE": "early_sowing_jun01",
    "FURNITURE": "drip_irrigation_90eff",
    "HOUSEHOLD": "drought_tolerant_cultivar",
    "MACHINERY": "residue_retention_50pct",
}
CROP_MODEL_OF_FLAG = {"A": "DSSAT", "N": "APSIM", "R": "STICS"}
VARIABLE_OF_EVENT = {
    "click": "tasmax",
    "view": "tasmin",
    "purchase": "pr",
    "signup": "rsds",
    "error": "hurs",
}
STATUS_OF_EVENT = {
    "click": "RUNNING",
    "view": "READY_TO_RUN",
    "purchase": "SUCCESS",
    "signup": "RUN_ERROR",
    "error": "FAILED",
}
WEATHER = list(VARIABLE_OF_EVENT.values())


# Stating the schemas saves Spark a job per table to read a footer.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


_made: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, made once for a session and its tables: stored tables and fitted models."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def whole(c):
    """Nearest whole number of a value that is not negative; much cheaper than ``round``."""
    return F.floor(c + 0.5).cast("double")


_SENT = 2_000_000  # rows of a table that Spark can send to every task


def _spread_lines(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str, other: str) -> DataFrame:
    """Line items dealt by the key of a join, in as many partitions as they need, where ``other`` is large."""

    def counted(name: str) -> int:
        return once(spark, sf_dir, f"rows-{name}", table(spark, sf_dir, name).count)

    return spread(rows, counted("lineitem"), key) if counted(other) > _SENT else rows


def translate(name: str, pairs: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, value in pairs.items():
        out = F.when(F.col(name) == key, F.lit(value)).otherwise(out)
    return out


def case_sql(name: str, pairs: dict[str, str]) -> str:
    return f"case {name} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + " end"


def sim_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result fact table: line items with the attributes of their order, customer and part."""
    dated = assign_periods(table(spark, sf_dir, "orders"), "o_orderdate", PERIODS)
    lines = _spread_lines(spark, sf_dir, table(spark, sf_dir, "lineitem"), "l_orderkey", "orders")
    joined = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = _spread_lines(spark, sf_dir, joined, "o_custkey", "customer")
    joined = joined.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = _spread_lines(spark, sf_dir, joined, "l_partkey", "part")
    joined = joined.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("simulation_id"),
        F.col("n_nationkey").cast("string").alias("location_id"),
        F.col("n_regionkey").cast("string").alias("region_id"),
        F.col("l_linestatus").alias("climate_source"),
        F.col("o_orderpriority").alias("climate_model"),
        F.col("o_orderstatus").alias("scenario"),
        translate("l_returnflag", CROP_MODEL_OF_FLAG).alias("crop_model"),
        translate("c_mktsegment", ADAPTATION_OF_SEGMENT).alias("adaptation"),
        F.col("p_type").alias("soil_id"),
        F.date_format("l_shipdate", "MM-dd").alias("sowing_date"),
        "period",
        F.year("o_orderdate").alias("year"),
        F.col("l_quantity").alias("yield_kg"),
        whole(F.col("l_extendedprice")).alias("etc_mm"),
        whole(F.col("l_quantity") * F.col("l_discount") * 100).alias("irrigation_mm"),
        F.col("p_size").cast("double").alias("fertilizer_n"),
        F.col("p_retailprice").alias("price"),
    )


_PERIOD_CASES = " ".join(
    f"when o_orderdate::date between date '{s}' and date '{e}' then '{n}'"
    for n, (s, e) in PERIODS.items()
)

SIM = f"""sim as (
 select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as simulation_id,
  n_nationkey::varchar as location_id, n_regionkey::varchar as region_id,
  l_linestatus as climate_source, o_orderpriority as climate_model, o_orderstatus as scenario,
  {case_sql('l_returnflag', CROP_MODEL_OF_FLAG)} as crop_model,
  {case_sql('c_mktsegment', ADAPTATION_OF_SEGMENT)} as adaptation,
  p_type as soil_id, strftime(l_shipdate, '%m-%d') as sowing_date,
  case {_PERIOD_CASES} end as period, year(o_orderdate)::int as year,
  l_quantity as yield_kg, round(l_extendedprice) as etc_mm,
  round(l_quantity * l_discount * 100) as irrigation_mm, p_size::double as fertilizer_n,
  p_retailprice as price
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey
 where period is not null)"""


def climate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells from the events: place, day, variable, value."""
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 10).alias("location_id"),
        (F.col("user_id") % 15).cast("double").alias("lat"),
        F.floor(F.col("user_id") / 15).cast("double").alias("lon"),
        F.col("ts").cast("date").alias("date"),
        translate("event_type", VARIABLE_OF_EVENT).alias("variable"),
        whole(F.col("value") * 100).alias("value"),
    )


CELLS = f"""cells as (
 select user_id // 10 as location_id, (user_id % 15)::double as lat, (user_id // 15)::double as lon,
  ts::date as date, {case_sql('event_type', VARIABLE_OF_EVENT)} as variable,
  round(value * 100) as value from events)"""


def _pivot_sql(keys: str) -> str:
    return ", ".join(f"avg(value) filter (variable = '{v}') as {v}" for v in WEATHER)


def climate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per location and day with a column per variable."""
    return pivot_variables(climate_cells(spark, sf_dir), ["location_id", "date"], WEATHER)


DAILY = f"""{CELLS}, daily as (
 select location_id, date, {_pivot_sql('')} from cells group by all)"""


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_variables(climate_cells(spark, sf_dir), ["lat", "lon", "date"], WEATHER)


GRID = f"""{CELLS}, grid as (
 select lat, lon, date, {_pivot_sql('')} from cells group by all)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations spread over the extent of the grid."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("location_id"),
        ((k * 37 % 1400) / 100.0).alias("lat"),
        ((k * 53 % 900) / 100.0).alias("lon"),
    )


POINTS = """points as (
 select s_suppkey as location_id, (s_suppkey * 37 % 1400) / 100.0::double as lat,
  (s_suppkey * 53 % 900) / 100.0::double as lon from supplier)"""


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten years of daily values per climate model."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("climate_model"), F.col("o_orderdate").cast("date").alias("date")
        )
        .agg(
            F.sum(whole(F.col("o_totalprice"))).alias("pr"),
            F.avg((F.col("o_custkey") % 50).cast("double")).alias("tasmax"),
        )
    )


SERIES = """series as (
 select o_orderpriority as climate_model, o_orderdate::date as date,
  sum(round(o_totalprice)) as pr, avg((o_custkey % 50)::double) as tasmax
 from orders group by all)"""


def as_status_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("simulation_id"),
        "ts",
        F.col("event_id").alias("seq"),
        translate("event_type", STATUS_OF_EVENT).alias("status"),
        F.col("props").alias("message"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_status_events(table(spark, sf_dir, "events"))


STATUS = f"""feed as (
 select user_id::varchar as simulation_id, ts, event_id as seq,
  {case_sql('event_type', STATUS_OF_EVENT)} as status, props as message from events)"""


def polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle or a triangle per supplier, unfolded to its edges."""
    k = F.col("s_suppkey")
    corners = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SOIL"), F.lpad(k.cast("string"), 6, "0")).alias("polygon_id"),
        (k % 2 == 0).alias("box"),
        ((k * 29 % 1300) / 100.0 + 0.003).alias("x"),
        ((k * 41 % 1300) / 100.0 + 0.007).alias("y"),
        (0.5 + (k % 4) * 0.6).alias("w"),
    )
    x, y, w = F.col("x"), F.col("y"), F.col("w")

    def edge(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    box = F.array(
        edge(x, y, x + w, y), edge(x + w, y, x + w, y + w), edge(x + w, y + w, x, y + w), edge(x, y + w, x, y)
    )
    triangle = F.array(
        edge(x, y, x + w, y + w / 4), edge(x + w, y + w / 4, x + w / 3, y + w), edge(x + w / 3, y + w, x, y)
    )
    shape = F.when(F.col("box"), box).otherwise(triangle)
    return corners.select("polygon_id", F.explode(shape).alias("_")).select("polygon_id", "_.*")


EDGES = """corners as (
 select 'SOIL' || lpad(s_suppkey::varchar, 6, '0') as polygon_id, s_suppkey % 2 = 0 as box,
  (s_suppkey * 29 % 1300) / 100.0::double + 0.003::double as x,
  (s_suppkey * 41 % 1300) / 100.0::double + 0.007::double as y,
  0.5::double + (s_suppkey % 4) * 0.6::double as w from supplier),
edges as (
 select polygon_id, x as x1, y as y1, x + w as x2, y as y2 from corners where box union all
 select polygon_id, x + w, y, x + w, y + w from corners where box union all
 select polygon_id, x + w, y + w, x, y + w from corners where box union all
 select polygon_id, x, y + w, x, y from corners where box union all
 select polygon_id, x, y, x + w, y + w / 4 from corners where not box union all
 select polygon_id, x + w, y + w / 4, x + w / 3, y + w from corners where not box union all
 select polygon_id, x + w / 3, y + w, x, y from corners where not box)"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without negative zero) for comparison with another engine."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if kind == "double" else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def r(expression: str, name: str, digits: int = 6) -> str:
    """SQL counterpart of ``tidy`` for one column."""
    return f'round({expression}, {digits}) + 0.0 as "{name}"'
