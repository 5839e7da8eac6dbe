"""Run-status tables and the split of runs over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.functions import status as st
from harvestlens.functions.columns import col
from harvestlens.operators.ordering import global_positions
from harvestlens.session import store


def latest_status(events: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Current state of each run from its events.

    An aggregate rather than a window: events combine before the shuffle, so a
    run with very many events costs no more than another.
    """
    newest = F.struct("ts", "seq")
    state = events.groupBy(key).agg(
        F.max_by(F.struct("status", "message", "ts", "seq"), newest).alias("_last"),
        F.min("ts").alias("start_time"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return with_end_time(state.select(key, "_last.*", "start_time", "n_events"))


def with_end_time(state: DataFrame) -> DataFrame:
    ended = F.when(st.is_final(F.col("status")), F.col("ts"))
    return state.withColumn("end_time", ended)


def upsert_status(
    current: DataFrame,
    updates: DataFrame,
    columns: Sequence[str] = ("status", "message", "run_time"),
    key: str = "simulation_id",
) -> DataFrame:
    """New values where an update gives one; runs without a row are not added."""
    renamed = updates.select(key, *[col(c).alias(f"_new_{c}") for c in columns])
    return current.join(renamed, key, "left").select(
        *[
            F.coalesce(col(f"_new_{c}"), col(c)).alias(c) if c in columns else col(c)
            for c in current.columns
        ]
    )


def runnable(runs: DataFrame) -> DataFrame:
    return runs.filter(st.is_runnable(F.col("status")))


def completed(runs: DataFrame) -> DataFrame:
    return runs.filter(st.is_completed(F.col("status")))


def status_counts(runs: DataFrame) -> DataFrame:
    """Rows per status with its predicates."""
    s = F.col("status")
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n_runs")).select(
        "status",
        "n_runs",
        st.description(s).alias("description"),
        st.is_known(s).alias("known"),
        st.is_error(s).alias("is_error"),
        st.is_final(s).alias("is_final"),
        st.is_success(s).alias("is_success"),
        st.is_runnable(s).alias("is_runnable"),
    )


def status_totals(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("status")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(st.is_runnable(s)).alias("n_ready"),
        F.count_if(st.is_error(s)).alias("n_error"),
        F.count_if(st.is_success(s)).alias("n_success"),
        F.count_if(st.is_final(s) & ~st.is_success(s)).alias("n_failed"),
    )


def split_work(runs: DataFrame, tasks: int, key: str = "simulation_id", name: str = "task") -> DataFrame:
    """Tasks 1..n of equal size, the first ones taking the remainder.

    The order is (three leading MD5 digits of the key, key), which spreads neighbouring keys
    over the tasks; the global position comes from sorted pieces of about equal size.
    """
    if tasks < 1:
        raise ValueError("tasks must be at least 1")
    text = col(key).cast("string")
    order = [F.substring(F.md5(text), 1, 3), text]
    numbered = global_positions(store(runs, "listed-runs"), [], order, "_pos", "_total")
    total = F.col("_total")
    small = F.floor(total / tasks)
    extra = total % tasks
    wide = extra * (small + 1)
    at = F.col("_pos") - 1
    task = F.when(at < wide, F.floor(at / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(at - wide, small))
    )
    return numbered.withColumn(name, (task + 1).cast("int")).drop("_pos", "_total")


def task_runs(runs: DataFrame, task: int, tasks: int, key: str = "simulation_id") -> DataFrame:
    """The ready runs of one task."""
    split = split_work(runnable(runs), tasks, key)
    return split.filter(F.col("task") == task).drop("task")
