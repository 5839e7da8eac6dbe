"""A user's model function over run rows, in parallel and with captured errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions import status as st
from harvestlens.functions.columns import col, hash_number
from harvestlens.sources.publication import committed_folders

RESULT_SCHEMA = "simulation_id string, status string, message string, run_time double"


def with_retry(
    func: Callable,
    max_tries: int = 3,
    initial_delay: float = 1.0,
    backoff_factor: float = 2.0,
    exceptions: tuple = (Exception,),
) -> Callable:
    """Call again after a failure, waiting longer each time; the last error is raised."""
    if max_tries < 1:
        raise ValueError("max_tries must be at least 1")

    def call(*args, **kwargs):
        waits = [initial_delay * backoff_factor**i for i in range(max_tries - 1)]
        for wait in waits:
            try:
                return func(*args, **kwargs)
            except exceptions:
                time.sleep(wait)
        return func(*args, **kwargs)

    return call


def run_in_parallel(
    runs: DataFrame,
    func: Callable[[dict], str | None],
    tasks: int | None = None,
    max_tries: int = 1,
    initial_delay: float = 1.0,
    backoff_factor: float = 2.0,
    key: str = "simulation_id",
) -> DataFrame:
    """``(simulation_id, status, message, run_time)`` of each run.

    ``func`` gets a run as a dict and may return a message. An exception becomes
    RUN_ERROR (TimeoutError: TIMEOUT). ``tasks`` spreads costly runs evenly by
    their key; Spark repeats the runs of a lost executor, so ``func`` must bear that.
    """
    attempt = with_retry(func, max_tries, initial_delay, backoff_factor)

    def one(run: dict) -> tuple:
        started = time.monotonic()
        try:
            status, message = "SUCCESS", attempt(run) or ""
        except TimeoutError as e:
            status, message = "TIMEOUT", str(e)
        except Exception as e:
            status, message = "RUN_ERROR", str(e)
        return str(run[key]), status, message, time.monotonic() - started

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = [one(run) for run in frame.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.float64()),
                ],
                names=["simulation_id", "status", "message", "run_time"],
            )

    spread = runs.repartition(tasks, key) if tasks else runs
    return spread.mapInArrow(batches, RESULT_SCHEMA)


EVENT_SCHEMA = "simulation_id string, ts timestamp, seq long, status string, message string, run_time double, portion int"


def recorded_runs(spark: SparkSession, path: str) -> DataFrame:
    """Status events of all portions that were written to their end; a portion that broke off isn't read."""
    folders = committed_folders(spark, path)
    if not folders:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).parquet(*folders)


def run_resumable(
    runs: DataFrame,
    func: Callable[[dict], str | None],
    path: str,
    portions: int = 8,
    stop_after: int | None = None,
    key: str = "simulation_id",
    **options,
) -> DataFrame:
    """Run what is not final yet, portion by portion; returns the status events of all runs so far.

    A portion is a fixed share of the runs by a hash of their key. Its results, which are the runs'
    status events, are written together and count once the folder is complete. So a start
    leaves out every run with a final status, whatever an earlier start did or where it stopped, and
    a lost executor repeats at most the open runs of its portion. ``stop_after`` ends the start after
    that many portions. ``options`` are those of ``run_in_parallel``.
    """
    spark = runs.sparkSession
    done = recorded_runs(spark, path)
    start = int(done.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]) + 1
    final = done.filter(st.is_final(F.col("status"))).select(F.col("simulation_id").alias("_done")).distinct()
    names = col(key).cast("string")
    open_ = runs.join(final, names == F.col("_done"), "left_anti")
    share = hash_number(names) % portions
    for portion in range(portions if stop_after is None else min(portions, stop_after)):
        results = run_in_parallel(open_.filter(share == portion), func, key=key, **options)
        events = results.select(
            "simulation_id",
            F.current_timestamp().alias("ts"),
            F.lit(start).cast("long").alias("seq"),
            "status",
            "message",
            "run_time",
            F.lit(portion).alias("portion"),
        )
        events.write.mode("overwrite").parquet(f"{path.rstrip('/')}/start={start}-portion={portion}")
    return recorded_runs(spark, path)
