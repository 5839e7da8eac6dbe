"""Continuous tracking of run status from an append-only feed of events."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harvestlens.functions import status as st
from harvestlens.operators.runs import latest_status, with_end_time
from harvestlens.sources import publication

POINTER = "_pointer-"  # and the number of the batch; the highest one counts
SEGMENTS = 4  # of one generation, after which they become one of the next


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def pointer(spark: SparkSession, table: str) -> dict:
    """What the table consists of now: the folders of its version, the watermark, and the late events so far."""
    found = _pointers(spark, table)
    empty = {"batch": -1, "watermark": None, "late": 0, "open": None, "segments": []}
    return json.loads(publication.read_text(spark, found[-1])) if found else empty


def _pointers(spark: SparkSession, table: str) -> list[str]:
    names = publication.files(spark, table)
    return [f for f in names if f.rsplit("/", 1)[1].startswith(POINTER) and f.endswith(".json")]


def _combined(states: DataFrame, key: str) -> DataFrame:
    """One state per run from several: the newest (ts, seq) wins, starts and counts are put together."""
    newest = F.struct("ts", "seq")
    found = states.groupBy(key).agg(
        F.max_by(F.struct("status", "message", "ts", "seq"), newest).alias("_last"),
        F.min("start_time").alias("start_time"),
        F.sum("n_events").alias("n_events"),
    )
    return with_end_time(found.select(key, "_last.*", "start_time", "n_events"))


def fold_batch(events: DataFrame, batch: int, table: str, bound: str, key: str = "simulation_id") -> None:
    """Fold one batch of events into the status table.

    The watermark is the greatest event time seen before this batch less ``bound``. Events older than
    that are late: they are counted and change nothing. Runs whose state is final and older than the
    new watermark can't be changed by events in time: they leave the open states, which alone are
    rewritten with a batch, and go to a segment of finished runs. Segments of one generation
    are merged when there are ``SEGMENTS`` of them, so folders grow with the logarithm of the finished
    runs, not with batches. All of it becomes current with the batch's pointer file,
    which appears under its name in one step; a batch that is repeated after a failure finds its number there and does nothing.
    """
    spark, table = events.sparkSession, table.rstrip("/")
    now = pointer(spark, table)
    if batch <= now["batch"]:
        return
    folder = lambda kind: f"{table}/{kind}-{batch}-{uuid.uuid4().hex}"
    limit = F.lit(now["watermark"]).cast("timestamp_ntz")
    stamped = events.withColumn("_at", F.col("ts").cast("timestamp_ntz")).persist()
    try:
        late = F.coalesce(F.col("_at") < limit, F.lit(False))
        facts = stamped.agg(
            F.count_if(late).alias("late"),
            F.greatest(F.max("_at") - F.expr(f"INTERVAL {bound}"), limit).cast("string").alias("watermark"),
        ).first()
        states = latest_status(stamped.filter(~late).drop("_at"), key).drop("end_time")
        if now["open"]:
            states = states.unionByName(spark.read.parquet(f"{table}/{now['open']}").drop("end_time"))
        merged = folder("merged")
        _combined(states, key).write.parquet(merged)
    finally:
        stamped.unpersist()
    merged_rows = spark.read.parquet(merged)
    watermark = facts["watermark"]
    finished = st.is_final(F.col("status")) & (F.col("ts").cast("timestamp_ntz") < F.lit(watermark).cast("timestamp_ntz"))
    finished = F.coalesce(finished, F.lit(False))
    open_, segment = folder("open"), folder("finished")
    merged_rows.filter(~finished).write.parquet(open_)
    segments = list(now["segments"])
    if not merged_rows.filter(finished).isEmpty():
        merged_rows.filter(finished).write.parquet(segment)
        segments.append({"path": segment.rsplit("/", 1)[1], "generation": 0})
    generation = 0
    while sum(s["generation"] == generation for s in segments) >= SEGMENTS:
        mine = [s for s in segments if s["generation"] == generation]
        joint = folder(f"finished{generation + 1}")
        rows = spark.read.parquet(*[f"{table}/{s['path']}" for s in mine])
        _combined(rows.drop("end_time"), key).write.parquet(joint)
        segments = [s for s in segments if s["generation"] != generation]
        segments.append({"path": joint.rsplit("/", 1)[1], "generation": generation + 1})
        generation += 1
    new = {"batch": batch, "watermark": watermark, "late": now["late"] + facts["late"], "open": open_.rsplit("/", 1)[1], "segments": segments}
    older = _pointers(spark, table)
    publication.write_text(spark, f"{table}/{POINTER}{batch:012d}.json", json.dumps(new))
    # the version before stays for those who read it; what neither refers to goes
    used = {f for v in (now, new) for f in [v["open"], *[s["path"] for s in v["segments"]]] if f}
    for path in older[:-1]:
        publication.remove(spark, path)
    for path in publication.folders(spark, table):
        if path.rsplit("/", 1)[1] not in used:
            publication.remove(spark, path)


def track_status(
    events: DataFrame, table: str, checkpoint: str, key: str = "simulation_id", bound: str = "7 days"
) -> StreamingQuery:
    """Fold the available events into the status table, batch by batch (see ``fold_batch``).

    The stream itself holds no state: open runs are a table, bounded by the runs in progress and those
    that ended within ``bound``.
    """
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch: fold_batch(rows, batch, table, bound, key))
        .trigger(availableNow=True)
        .start()
    )


def current_status(spark: SparkSession, table: str, key: str = "simulation_id") -> DataFrame:
    """Current state of each run; a finished run that began again has both of its parts put together."""
    now = pointer(spark, table)
    parts = [f for f in [now["open"], *[s["path"] for s in now["segments"]]] if f]
    if not parts:
        raise ValueError(f"{table} holds no status yet")
    rows = spark.read.parquet(*[f"{table.rstrip('/')}/{p}" for p in parts])
    return _combined(rows.drop("end_time"), key)
