"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE sizes shuffle partitions and splits skewed joins from measured sizes, and
# is what decides on broadcasts: the operators carry no broadcast hints.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cpus: int | str = "*", app: str = "harvestlens", memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own. ``folder``: ``spark.checkpoint.dir``."""
    partitions = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # recording the call site of every column costs more than planning small data
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_base: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="harvestlens-"))
        base = _local_base[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back, so that it is worked out once."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 500_000


def partitions_for(spark: SparkSession, rows: int, a_task: int | None = None) -> int | None:
    """Partitions of ``a_task`` (``ROWS_A_TASK``) rows; None where the session's own number is enough."""
    needed = -(-rows // (a_task or ROWS_A_TASK))
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A large table in as many partitions as its rows need, by ``keys`` or evenly.

    The session's number of shuffle partitions is fixed, so the memory of a task would grow with the
    table. Tables that this number is enough for stay as they are.
    """
    parts = partitions_for(df.sparkSession, rows)
    if parts is None:
        return df
    if keys:
        return df.repartition(parts, *keys)
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row").drop("_row")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session made, through Spark's own view of the store."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
