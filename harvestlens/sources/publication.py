"""Publishing tables so that readers never see a half-written one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed

MARKER = "_COMMITTED"
DONE = "_SUCCESS"  # written by Spark when all files of a folder are in place


def _place(spark: SparkSession, path: str):
    """(file system, path) through Spark's own view of the store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def _below(spark: SparkSession, path: str, directories: bool) -> list[str]:
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(place) if f.isDirectory() == directories)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders right below ``path``; none if there is no such folder."""
    return _below(spark, path, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files right below ``path``; none if there is no such folder."""
    return _below(spark, path, False)


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders below ``path`` that Spark wrote to their end."""
    return [f for f in folders(spark, path) if exists(spark, f"{f}/{DONE}")]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    fs, place = _place(spark, path)
    _, beside = _place(spark, f"{path}.writing")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"could not put {path} in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def publish_periods(df: DataFrame, path: str) -> None:
    """Write the periods that ``df`` has and leave the others as they are.

    Only the folders of these periods are replaced (dynamic partition overwrite). The table's
    marker is taken away first and put back when all files are in place, so a step that
    broke off leaves a table that readers refuse until it is run again.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    remove(spark, f"{path}/{MARKER}")
    rows = keyed(df, ["period"]).hint("rebalance", "period")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
    write_text(spark, f"{path}/{MARKER}", json.dumps({"columns": df.columns}))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published table, with ``period`` as a column; an error while it isn't complete."""
    path = path.rstrip("/")
    marker = read_text(spark, f"{path}/{MARKER}")
    if marker is None:
        raise ValueError(f"{path} is not a complete table: its marker is missing")
    found = spark.read.parquet(path)
    return found.select(*[col(c) if c in found.columns else F.lit(None).alias(c) for c in json.loads(marker)["columns"]])
