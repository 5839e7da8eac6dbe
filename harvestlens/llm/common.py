"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.session import remove_folder, shared_folder

# The white space that separates words, as a pattern class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

# DuckDB: the 256-entry table of CRC-32 (polynomial 0xEDB88320), and the checksum of a decimal doc_id.
CRC32_SQL = """crc_steps AS (
        SELECT b, b AS v, 0 AS k FROM range(256) r(b)
        UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc_steps WHERE k < 8
    ), crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_steps WHERE k = 8)"""
CRC32_OF_ID = (
    "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)), "
    "lambda a, c: xor(a // 256, t[1 + xor(a, c) % 256]), 4294967295))"
)


def trimmed(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or blank text."""
    inner = trimmed(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words without building them: each run of word characters becomes one character."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.char_length(F.translate(runs, SPACE_CHARS, "")).cast("long")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; one that is missing becomes null text."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read; a lost executor costs
    only the tasks it was running. ``discard`` deletes the files when nothing reads them any more.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with small_batches(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this runs, Python workers get Arrow batches of at most ``rows`` rows; then the setting is as before.

    Rows with whole texts are large: the usual 10 000 of them are held by Spark, by Arrow and by Python at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables. Whatever was derived from them must have been stored itself."""
    for df in tables:
        remove_folder(df.sparkSession, df._stored_at)


def may_hold(keys: DataFrame, key: str, bits: int = 1 << 24) -> Column:
    """Filter for rows whose 64-bit ``key`` may be among ``keys``.

    A table of ``bits`` bits, ``bits / 8`` bytes for any number of keys, goes to the tasks as
    a scalar subquery. It lets every wanted row through and few others; with very many keys
    it fills up and lets more through, so an exact join must follow.
    """
    h = keys.select(F.pmod(key, F.lit(bits)).alias("h"))
    found = h.groupBy(F.floor(F.col("h") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 AS int)))").alias("v"))
    rows = found.toArrow()  # bits / 64 rows at most
    words_ = np.zeros(bits // 64, dtype="<i8")
    words_[rows["w"].to_numpy()] = rows["v"].to_numpy()
    marks = keys.sparkSession.createDataFrame([(bytearray(words_.tobytes()),)], "marks binary")
    marks = stored(marks.coalesce(1), "row-marks").scalar()
    at = F.pmod(F.col(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring(marks, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows set apart from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` links as ``(node, component)``, stored.

    Nodes of any ordered type; the component is its smallest node. Alternating large
    and small stars: each round links every node to the smallest node near it, so that
    paths shrink geometrically, until a round changes no link. Minima are aggregates with a
    map-side part, joined back by an equi-join that can be split, so a node with very many links
    is no single task's work. Self links and null ends are ignored.
    """
    pairs = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "links")
    count = pairs.count()
    while count:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # every node points at its smallest neighbour, its other neighbours point there too
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        turned = stored(small.filter("a <> b").distinct(), "links")
        before, count = count, turned.count()
        settled = count == before and turned.join(pairs, ["a", "b"], "left_anti").isEmpty()
        discard(pairs)
        pairs = turned
        if settled:
            break
    named = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    found = stored(named, "components")
    discard(pairs)
    return found


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that what is made of long texts stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        pa.default_memory_pool().release_unused()
