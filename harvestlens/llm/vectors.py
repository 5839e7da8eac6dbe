"""Near-duplicate embeddings by Euclidean (p-stable) hashing.

Normalised vectors are projected on random Gaussian directions; the projections, shifted
at random and divided by ``width``, are rounded down. ``k`` such values make a bucket in
each of several tables. Vectors that share a bucket are candidates and are compared
exactly, by cosine in double precision, so no pair below the threshold is linked. Buckets of one
vector are dropped by counts apart from the rows, so a bucket of very many can be split among tasks.

``k`` follows the number of vectors so that unrelated vectors rarely meet, and the number
of tables follows ``k`` so that a pair at the threshold is found with probability
``recall``; closer pairs are found more surely. Equal vectors are one class, hashed and
compared once however many they are, and linked with one another; 128 bits name a class.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
nor do vectors of different lengths. Rows with equal or null ids count as rows of their
own; a component's id is its smallest non-null one. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm.common import components, discard, pick, stored, table
from harvestlens.llm.registry import query

WIDTH = 2.0
UNRELATED = math.sqrt(2.0)  # distance of orthogonal unit vectors


def same_bucket(distance: float, width: float) -> float:
    """Probability that one projection puts two vectors at ``distance`` into one interval."""
    t = width / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_plan(n: int, cosine: float, recall: float, width: float) -> tuple[int, int]:
    """(projections per table, tables) for n vectors."""
    near = same_bucket(math.sqrt(2 - 2 * cosine), width)
    far = same_bucket(UNRELATED, width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(rows), dim)


def bucket_hashes(vectors: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket name per vector (rows) and table (columns)."""
    dim = vectors.shape[1]
    draw = np.random.default_rng([seed, dim])
    directions = draw.standard_normal((dim, k * tables))
    shifts = draw.uniform(0, width, k * tables)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
    name = np.full(cells.shape[:2], np.uint64(0x9E3779B97F4A7C15)) * (np.arange(tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1 + 2 * tables * dim))
    for i in range(k):
        name = (name ^ cells[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def hashed(classes: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """``class, bucket`` for each valid vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, names = batch.column(1), batch.column(0)
            sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()])
            for dim in np.unique(sizes[sizes > 0]):
                for rows in np.array_split(np.flatnonzero(sizes == dim), max(1, int((sizes == dim).sum() // 2000))):
                    x = _matrix(column, rows, int(dim))
                    buckets = bucket_hashes(x, k, tables, width, seed)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(np.repeat(rows, tables))), pa.array(buckets.ravel())], names=["class", "bucket"]
                    )

    return classes.select("class", "v").mapInArrow(run, "class binary, bucket long")


def _name_of(vector: str) -> Column:
    """128 bits that name a vector: two hashes of different seeds."""
    parts = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(vector), F.xxhash64(F.lit(1), vector))]
    return F.unhex(F.concat(*parts))


def close_pairs(pairs: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b, va, vb) whose cosine is at least ``cosine``, without their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            sizes, others = (np.array(c.value_lengths().to_pylist()) for c in (left, right))
            keep = []
            for dim in np.unique(sizes[sizes == others]):
                for rows in np.array_split(np.flatnonzero((sizes == dim) & (others == dim)), max(1, len(sizes) // 4000)):
                    x, y = _matrix(left, rows, int(dim)), _matrix(right, rows, int(dim))
                    value = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                    keep.append(rows[value >= cosine])
            at = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, "a binary, b binary")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.95,
    recall: float = 0.95,
    width: float = WIDTH,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the id is its component's)."""
    rows = pick(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    if not rows.schema["v"].dataType.simpleString().startswith("array"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    named = rows.withColumn("class", F.when(valid, _name_of("v")))
    classes = named.filter("class IS NOT NULL").groupBy("class").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low")
    )
    classes = stored(classes, "vector-classes")
    k, tables = table_plan(classes.count(), cosine, recall, width)
    found = stored(hashed(classes, k, tables, width, seed), "vector-hashes")
    several = found.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
    shared = stored(found.join(stored(several.select("bucket"), "shared-buckets"), "bucket").select("class", "bucket"), "vector-buckets")
    discard(found)
    other = shared.select(F.col("class").alias("b"), F.col("bucket").alias("other"))
    met = shared.join(other, (F.col("bucket") == F.col("other")) & (F.col("class") < F.col("b")))
    met = met.select(F.col("class").alias("a"), "b").distinct()
    left = classes.select(F.col("class").alias("a"), F.col("v").alias("va"))
    right = classes.select(F.col("class").alias("b"), F.col("v").alias("vb"))
    links = stored(close_pairs(met.join(left, "a").join(right, "b"), cosine), "vector-links")
    both = links.union(links.select("b", "a"))
    weight = classes.select(F.col("class").alias("b"), "copies")
    degree = both.join(weight, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    joined = components(links)
    known = (
        classes.select("class", "copies", "low")
        .join(degree, "class", "left")
        .join(joined.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("part", F.coalesce("component", "class"))
    )
    lows = known.groupBy("part").agg(F.min("low").alias("component_id"))
    known = known.join(lows, "part").select(
        "class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    return named.select("id", "class").join(known, "class", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


@query(
    "op8_embedding_near_dedup",
    oracle="""
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    ), g AS (
        SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
    ), e AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
        WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
    ), r(root, node) AS (
        SELECT vec_id, vec_id FROM v UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a
    ), n AS (
        SELECT a, count(*) AS n FROM e GROUP BY a
    )
    SELECT root AS vec_id, any_value(coalesce(n.n, 0)) AS n_links, min(node) AS component_id, min(node) = root AS kept
    FROM r LEFT JOIN n ON n.a = root GROUP BY root
    """,
)
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
