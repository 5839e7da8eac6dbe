"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors are packed in blocks of ``BLOCK`` with a vertical layout: one row of a block's matrix
holds one dimension of all its vectors. A query block meets a candidate block as follows.
Scores are accumulated ``STEP`` dimensions at a time. After each step, what the remaining
dimensions can add is at most the product of the two remaining norms (Cauchy-Schwarz); a
candidate whose score so far and that bound stay below the query's threshold, its k-th
best score yet, is out. While many pairs survive, the step is one matrix product over the columns
that any query of the tile still needs; once few do, the survivors are compacted into a list of
pairs and only these go on, dimension by dimension.

Every query meets every candidate in blocks. The candidates come in waves of growing size
(``WAVES``: shares of the ids by hash), and each wave starts from the thresholds that the
earlier ones left, so what a later wave emits is a few rows a query whatever its size. In a
wave, cells of (query block, stripe of candidate blocks) are tasks of equal weight: a task
reads its cell as a stream, the query block first, and holds one block of each and ``k``
rows a query.

Components become ``floor(scale * x)``. Sums are exact: partial sums of doubles stay below
2**53 or else the block is computed with Python's integers; a score beyond 64 bits
is held at that range's end. Ranks follow score, then smaller id. A row with a null id or vector, or
with a null or non-finite component, takes no part. Of rows that share an id the one with the
smallest vector counts. Vectors of different lengths compare as if filled up with zeros.
An empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import pick, stored, table
from harvestlens.llm.registry import query

BLOCK = 4096  # vectors of a block
STEP = 16  # dimensions between two cuts
TILE = 256  # queries whose scores are held at once
STRIPES = 32  # cells a query block is spread over in a wave
WAVES = (64, 8, 1)  # a wave takes one id in so many of those not taken before
FEW = 0.05  # share of surviving pairs below which they are kept as a list
EXACT = float(1 << 53)
PACKED = "ids binary, dims int, lanes binary"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: ids and their integer components, as doubles, of the rows that take part."""
    rows = pick(vectors, "vec_id", "embedding")
    finite = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    found = rows.filter("vec_id IS NOT NULL").filter(finite)

    def component(x: Column) -> Column:
        # floor() of a double gives a long; beyond its range a double is whole already
        scaled = F.lit(scale) * x.cast("double")
        return F.when(F.abs(scaled) < float(1 << 62), F.floor(scaled).cast("double")).otherwise(scaled)

    v = F.transform("embedding", component)
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack_rows(ids: list[int], rows: list[np.ndarray]) -> tuple[bytes, int, bytes]:
    dims = max((len(r) for r in rows), default=0)
    lanes = np.zeros((dims, len(rows)))
    for i, r in enumerate(rows):
        lanes[: len(r), i] = r
    return np.array(ids, dtype=np.int64).tobytes(), dims, lanes.tobytes()


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Blocks of at most ``BLOCK`` vectors of one ``key``, dimension by dimension; rows must come sorted by it."""
    carried = [c for c in rows.columns if c not in ("vec_id", "v", key)]
    names = [key, "vec_id", "v", *carried]
    extra = "".join(f", {c} binary" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "ids": [], "rows": [], "extra": [[] for _ in carried]}

        def flush() -> Iterator[pa.RecordBatch]:
            if held["ids"]:
                more = [np.array(x, dtype=np.float64).tobytes() for x in held["extra"]]
                values = (held["key"], *_pack_rows(held["ids"], held["rows"]), *more)
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), *[pa.binary()] * len(more)]
                columns = [pa.array([x], t) for x, t in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "dims", "lanes", *carried])
            held["ids"], held["rows"], held["extra"] = [], [], [[] for _ in carried]

        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            for i in range(batch.num_rows):
                at = batch.column(0)[i].as_py()
                if at != held["key"] or len(held["ids"]) >= BLOCK:
                    yield from flush()
                    held["key"] = at
                held["ids"].append(batch.column(1)[i].as_py())
                held["rows"].append(flat[ends[i - 1] if i else 0 : ends[i]])
                for x, c in zip(held["extra"], range(3, 3 + len(carried))):
                    x.append(batch.column(c)[i].as_py())
        yield from flush()

    return rows.select(*names).mapInArrow(run, f"{key} long, {PACKED}{extra}")


class _Block:
    """A packed block: ``ids``, ``lanes`` (dimension x vector) and norms of what is left from each step on."""

    def __init__(self, ids: bytes, dims: int, lanes: bytes, all_dims: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        own = np.frombuffer(lanes).reshape(dims, len(self.ids))
        self.lanes = own if dims == all_dims else np.concatenate((own, np.zeros((all_dims - dims, len(self.ids)))))
        steps = range(0, all_dims, STEP)
        mass = [np.zeros(len(self.ids))]
        for a in reversed(steps):
            mass.append(mass[-1] + np.square(self.lanes[a : a + STEP]).sum(axis=0))
        # rounded up, so that a bound is never too low
        self.left = np.sqrt(np.array(mass[::-1])) * (1 + 1e-12)


def _survivors(q: _Block, c: _Block, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs that reach their query's threshold."""
    dims = len(c.lanes)
    found = []
    for first in range(0, len(q.ids), TILE):
        tile = slice(first, min(first + TILE, len(q.ids)))
        lanes, floor = q.lanes[:, tile], threshold[tile]
        columns = np.arange(len(c.ids))
        mine, left = c.lanes, c.left
        score = np.zeros((lanes.shape[1], len(columns)))
        pairs = None
        for step, a in enumerate(range(0, dims, STEP)):
            if pairs is None:
                score += lanes[a : a + STEP].T @ mine[a : a + STEP]
                alive = score + q.left[step + 1, tile][:, None] * left[step + 1] >= floor[:, None]
                count = int(alive.sum())
                if count <= FEW * alive.size:
                    pairs = np.nonzero(alive)
                    score = score[pairs]
                else:
                    some = alive.any(axis=0)
                    if some.mean() < 0.75:
                        columns, score = columns[some], score[:, some]
                        mine, left = mine[:, some], left[:, some]
            else:
                i, j = pairs
                for d in range(a, min(a + STEP, dims)):
                    score += lanes[d, i] * mine[d, j]
                alive = score + q.left[step + 1, tile][i] * left[step + 1, j] >= floor[i]
                pairs, score = (i[alive], j[alive]), score[alive]
        if pairs is None:
            pairs = np.nonzero(score >= floor[:, None])
            score = score[pairs]
        found.append((pairs[0] + first, columns[pairs[1]], score))
    i, j, s = (np.concatenate(x) for x in zip(*found))
    return i, c.ids[j], s


def _survivors_exact(q: _Block, c: _Block, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs, with Python's integers, for components too large for exact sums of doubles."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    a, b = whole(q.lanes), whole(c.lanes)
    most, least = (1 << 63) - 1, -(1 << 63)
    i, j = np.nonzero(np.ones((len(q.ids), len(c.ids)), dtype=bool))
    score = np.array([min(most, max(least, int(sum(a[:, x] * b[:, y])))) for x, y in zip(i, j)], dtype=object)
    return i, c.ids[j], score


class _Best:
    """The k best candidates of each query of a block, and the threshold they set."""

    def __init__(self, q_ids: np.ndarray, k: int, floor: np.ndarray):
        self.q_ids, self.k, self.floor = q_ids, k, floor
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query_: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = self.q_ids[query_] != ids
        query_ = np.concatenate((self.query, query_[other]))
        ids = np.concatenate((self.ids, ids[other]))
        score = np.concatenate((self.score, score[other]))
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda x: (query_[x], -score[x], ids[x])), dtype=np.int64)
        else:
            order = np.lexsort((ids, -score, query_))
        query_, ids, score = query_[order], ids[order], score[order]
        first = np.searchsorted(query_, query_, side="left")
        place = np.arange(len(query_)) - first
        last = place == self.k - 1
        for at, s in zip(query_[last], score[last]):
            # a float threshold is never above the exact score
            f = float(s)
            self.floor[at] = max(self.floor[at], f if f <= s else np.nextafter(f, -np.inf))
        keep = place < self.k
        self.query, self.ids, self.score = query_[keep], ids[keep], score[keep]


def _cells(cells: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each (query block, stripe); its query block comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            for _, best in asked:
                values = (best.q_ids[best.query], best.ids, np.array([int(s) for s in best.score], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in values], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                if (x["asks"], x["stripe"]) != cell:
                    yield from answer()
                    cell, asked = (x["asks"], x["stripe"]), []
                if x["floor"] is not None:
                    asked.append((x, _Best(np.frombuffer(x["ids"], dtype=np.int64), k, np.frombuffer(x["floor"]).copy())))
                    continue
                for q, best in asked:
                    dims = max(q["dims"], x["dims"])
                    if q.get("at") != dims:
                        q |= {"at": dims, "block": _Block(q["ids"], q["dims"], q["lanes"], dims)}
                    a, b = q["block"], _Block(x["ids"], x["dims"], x["lanes"], dims)
                    large = a.left[0].max(initial=0) * b.left[0].max(initial=0) >= EXACT
                    best.add(*(_survivors_exact if large else _survivors)(a, b, best.floor))
        yield from answer()

    return cells.select("asks", "stripe", "ids", "dims", "lanes", "floor").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, asked: str, k: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the vectors chosen by ``asked`` (SQL on ``vec_id``) the k best others."""
    every = stored(whole_vectors(vectors, scale), "search-vectors")
    queries = every.filter(asked)
    blocks = max(1, -(-queries.count() // block))  # of queries
    asks = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    h = F.xxhash64("vec_id", F.lit("wave"))
    best, before = None, F.lit(False)
    for wave, share in enumerate(WAVES):
        now = ~before & (F.pmod(h, F.lit(share)) == 0)
        before = before | (F.pmod(h, F.lit(share)) == 0)
        taken = packed(every.filter(now).withColumn("part", F.lit(0).cast("long")), "part").drop("part")
        taken = stored(taken, "search-candidates").withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(STRIPES)))
        floor = F.lit(float("-inf"))
        if best is None:
            known = queries.withColumn("floor", floor)
        else:
            known = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
            # a score beyond 2**53 is rounded down
            low = F.col("worst").cast("double") * F.when(F.abs("worst") < 1 << 53, 1.0).when(F.col("worst") > 0, 1 - 1e-15).otherwise(1 + 1e-15)
            known = queries.join(known, "vec_id", "left").withColumn("floor", F.coalesce(low, floor)).drop("worst")
        known = known.withColumn("asks", asks.cast("long")).repartition("asks").sortWithinPartitions("asks")
        known = stored(packed(known, "asks"), "search-queries")
        left = known.withColumn("stripe", F.explode(F.expr(f"sequence(0L, {STRIPES - 1}L)")))
        right = taken.withColumn("asks", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).withColumn("floor", F.lit(None).cast("binary"))
        cells = left.unionByName(right).repartition("asks", "stripe")
        cells = cells.sortWithinPartitions("asks", "stripe", F.col("floor").isNull())
        found = _cells(cells, k)
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best if wave == len(WAVES) - 1 else stored(best, "search-best")
    return best.select("query_id", "rank", "vec_id", "score")


@query(
    "op12_exact_top_k",
    oracle="""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
