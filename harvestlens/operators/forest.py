"""Random forest and boosted trees regression on coded columns.

A column holds a bin or a category of few values, and every category is a 0/1 feature of its own. A row thus
has one entry per column in the sums of its node, however many categories there are; MLlib's forest turns it
into one number per feature. Trees are grown as MLlib grows them: bootstrap by Poisson weights, a fresh subset
of the features at each node, the split with the greatest reduction of variance. Boosted trees take all rows
and features, one tree after the other, each on what those before it left over.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.functions.columns import col, number

CODES = "_codes"  # column of blocks of codes
BAG = "_bag"  # column of 64 random bits, from which every tree draws the weight of a row
HISTOGRAM_BYTES = 64 << 20  # sums that a task holds at once; nodes beyond that wait for another pass
BLOCK = 32_768  # rows of a block
TASK_BYTES = 32 << 20  # codes and labels that a task of boosting reads
PACKED = 256  # codes of columns that are summed together
CHAIN = 10  # boosted trees after which errors are worked out from the labels again, so that no plan grows on
_NODES = {
    "tree": "int", "column": "int", "low": "int", "high": "int", "child": "long",
    "feature": "int", "gain": "double", "prediction": "double",
}
_ERROR = "_error"  # column of what trees left over
_BEST = "node long, column int, low int, high int, feature int, gain double, n_left double, n_right double, left double, right double"


def coded(column, name: str, bins: int, ordered: bool):
    """A column of codes 0 to bins - 1 that a forest reads; nulls and what is beyond take the last code."""
    code = F.least(F.coalesce(column.cast("int"), F.lit(bins - 1)), F.lit(bins - 1))
    return code.alias(name, metadata={"bins": bins, "ordered": ordered})


def thresholds(values: np.ndarray, bins: int) -> list[float]:
    """Cuts between values: all if they are few, else those next to the quantiles."""
    found = np.unique(values[np.isfinite(values)])
    if len(found) <= bins:
        return np.unique(found[1:] / 2 + found[:-1] / 2).tolist()
    cuts = np.quantile(values[np.isfinite(values)], np.arange(1, bins) / bins, method="lower")
    above = np.searchsorted(found, np.unique(cuts), side="right")
    above = above[above < len(found)]
    return np.unique(found[above - 1] / 2 + found[above] / 2).tolist()


@dataclass
class _Layout:
    """Codes and features of the columns: an ordered column is one feature, any other one per code but the last."""

    names: list[str]
    bins: list[int]
    ordered: list[bool]

    @classmethod
    def of(cls, df: DataFrame) -> "_Layout":
        fields = [f for f in df.schema.fields if "bins" in f.metadata]
        return cls(
            [f.name for f in fields], [f.metadata["bins"] for f in fields], [f.metadata["ordered"] for f in fields]
        )

    @property
    def kind(self) -> np.dtype:
        return np.min_scalar_type(max(self.bins))

    @property
    def rows_a_task(self) -> int:
        """Rows of ``TASK_BYTES`` with one label. Boosting has short tasks for every level of every tree: starting them counts."""
        return max(1, TASK_BYTES // (len(self.bins) * self.kind.itemsize + 8))

    @property
    def packs(self) -> list[list[int]]:
        """Columns that are summed together: with few codes jointly, or one by one."""
        packs: list[list[int]] = []
        for j in sorted(range(len(self.bins)), key=lambda j: -self.bins[j]):
            fits = [p for p in packs if math.prod(self.bins[i] for i in p) * self.bins[j] <= PACKED]
            if fits:
                fits[0].append(j)
            else:
                packs.append([j])
        return packs

    @property
    def features(self) -> int:
        return sum(1 if o else b - 1 for b, o in zip(self.bins, self.ordered, strict=True))

    def candidates(self) -> dict[str, np.ndarray]:
        """For every code: its column, what it is in there, and the feature that it can split by (-1: none)."""
        column = np.repeat(np.arange(len(self.bins)), self.bins)
        code = np.concatenate([np.arange(b) for b in self.bins])
        feature, first = [], 0
        for b, o in zip(self.bins, self.ordered, strict=True):
            feature += [-1] + [first] * (b - 1) if o else [*range(first, first + b - 1), -1]
            first += 1 if o else b - 1
        return {"column": column, "code": code, "feature": np.array(feature), "ordered": np.array(self.ordered)[column]}


@dataclass
class Coding:
    """How the columns of a table become codes inside a task: numbers by the cuts between bins, categories by their labels.

    Nulls, NaN and labels that are not listed take the last code, as with ``coded``.
    """

    cuts: dict[str, list[float]]
    labels: dict[str, list[str]]

    @property
    def layout(self) -> _Layout:
        bins = [len(x) + 1 for x in (*self.cuts.values(), *self.labels.values())]
        names = [*[f"_code_b_{c}" for c in self.cuts], *[f"_code_i_{c}" for c in self.labels]]
        return _Layout(names, bins, [i < len(self.cuts) for i in range(len(bins))])

    @property
    def inputs(self) -> list[Column]:
        return [*[number(c) for c in self.cuts], *[col(c).cast("string") for c in self.labels]]

    def codes(self, columns: Sequence[pa.Array | pa.ChunkedArray]) -> np.ndarray:
        """A line of codes per column of ``inputs``."""
        out = np.empty((len(columns), len(columns[0])), self.layout.kind)
        for line, column, cuts in zip(out, columns, self.cuts.values(), strict=False):
            line[:] = np.searchsorted(cuts, np.asarray(column, "float64"), side="right")
        for line, column, labels in zip(out[len(self.cuts) :], columns[len(self.cuts) :], self.labels.values(), strict=True):
            found = pc.index_in(column, value_set=pa.array(labels, column.type))
            line[:] = np.asarray(found.fill_null(len(labels)))
        return out


def _as_codes(columns: Sequence[pa.Array | pa.ChunkedArray], layout: _Layout, coding: Coding | None) -> np.ndarray:
    if coding:
        return coding.codes(columns)
    return np.stack([np.asarray(c).astype(layout.kind) for c in columns])


def _features_per_node(strategy: str, features: int, trees: int) -> int:
    """As MLlib reads ``featureSubsetStrategy``."""
    if strategy == "auto":
        strategy = "onethird" if trees > 1 else "all"
    named = {"all": features, "onethird": features / 3, "sqrt": math.sqrt(features), "log2": math.log2(max(features, 2))}
    if strategy in named:
        share = named[strategy]
    elif strategy.isdecimal() and int(strategy) > 0:
        share = int(strategy)
    elif 0 < float(strategy) <= 1:
        share = float(strategy) * features
    else:
        raise ValueError(f"featureSubsetStrategy {strategy!r}")
    return max(1, min(features, math.ceil(share)))


def _walked(nodes: dict, kind: np.dtype) -> dict:
    kinds = {"column": np.int64, "child": np.int64, "low": kind, "high": kind}
    return {k: np.asarray(nodes[k], t) for k, t in kinds.items()}


def _reached(nodes: dict, codes: np.ndarray, rows: np.ndarray, root: int, steps: int) -> np.ndarray:
    """The node of a tree that each of the rows gets to; ``codes`` has a line per column."""
    flat, first = codes.ravel(), nodes["column"] * codes.shape[1]
    at = np.full(len(rows), root)
    for _ in range(steps):
        code = flat.take(first.take(at) + rows)
        right = (code >= nodes["low"].take(at)) & (code <= nodes["high"].take(at))
        at = nodes["child"].take(at) + right
    return at


def blocks(df: DataFrame, targets: Sequence[str], coding: Coding | None = None) -> DataFrame:
    """Codes, targets and ``BAG`` (if rows have it) as arrays of many rows, which reach Python as they are.

    With a ``coding`` rows are coded on the way, else the columns are coded already.
    """
    layout = coding.layout if coding else _Layout.of(df)
    inputs = coding.inputs if coding else [col(c) for c in layout.names]
    kinds = {**dict.fromkeys(targets, "float64"), **({BAG: "int64"} if BAG in df.columns else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            codes = _as_codes(part.columns[: len(layout.names)], layout, coding)
            rest = [c.to_numpy() for c in part.columns[len(layout.names) :]]
            held = [codes, *[x.astype(kind) for x, kind in zip(rest, kinds.values(), strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], names=[CODES, *kinds])

    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in (CODES, *kinds)])
    meta = {"names": layout.names, "bins": layout.bins, "ordered": layout.ordered}
    given = [c.alias(f"_{i}") for i, c in enumerate([*inputs, *[col(c) for c in kinds]])]
    made = df.select(*given).mapInArrow(run, schema)
    return made.withColumn(CODES, col(CODES).alias(CODES, metadata=meta))


def _arrays(batches: Iterator[pa.RecordBatch], *kinds: np.dtype) -> Iterator[list[np.ndarray]]:
    """The arrays of each block."""
    for batch in batches:
        for held in zip(*batch.columns, strict=True):
            yield [np.frombuffer(x.as_buffer(), k) for x, k in zip(held, kinds, strict=False)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _label_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, labels that are missing or infinite, and the sum of the others."""
    for (y,) in _arrays(batches, np.float64):
        good = np.isfinite(y)
        row = [len(y), int(len(y) - good.sum()), float(y[good].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["n", "bad", "total"])


def _poisson_of_bits() -> np.ndarray:
    """Weight (Poisson with mean 1) of each 16-bit number."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    return np.searchsorted(upto, (np.arange(65_536) + 0.5) / 65_536).astype(np.float64)


def _joint(codes: np.ndarray, pack: Sequence[int], bins: Sequence[int]) -> np.ndarray:
    """One code for the columns of a pack, the last one changing fastest."""
    out = codes[pack[0]].astype(np.int64)
    for j in pack[1:]:
        out = out * bins[j] + codes[j]
    return out


def _sums(layout: _Layout, nodes: dict, group: np.ndarray, tree: np.ndarray, steps: int, center: float, seed: int):
    """Per task: weight and weighted label of the rows at each node of the group, by column and code.

    Without bits of a bag all rows weigh 1.
    """
    walked, weights, packs = _walked(nodes, layout.kind), _poisson_of_bits(), layout.packs
    trees = [(int(t), group[tree == t]) for t in np.unique(tree)]
    draws = np.random.default_rng(seed).integers(1 << 62, size=int(tree.max()) + 1, dtype=np.uint64) * 2 + 1
    starts, shapes = np.cumsum([0, *layout.bins]), [[layout.bins[j] for j in pack] for pack in packs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last slot takes rows that are at no node of the group
        held = [[np.zeros((2, (len(own) + 1) * math.prod(shape))) for shape in shapes] for _, own in trees]
        slots = []
        for _, own in trees:
            slots.append(np.full(len(walked["child"]), len(own)))
            slots[-1][own] = np.arange(len(own))
        for codes, y, *bits in _arrays(batches, layout.kind, np.float64, np.uint64):
            codes, y = codes.reshape(len(layout.names), -1), y - center
            joint = [_joint(codes, pack, layout.bins) for pack in packs]
            for (t, own), slot, into in zip(trees, slots, held, strict=True):
                w = weights.take(((bits[0] * draws[t]) >> np.uint64(48)).view(np.int64)) if bits else None
                rows = np.flatnonzero(w) if bits else np.arange(len(y))
                place = slot.take(_reached(walked, codes, rows, t, steps))
                inside = place < len(own)
                if inside.sum() < 0.7 * len(inside):
                    rows, place = rows[inside], place[inside]
                w, wy, *found = (x if x is None or len(rows) == len(x) else x.take(rows) for x in (w, y, *joint))
                wy = wy if w is None else w * wy
                for code, shape, sums in zip(found, shapes, into, strict=True):
                    at = place * math.prod(shape) + code
                    sums[0] += np.bincount(at, w, sums.shape[1])
                    sums[1] += np.bincount(at, wy, sums.shape[1])
        for (_, own), into in zip(trees, held, strict=True):
            for pack, shape, sums in zip(packs, shapes, into, strict=True):
                sums = sums.reshape(2, len(own) + 1, *shape)[:, :-1]
                for i, j in enumerate(pack):
                    others = tuple(2 + k for k in range(len(pack)) if k != i)
                    w, wy = sums.sum(axis=others).reshape(2, -1)
                    at, b = np.flatnonzero(w), layout.bins[j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at // b]), pa.array(starts[j] + at % b), pa.array(w[at]), pa.array(wy[at])],
                        names=["node", "code", "w", "wy"],
                    )

    return run


def _best_split(layout: _Layout, wanted: int, least: int, center: float, seed: int):
    """The split of a node that lessens the variance most, among features drawn for it; no row if there is none."""
    c, features = layout.candidates(), layout.features
    spans = [(int(s), int(s) + b) for s, b, o in zip(np.cumsum([0, *layout.bins]), layout.bins, layout.ordered, strict=False) if o]

    def run(sums: pa.Table) -> pa.Table:
        node, found = sums.column("node")[0].as_py(), {k: [] for k in (f.split()[0] for f in _BEST.split(", "))}
        w, wy = np.zeros(len(c["code"])), np.zeros(len(c["code"]))
        w[sums.column("code").to_numpy()], wy[sums.column("code").to_numpy()] = sums.column("w"), sums.column("wy")
        n, total = w[: layout.bins[0]].sum(), wy[: layout.bins[0]].sum()
        for a, b in spans:  # what lies right of a cut
            w[a:b], wy[a:b] = w[a:b][::-1].cumsum()[::-1], wy[a:b][::-1].cumsum()[::-1]
        drawn = np.zeros(features + 1, bool)  # the last one stands for no feature
        drawn[np.random.default_rng([seed, node]).permutation(features)[:wanted]] = True
        at = np.flatnonzero(drawn[c["feature"]] & (w >= least) & (n - w >= least))
        right, rest = wy[at] ** 2 / w[at], (total - wy[at]) ** 2 / (n - w[at])
        gain = right + rest - total**2 / n
        if len(at) and gain.max() > 1e-12 * total**2 / n:
            i = at[gain.argmax()]
            ordered, code = bool(c["ordered"][i]), int(c["code"][i])
            row = (
                node, int(c["column"][i]), code, layout.bins[c["column"][i]] - 1 if ordered else code, int(c["feature"][i]), float(gain.max()),
                float(n - w[i]), float(w[i]), center + (total - wy[i]) / (n - w[i]), center + wy[i] / w[i],
            )
            for k, v in zip(found, row, strict=True):
                found[k].append(v)
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        types = dict(f.split() for f in _BEST.split(", "))
        return pa.table({k: pa.array(v, kinds[types[k]]) for k, v in found.items()})

    return run


def _errors(layout: _Layout, nodes: dict, trees: Sequence[int], depth: int):
    """Blocks of codes and errors, less what the trees predict of these."""
    walked, leaf = _walked(nodes, layout.kind), np.array(nodes["prediction"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, error in _arrays(batches, layout.kind, np.float64):
            lines, rows = codes.reshape(len(layout.names), -1), np.arange(len(error))
            left = error - sum(leaf.take(_reached(walked, lines, rows, t, depth)) for t in trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (codes, left)], names=[CODES, _ERROR]
            )

    return run


class _Regressor:
    """Settings have MLlib's names, defaults and meaning."""

    def __init__(self, trees: int, depth: int, least: int, seed: int):
        self.trees, self.depth, self.least, self.seed, self.label = int(trees), int(depth), int(least), int(seed), "label"

    def copy(self) -> "_Regressor":
        return copy.copy(self)

    def setLabelCol(self, name: str) -> "_Regressor":
        self.label = name
        return self

    def _start(self, df: DataFrame) -> tuple[_Layout, float]:
        """The columns of the blocks and the mean label."""
        meta = df.schema[CODES].metadata
        seen = df.select(col(self.label)).mapInArrow(_label_sums, "n long, bad long, total double")
        rows, wrong, total = seen.agg(F.sum("n"), F.sum("bad"), F.sum("total")).first()
        if not rows or wrong:
            raise ValueError(f"labels {self.label!r} of {rows or 0} training rows, {wrong or 0} of them null or not finite")
        return _Layout(meta["names"], meta["bins"], meta["ordered"]), total / rows

    def _add(self, nodes: dict, tree: int, prediction: float) -> int:
        node = len(nodes["tree"])
        for k, v in zip(nodes, (tree, 0, 1, 0, node, -1, 0.0, prediction), strict=True):
            nodes[k].append(v)
        return node

    def _grow(self, df: DataFrame, nodes: dict, roots: Sequence[int], layout: _Layout, center: float, wanted: int) -> None:
        """Add the nodes below the roots; ``df`` has codes, labels and perhaps bits of a bag.

        It is read once per level of the trees, or more often where a level has many nodes.
        """
        seed = self.seed % (1 << 63)
        waiting = [(root, 0) for root in roots] if self.depth else []
        most = max(1, HISTOGRAM_BYTES // (16 * sum(math.prod(layout.bins[j] for j in p) for p in layout.packs)))
        while waiting:
            turn, waiting = dict(waiting[:most]), waiting[most:]
            group = np.array(list(turn))
            sums = _sums(layout, nodes, group, np.array(nodes["tree"])[group], max(turn.values()), center, seed)
            partial = df.mapInArrow(sums, "node long, code long, w double, wy double")
            whole = partial.groupBy("node", "code").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
            best = whole.groupBy("node").applyInArrow(_best_split(layout, wanted, self.least, center, seed), _BEST)
            for s in sorted(best.collect()):
                left = self._add(nodes, nodes["tree"][s.node], s.left)
                self._add(nodes, nodes["tree"][s.node], s.right)
                for k, v in (("column", s.column), ("low", s.low), ("high", s.high), ("child", left),
                             ("feature", s.feature), ("gain", s.gain)):
                    nodes[k][s.node] = v
                for child, n in ((left, s.n_left), (left + 1, s.n_right)):
                    if turn[s.node] + 1 < self.depth and n >= 2 * self.least:
                        waiting.append((child, turn[s.node] + 1))


class ForestRegressor(_Regressor):
    """Random forest."""

    def __init__(
        self,
        numTrees: int = 20,
        maxDepth: int = 5,
        minInstancesPerNode: int = 1,
        featureSubsetStrategy: str = "auto",
        seed: int = 42,
    ):
        super().__init__(numTrees, maxDepth, minInstancesPerNode, seed)
        self.strategy = featureSubsetStrategy
        if self.trees < 1 or self.depth < 0 or self.least < 1:
            raise ValueError(f"numTrees {numTrees}, maxDepth {maxDepth}, minInstancesPerNode {minInstancesPerNode}")

    def fit(self, df: DataFrame) -> "Forest":
        """``df``: made by ``blocks`` of rows with a bag."""
        layout, center = self._start(df)
        nodes = {k: [] for k in _NODES}
        roots = [self._add(nodes, t, center) for t in range(self.trees)]
        wanted = _features_per_node(self.strategy, layout.features, self.trees)
        self._grow(df.select(CODES, col(self.label), BAG), nodes, roots, layout, center, wanted)
        nodes = {k: np.array(v) for k, v in nodes.items()}
        return Forest(nodes, layout.names, layout.bins, layout.features, self.trees, self.depth)


class BoostedRegressor(_Regressor):
    """Gradient boosting of the squared error: the first tree counts in full, all others by the step."""

    def __init__(
        self, maxIter: int = 20, maxDepth: int = 5, minInstancesPerNode: int = 1, stepSize: float = 0.1, seed: int = 42
    ):
        super().__init__(maxIter, maxDepth, minInstancesPerNode, seed)
        self.step = float(stepSize)
        if self.trees < 1 or self.depth < 0 or self.least < 1 or not 0 < self.step <= 1:
            raise ValueError(
                f"maxIter {maxIter}, maxDepth {maxDepth}, minInstancesPerNode {minInstancesPerNode}, stepSize {stepSize}"
            )

    def fit(self, df: DataFrame) -> "Boosted":
        """``df``: made by ``blocks``. The errors that a tree leaves are kept on disk, next to the codes, for the next one."""
        layout, center = self._start(df)
        nodes = {k: [] for k in _NODES}
        # leaves are means, so what is left over has mean 0 from the second tree on
        roots = [self._add(nodes, t, 0.0 if t else center) for t in range(self.trees)]
        labels = df.select(CODES, col(self.label).alias(_ERROR))
        errors, kept = labels, None
        try:
            for t, root in enumerate(roots):
                before = kept
                if t:
                    since = range(t) if t % CHAIN == 0 else [t - 1]
                    errors = labels if t % CHAIN == 0 else errors
                    errors = errors.mapInArrow(_errors(layout, nodes, since, self.depth), errors.schema)
                    errors = kept = errors.persist(StorageLevel.DISK_ONLY)
                first = len(nodes["tree"])
                self._grow(errors, nodes, [root], layout, nodes["prediction"][root], layout.features)
                if t:  # the gradient is twice the error
                    for node in (root, *range(first, len(nodes["tree"]))):
                        nodes["prediction"][node] *= 2 * self.step
                        nodes["gain"][node] *= 4
                if before:
                    before.unpersist()
        finally:
            if kept:
                kept.unpersist()
        nodes = {k: np.array(v) for k, v in nodes.items()}
        return Boosted(nodes, layout.names, layout.bins, layout.features, self.trees, self.depth)


@dataclass
class Forest:
    """Fitted trees: a row goes from a node to ``child``, or the one after it if ``low <= code <= high``."""

    nodes: dict
    names: list[str]
    bins: list[int]
    features: int
    trees: int
    depth: int
    prediction: str = "prediction"

    def setPredictionCol(self, name: str) -> "Forest":
        self.prediction = name
        return self

    def setFeaturesCol(self, _: str) -> "Forest":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the trees' joint prediction."""
        return predictions(df, {self.prediction: self})

    @property
    def shares(self) -> int:
        """What the sum of the trees' predictions is divided by."""
        return self.trees

    def _gains(self, tree: int) -> np.ndarray:
        own = (self.nodes["tree"] == tree) & (self.nodes["feature"] >= 0)
        gains = np.bincount(self.nodes["feature"][own], self.nodes["gain"][own], self.features)
        return gains / gains.sum() if gains.sum() else gains

    @property
    def featureImportances(self) -> DenseVector:
        """Reduction of variance by feature, each tree's adding up to one before they are summed."""
        total = sum(self._gains(t) for t in range(self.trees))
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def save(self, spark: SparkSession, path: str) -> None:
        table = pd.DataFrame({"node": np.arange(len(self.nodes["tree"])), **self.nodes})
        schema = ", ".join(["node long", *[f"{k} {v}" for k, v in _NODES.items()]])
        spark.createDataFrame(table, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, names: Sequence[str], bins: Sequence[int], features: int, trees: int, depth: int
    ) -> "Forest":
        table = spark.read.parquet(path).toPandas().sort_values("node")
        return cls({k: table[k].to_numpy() for k in _NODES}, list(names), list(bins), features, trees, depth)


class Boosted(Forest):
    """Trees whose predictions, times their weight already, add up; importances are those of all trees' reductions."""

    @property
    def shares(self) -> int:
        return 1

    def _gains(self, tree: int) -> np.ndarray:
        own = (self.nodes["tree"] == tree) & (self.nodes["feature"] >= 0)
        return np.bincount(self.nodes["feature"][own], self.nodes["gain"][own], self.features)


def predictions(df: DataFrame, forests: Mapping[str, Forest], coding: Coding | None = None) -> DataFrame:
    """Add the joint prediction of the trees of each forest under its name; a row is coded and sent to Python once for all of them."""
    one = next(iter(forests.values()))
    layout = coding.layout if coding else _Layout(one.names, one.bins, [])
    walked = [(_walked(f.nodes, layout.kind), f.nodes["prediction"], f.trees, f.shares, f.depth) for f in forests.values()]

    def means(*columns: pa.Array) -> pa.Array:
        codes = _as_codes(columns, layout, coding)
        rows = np.arange(codes.shape[1])
        found = [
            sum(leaf.take(_reached(nodes, codes, rows, t, depth)) for t in range(trees)) / shares
            for nodes, leaf, trees, shares, depth in walked
        ]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in found], [f"_{i}" for i in range(len(found))])

    means.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    kind = "struct<" + ", ".join(f"_{i}: double" for i in range(len(forests))) + ">"
    inputs = coding.inputs if coding else [col(c) for c in layout.names]
    found = df.withColumn("_means", F.arrow_udf(means, kind)(*inputs))
    return found.withColumns({name: F.col("_means")[f"_{i}"] for i, name in enumerate(forests)}).drop("_means")
