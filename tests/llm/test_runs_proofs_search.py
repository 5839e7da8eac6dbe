"""Periodic runs, Merkle manifest and exact top-k search against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens.llm import merkle, periods, topk
from tests.llm.data import awkward_docs, empty_docs


def slow_runs(words, least=periods.LEAST):
    """Every stretch of every lag, the smallest lag of a stretch first."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_runs(seed):
    draw = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            block = [draw.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"]) for _ in range(1)][0]
            piece = draw.choices(block, k=draw.randint(1, 30))
            words += piece * draw.randint(1, 5) if kind < 0.6 else piece
            words += piece[: draw.randint(0, len(piece))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_every_stretch(seed):
    texts = texts_with_runs(seed) + [["a"] * 400, list("ab" * 90 + "c" + "ab" * 90), [], ["x"], ["y"] * 12, ["z"] * 11]
    encoded = [[w.encode() for w in t] for t in texts]
    assert periods._texts_runs(encoded, periods.LEAST) == [slow_runs(t) for t in texts]


def test_fibonacci_words_and_equal_neighbours():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    texts = [list(b), list(b), list("abcdefghij" * 2), list("abcdefghij" * 2)]
    assert periods._texts_runs([[w.encode() for w in t] for t in texts], 12) == [slow_runs(t) for t in texts]


def test_long_periodic_texts_take_linear_time():
    draw = random.Random(1)
    texts = [[b"a"] * 300_000, [b"a", b"b", b"c"] * 100_000, [b"%d" % draw.randrange(9) for _ in range(100_000)] * 3]
    started = time.time()
    one, three, long = periods._texts_runs(texts, 12)
    assert one == [(0, 300_000, 1)] and three == [(0, 300_000, 3)] and (0, 300_000, 100_000) in long
    assert time.time() - started < 60


def test_query_columns_by_brute_force(spark):
    docs = awkward_docs(spark)
    got = periods.periodic_runs(docs, planted=periods.planted_repeats).collect()
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    want = []
    for doc_id, text in texts:
        words = [w.decode() for w in periods.planted_repeats(doc_id if doc_id >= 0 else None, text.encode().split())]
        runs = slow_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    assert have == sorted(want)
    assert any(x[2] for x in have)


def test_no_documents(spark):
    assert periods.periodic_runs(empty_docs(spark)).count() == 0
    assert merkle.manifest(empty_docs(spark)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_tree(nodes):
    """(root, siblings of each node as (left, right) from the lowest level on)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i - i % merkle.FAN
            paths[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + merkle.FAN])))
            at[leaf] = i // merkle.FAN
        level = [h(*level[i : i + merkle.FAN]) for i in range(0, len(level), merkle.FAN)]
    return level[0], paths


def slow_manifest(rows):
    by_source = {}
    for r in rows:
        key = () if r.source is None else (r.source.encode(),)
        leaf = h(*[sized(r[f]) for f in merkle.FIELDS])
        by_source.setdefault(key, []).append(((r.doc_id is not None, r.doc_id or 0, leaf), leaf, r.doc_id))
    sources = sorted(by_source)
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: x[0])
        trees[s] = slow_tree([x[1] for x in by_source[s]])
    root, tops = slow_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, leaf, doc_id), path in zip(by_source[s], trees[s][1]):
            out.append((repr(doc_id), leaf, trees[s][0], root, [*path, *top]))
    return sorted(out)


def many_docs(spark):
    rows = awkward_docs(spark)
    more = spark.range(1000, 1700).selectExpr(
        "id AS doc_id", "concat('Text ', id) AS text", "'aa' AS lang",
        "CASE WHEN id < 1290 THEN 'hot' WHEN id < 1307 THEN 'é' ELSE concat('t', id % 23) END AS source",
        "id AS n_chars", "0.5D AS score", "'x' AS kept", "'y' AS _w",
    )
    return rows.union(more)


def test_manifest_equals_brute_force(spark):
    docs = many_docs(spark)
    rows = merkle.manifest(docs).collect()
    got = sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in rows)
    assert got == slow_manifest(docs.collect())


@pytest.mark.parametrize("keep", ["doc_id = 3", "source = 's0'", "source IS NULL"])
def test_small_trees(spark, keep):
    docs = awkward_docs(spark).filter(keep)
    rows = merkle.manifest(docs).collect()
    got = sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in rows)
    assert got == slow_manifest(docs.collect())


def test_only_changed_rows_fail(spark):
    docs = many_docs(spark)
    found = merkle.manifest(docs, F.col("doc_id") % 7 == 0, F.upper)
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("steps"))
    rows = found.select("doc_id", "other", (folded == F.col("root")).alias("ok"), "leaf").collect()
    assert {r.ok for r in rows if r.doc_id is None or r.doc_id % 7} == {True}
    assert all(r.ok == (r.other == r.leaf) for r in rows if r.doc_id is not None and r.doc_id % 7 == 0)
    assert sum(not r.ok for r in rows) > 90


def vectors(spark, n=400, dims=40, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, dims))
    base[n // 3 : n // 2] = base[0]  # copies: ties everywhere
    base[n // 2 : n // 2 + 40] = base[1] + 0.01 * draw.normal(size=(40, dims))
    rows = [(i, [float(x) for x in v], "k") for i, v in enumerate(base)]
    rows += [(1001, None, "k"), (1002, [None] + [1.0] * (dims - 1), "k"), (1003, [float("nan")] * dims, "k"), (1004, [float("inf")] * dims, "k")]
    rows += [(None, [1.0] * dims, "k"), (1020, [], "k"), (1040, [3.0, -2.5], "k"), (1005, [0.0] * dims, "k"), (1005, [1.0] * dims, "k"), (5, rows[5][1], "k")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def slow_search(rows, asked, k, scale=64):
    whole = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(scale * x)) for x in v]
        whole[r.vec_id] = min(whole.get(r.vec_id, w), w)
    out = []
    for q, a in whole.items():
        if asked(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_search_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STRIPES", 5)
    data = vectors(spark)
    got = sorted(tuple(r) for r in topk.top_k(data, "vec_id % 20 = 0", k=6, block=block).collect())
    assert got == slow_search(data.collect(), lambda i: i % 20 == 0, 6)


def test_search_of_fewer_than_k_and_of_none(spark):
    few = vectors(spark).filter("vec_id < 5")
    got = sorted(tuple(r) for r in topk.top_k(few, "vec_id < 2", k=20).collect())
    assert got == slow_search(few.collect(), lambda i: i < 2, 20) and len(got) == 8
    assert topk.top_k(few, "vec_id > 50").count() == 0
    assert topk.top_k(few.limit(0), "vec_id < 2").count() == 0


def test_components_too_large_for_doubles(spark):
    rows = [(0, [float(1 << 24), 1.0]), (1, [float(1 << 25), 3.0]), (2, [float(1 << 25), 2.0]), (3, [1e200, 1.0]), (4, [-float(1 << 24), 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(data, "vec_id = 0").orderBy("rank").collect()]
    two = 1 << 61
    assert got == [(0, 1, 3, (1 << 63) - 1), (0, 2, 1, two + 64 * 192), (0, 3, 2, two + 64 * 128), (0, 4, 4, -(1 << 60) + 4096)]


def test_bound_cuts_pairs_without_loss():
    draw = np.random.default_rng(3)
    lanes = np.floor(64 * draw.normal(size=(64, 500)))
    ids = np.arange(500, dtype=np.int64)
    block = topk._Block(ids.tobytes(), 64, lanes.tobytes(), 64)
    scores = lanes.T @ lanes
    floor = np.sort(scores, axis=1)[:, -20]
    i, j, s = topk._survivors(block, block, floor)
    assert set(zip(i, j)) == set(zip(*np.nonzero(scores >= floor[:, None]))) and (s == scores[i, j]).all()
