"""Maximal periodic runs of words inside documents, by seeds that are extended along diagonals.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
at least ``max(LEAST, 2 q)`` long, that no neighbouring word extends. Its words match those ``q``
further on for ``max(LEAST - q, q)`` places or more: one diagonal of lag ``q``.

1. Lags are classed by doubling. In a class all runs have a guaranteed overlap of ``overlap``
   matching places. So k-grams that begin at multiples of ``stride``, with
   ``k + stride - 1 = overlap``, meet every run of the class. The k-grams of all places are
   indexed by hash; grams that occur once in their document drop out before the index is sorted.
2. Seeds are the pairs of an anchor and a later occurrence of its gram in the same document
   whose lag is of the class. An anchor has at most one partner a lag, so a class gives at
   most about two seeds a word, however often a gram occurs.
3. Seeds inside a run found before, at a multiple of its period, are taken out: the same run.
   The others go in order of (lag, place). The furthest place covered on their lag so far
   skips all that an extension has covered; the first one beyond it is extended both ways,
   word by word, to the ends of its diagonal.

Words are compared, not only hashed, so no run is wrong, and equal grams have equal hashes, so
none is missed. The smallest period of a stretch is found first, since lags ascend.

Each document is one row and is worked on by itself; a task takes documents in parts of
bounded size and its arrays are a small multiple of the longest text. A null or blank text
has no words and no runs, its collapsed text is empty. Rows with equal ids are separate. A
null doc_id leaves the text as it is. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from harvestlens.llm.common import CRC32_OF_ID, CRC32_SQL, pick, table
from harvestlens.llm.registry import query

LEAST = 12  # words of the shortest run
PART_BYTES = 4 << 20  # texts worked on together; one longer text is a part of its own
_U = np.uint64
# Odd multipliers for positions in a gram and for mixing.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def lag_classes(least: int, longest: int) -> list[tuple[int, int, int]]:
    """(first lag, end, guaranteed overlap) of the classes for runs in a text of ``longest`` words."""
    found = [(1, least, (least + 1) // 2)]
    while 2 * found[-1][1] <= longest:
        first = found[-1][1]
        found.append((first, 2 * first, first))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(_MIX[1])
    x = (x ^ (x >> _U(27))) * _U(_MIX[2])
    return x ^ (x >> _U(31))


def _gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k-gram at each place, built by doubling: the same for equal grams."""
    out, have, done = None, words, 0
    width, size = k, 1
    while width:
        if width & 1:
            if out is None:
                out, done = have, size
            else:
                n = len(words) - done - size + 1
                out, done = _mixed(out[:n] * _U(_MIX[0]) + have[done : done + n]), done + size
        width >>= 1
        if width:
            n = len(have) - size
            have, size = _mixed(have[:n] * _U(_MIX[0]) + have[size : size + n]), 2 * size
    return out


def _seeds(words: np.ndarray, doc: np.ndarray, first: int, end: int, overlap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(lags, places, k): anchors with the lags in [first, end) at which their gram occurs again in the document."""
    stride = max(1, overlap // 2)
    k = overlap - stride + 1
    none = np.zeros(0, np.int64)
    if len(words) < k + first:
        return none, none, k
    h = _gram_hashes(words, k)
    h = _mixed(h ^ (doc[: len(h)].astype(_U) * _U(_MIX[2])))
    # most grams occur once: a table of counts by a part of the hash drops them
    bits = min(24, max(10, int(4 * len(h)).bit_length()))
    part = (h >> _U(64 - bits)).astype(np.int64)
    again = np.flatnonzero((np.bincount(part, minlength=1 << bits) > 1)[part])
    if not len(again):
        return none, none, k
    order = again[np.lexsort((again, h[again]))]
    fresh = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    gram = np.cumsum(fresh) - 1
    # sorted keys (gram, place): the partners of an anchor are one stretch of them
    scale = len(words) + 1
    keys = gram * scale + order
    at = np.flatnonzero(order % stride == 0)
    base, top = keys[at], (gram[at] + 1) * scale
    low = np.searchsorted(keys, np.minimum(base + first, top))
    many = np.searchsorted(keys, np.minimum(base + end, top)) - low
    at, low, many = at[many > 0], low[many > 0], many[many > 0]
    if not len(at):
        return none, none, k
    places = np.repeat(order[at], many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return order[np.repeat(low, many) + nth] - places, places, k


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, looked at in growing pieces."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        same = a[done : min(done + step, n)] == b[done : min(done + step, n)]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + len(same), 4 * step
    return n


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs in the words of several documents.

    ``words`` are 64-bit names of words; documents are kept apart by a name of its own after
    each, and ``doc`` numbers them.
    """
    found: dict[tuple[int, int], int] = {}
    sizes = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
    for first, end, overlap in lag_classes(least, int(sizes.max(initial=0))):
        room = sizes[doc] > 2 * first  # a size counts the separator
        places = np.flatnonzero(room)
        if not len(places):
            continue
        all_in = len(places) == len(words)
        w, d = (words, doc) if all_in else (words[places], doc[places])
        lags, seeds, k = _seeds(w, d, first, end, overlap)
        if not all_in:
            seeds = places[seeds]  # documents stay whole, so lags are the same
        # runs found before that can hold a seed of this class
        if len(seeds):
            by_place = np.argsort(seeds, kind="stable")
            lags, seeds = lags[by_place], seeds[by_place]
            keep = np.ones(len(seeds), dtype=bool)
            for (start, length), period in found.items():
                if length >= first + k:
                    a, b = np.searchsorted(seeds, (start, start + length - first - k + 1))
                    inside = seeds[a:b] + lags[a:b] + k <= start + length
                    keep[a:b] &= ~(inside & (lags[a:b] % period == 0))
            lags, seeds = lags[keep], seeds[keep]
            by_lag = np.argsort(lags, kind="stable")  # places stay ascending inside a lag
            lags, seeds = lags[by_lag], seeds[by_lag]
        i, covered, lag = 0, 0, 0
        while i < len(seeds):
            if lags[i] != lag:
                lag, covered = int(lags[i]), 0
            place = int(seeds[i])
            if place < covered:
                # on to the first seed of this lag that isn't covered
                stop = np.searchsorted(lags, lag, side="right")
                i += int(np.searchsorted(seeds[i:stop], covered))
                continue
            right = place + _first_difference(words[place : len(words) - lag], words[place + lag :])
            left = place - _first_difference(words[:place][::-1], words[lag : place + lag][::-1])
            covered, length = right, right - left + lag
            if length >= max(least, 2 * lag):
                found.setdefault((left, length), lag)
            i += 1
    return sorted((start, length, period) for (start, length), period in found.items())


def _texts_runs(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts, places counted from their own first word."""
    names: dict[bytes, int] = {}
    ids = [names.setdefault(w, len(names)) for text in texts for w in (*text, None) if w is not None]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    words = np.empty(int(ends[-1]) if len(ends) else 0, dtype=_U)
    is_end = np.zeros(len(words), dtype=bool)
    is_end[ends - 1] = True
    words[~is_end] = np.array(ids, dtype=_U)
    words[is_end] = _U(len(names)) + np.arange(len(texts), dtype=_U)
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(_mixed(words + _U(1)), doc, least):
        at = int(doc[start])
        out[at].append((start - int(ends[at] - sizes[at] - 1), length, period))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [w for w, m in zip(words, np.cumsum(marks[:-1])) if not m]


Planted = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, least: int = LEAST, planted: Planted | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` is a list of (start, length, period) by start, then period; ``collapsed`` the words
    that no run repeats, joined by a space. ``planted`` may change a document's words beforehand.
    """
    source = pick(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, texts = 0, 0, []
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                words = value.encode("utf-8", "surrogatepass").split() if value else []
                texts.append(planted(batch.column(0)[i].as_py(), words) if planted else words)
                held += len(value or "")
                if held >= PART_BYTES or i == batch.num_rows - 1:
                    runs = _texts_runs(texts, least)
                    left = [b" ".join(kept_words(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)]
                    rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(texts)),
                            pa.array([len(t) for t in texts], pa.int64()),
                            pa.array(rows, run_type),
                            pa.array(left, pa.string()),
                        ],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    first, held, texts = i + 1, 0, []

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return source.mapInArrow(run, schema)


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: by crc32 of the id, every tenth text becomes periodic from a place on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _oracle() -> str:
    """SQL: matching 6-grams of one document, islands on each diagonal, the smallest period of a stretch."""
    k = (LEAST + 1) // 2
    return rf"""
    WITH RECURSIVE {CRC32_SQL}, d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            {CRC32_OF_ID} AS h
        FROM documents, crc_table
    ), e AS (
        SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
    ), f AS (
        SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
    ), t AS (
        SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % p] END) ELSE w END AS w, n
        FROM f
    ), g AS (
        SELECT doc_id, i, array_to_string(w[i + 1:i + {k}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(n - {k - 1}, 0))) AS i FROM t)
    ), m AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
    ), s AS (
        SELECT doc_id, q, min(i) AS start, count(*) + {k - 1} + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island
    ), r AS (
        SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest({LEAST}, 2 * q) GROUP BY ALL
    ), c AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
            min_by(struct_pack(start, length, period), (-length, start, period)) AS best FROM r GROUP BY doc_id
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
    ), marks AS (
        SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
        1000 * best.length // best.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
        sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
            ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END) AS collapsed_sha256
    FROM t LEFT JOIN c USING (doc_id) LEFT JOIN marks USING (doc_id)
    """


@query("op11_periodic_runs", oracle=_oracle())
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted=planted_repeats)
    return found.selectExpr(
        "doc_id",
        "cast(size(runs) AS long) AS n_runs",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
        "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))) AS best",
    ).selectExpr(
        "doc_id",
        "n_runs",
        "-best.start AS start",
        "best.length AS length",
        "-best.period AS period",
        "1000 * best.length div -best.period AS exponent_milli",
        "runs_sha256",
        "collapsed_sha256",
    )
