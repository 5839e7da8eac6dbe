"""Removal of passages that repeat, by hashes of sentence runs.

A text is cut into sentences (after ``.!?`` with white space, and at line ends), and sentences of
more than ``LONG`` words into their clauses (after ``,;:`` with white space), so that a passage
which begins or ends inside a sentence of its host is followed closely. A run is
several consecutive sentences, the first and the last of which may be clauses: as few parts as hold
``run_words`` words and reach over ``run_sentences - 1`` sentence ends; every part begins one and
ends one. A run whose words occur elsewhere, earlier in the order (doc_id, text hash,
position), is a repeat, and parts covered by repeats are removed. A single sentence that
recurs is none, whatever its length. Any repeated passage whose whole parts make a run loses all of
these: a run fits in it from its first part on and back from its last, and from any part between
these two runs in one direction.

Runs are told apart by two independent 64-bit hashes: one finds those that may recur, both
decide. A null text stays null and an empty one empty. Rows equal in id and text are one
document, treated alike. A null id comes last in the order. A text may become empty; its row
stays. Texts count whole, however long. An empty table gives no rows. All columns stay; those
added are ``n_sentences`` and ``n_removed`` (parts), in place of such names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.llm.common import discard, free_names, in_parts, pick, stored, table
from harvestlens.llm.registry import query

_CUT = re.compile(r"[.!?…。！？][\"')\]»”]*\s+|\n\s*")
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # fixed values: odd bases of the run polynomials
_CLAUSE = re.compile(r"[,;:][\"')\]»”]*\s+")
LONG = 16  # words of a sentence above which it is cut into clauses
RUN_WORDS = 16
RUN_SENTENCES = 2


def sentences(text: str) -> list[str]:
    """Sentences with the white space that follows them: joined, they are the text."""
    edges = [0, *[m.end() for m in _CUT.finditer(text)]]
    if edges[-1] < len(text):
        edges.append(len(text))
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def parts(text: str) -> tuple[list[str], list[bool]]:
    """Sentences, long ones by clause, and whether a sentence ends with the part: joined, they are the text."""
    found, ends = [], []
    for s in sentences(text):
        edges = [0]
        if len(s.split()) > LONG:
            edges += [m.end() for m in _CLAUSE.finditer(s) if m.end() < len(s)]
        edges.append(len(s))
        found += [s[a:b] for a, b in zip(edges, edges[1:])]
        ends += [False] * (len(edges) - 2) + [True]
    return found, ends


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=_U)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def runs(text: str, run_words: int, run_sentences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, spans, new) of a text's runs in order; a span is first part << 32 | end.

    ``new`` is false for a run that occurs earlier in the text.
    """
    hashes, lengths = [], [0]
    pieces, ends = parts(text)
    for s in pieces:
        w = s.split()
        hashes.append(xxhash.xxh3_128_intdigest(" ".join(w)))
        lengths.append(len(w))
    total = np.cumsum(lengths)
    n = len(hashes)
    over = np.cumsum([0, *ends])  # sentences that end among the first so many parts
    none = np.zeros(0, np.int64)
    if n == 0 or total[-1] < run_words:
        return none, none, none, np.zeros(0, bool)
    i, j = np.arange(n), np.arange(1, n + 1)
    # the end of the last part is not inside a run
    inner = run_sentences - 1
    forward = np.maximum(np.searchsorted(total, total[:-1] + run_words, side="left"), np.maximum(np.searchsorted(over, over[:-1] + inner, side="left"), i) + 1)
    backward = np.minimum(
        np.searchsorted(total, total[1:] - run_words, side="right") - 1,
        np.minimum(np.searchsorted(over, over[:-1] - inner, side="right") - 1, j - 1),
    )
    spans = np.unique(np.concatenate(((i << 32 | forward)[forward <= n], (backward << 32 | j)[backward >= 0])))
    first, end = spans >> 32, spans & 0xFFFFFFFF
    found = []
    for base, shift in ((_BASES[0], 0), (_BASES[1], 64)):
        # prefix sums of hash * base^position; a run's sum is shifted back by its first position
        own = np.array([(h >> shift) & 0xFFFFFFFFFFFFFFFF for h in hashes], dtype=_U)
        powers, back = _powers(base, n + 1), _powers(pow(base, -1, 1 << 64), n + 1)
        prefix = np.concatenate((np.zeros(1, _U), np.cumsum(own * powers[:-1], dtype=_U)))
        value = (prefix[end] - prefix[first]) * back[first]
        value ^= value >> _U(31)
        found.append((value * _U(0xBF58476D1CE4E5B9) + (end - first).astype(_U)).view(np.int64))
    value, check = found
    _, at, of = np.unique(value, return_index=True, return_inverse=True)
    new = (np.arange(len(spans)) == at[of]) | (check != check[at[of]])
    return value, check, spans, new


def without_covered(text: str, spans: list[int]) -> tuple[str, int, int]:
    """The text without its covered parts, its sentences, and how many parts were removed."""
    pieces, ends = parts(text)
    if not spans:
        return text, sum(ends), 0
    marks = np.zeros(len(pieces) + 1, dtype=np.int64)
    for s in spans:
        marks[s >> 32] += 1
        marks[s & 0xFFFFFFFF] -= 1
    gone = np.cumsum(marks[:-1]) > 0
    return "".join(p for p, g in zip(pieces, gone) if not g), sum(ends), int(gone.sum())


def repeats(docs: DataFrame, run_words: int, run_sentences: int) -> DataFrame:
    """doc_id, row_key and the spans of its runs that repeat earlier ones, one row per document that has any."""
    source = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["run", "check", "doc_id", "row_key", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, checks, where, n = [], [], [], [], 0
            for i, text in enumerate(batch.column(2)):
                value = text.as_py()
                if value:
                    h, c, s, new = runs(value, run_words, run_sentences)
                    at.append(np.full(len(h), i))
                    found.append(pa.array(h, mask=~new))
                    checks.append(c)
                    where.append(s)
                    n += len(h)
                if n > 200_000 or (i == batch.num_rows - 1 and n):
                    rows = pa.array(np.concatenate(at))
                    columns = [
                        pa.concat_arrays(found),
                        pa.array(np.concatenate(checks)),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(np.concatenate(where)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at, found, checks, where, n = [], [], [], [], 0

    made = source.filter("text IS NOT NULL").mapInArrow(run, f"run long, check long, doc_id {kind}, row_key long, span long")
    every = stored(made, "runs")
    # a null run occurs earlier in its own text: a repeat whatever the other texts hold, and
    # one row for each text and run is left to compare
    single = every.filter("run IS NOT NULL")
    # counts first: a run of one text only, by far the most frequent case, goes no further.
    # Counts and firsts are stored, so that joins with them have two plain sides and a run
    # of very many texts can be split among tasks
    often = stored(single.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run"), "frequent-runs")
    again = stored(single.join(often, "run"), "repeated-runs")
    place = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"), F.col("span").alias("s"))
    first = stored(again.groupBy("run", "check").agg(F.min(place).alias("first")), "first-runs")
    later = again.join(first, ["run", "check"]).filter(~place.eqNullSafe(F.col("first")))
    columns = ["doc_id", "row_key", "span"]
    own = stored(every.filter("run IS NULL").select(*columns), "own-repeats")
    discard(every, often)  # the large table is not left until the result is read
    flagged = later.select(*columns).union(own)
    return flagged.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, run_words: int = RUN_WORDS, run_sentences: int = RUN_SENTENCES) -> DataFrame:
    """The documents without repeated passages, with ``n_sentences`` and ``n_removed``."""
    added = ("n_sentences", "n_removed")
    kept = [c for c in docs.columns if c not in added]
    span_id, span_key, span_list, own_key = free_names(docs, "span_id", "span_key", "span_list", "own_key")
    found = repeats(docs, run_words, run_sentences).select(
        F.col("doc_id").alias(span_id), F.col("row_key").alias(span_key), F.col("spans").alias(span_list)
    )
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64("text").alias(own_key))
    same = keyed[own_key].eqNullSafe(found[span_key]) & keyed["doc_id"].eqNullSafe(found[span_id])
    joined = keyed.join(found, same, "left").select(*[F.col(f"`{c}`") for c in kept], span_list)
    at = kept.index("text")
    schema = T.StructType(
        [*joined.schema.fields[:-1], T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts, totals, removed = [], [], []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value = text.as_py()
                done = (value, 0, 0) if value is None else without_covered(value, spans.as_py() or [])
                for out, x in zip((texts, totals, removed), done):
                    out.append(x)
            columns = [batch.column(i) for i in range(len(kept))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*kept, *added]
            )

    return joined.mapInArrow(run, schema)


@query("op9_sentence_spans")
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", "n_sentences", "n_removed")
