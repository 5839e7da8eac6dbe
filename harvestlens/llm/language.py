"""Language identification of mixed-language text.

Script ranges narrow a word's candidates to the languages that use its script; a character
trigram model scores the word in each; Viterbi over the words, with a penalty for each
switch, labels spans. A document's language is the one with most letters in its spans, the
score that language's share of the letters. Equal shares: the first language in order.

Null text, and text without a letter, is ``und`` with score 0. Null languages aren't
learned from; an empty training set gives a model without languages, and all is ``und``.
Rows stay as they are, repeated ones included; columns named like a result are replaced.
Long texts are labelled whole: memory follows the words of one slice of texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.llm.common import held_out, in_parts, table
from harvestlens.llm.registry import query

# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_BOUNDS = sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_FROM = np.array([a for a, _, _ in _BOUNDS])
_TO = np.array([b for _, b, _ in _BOUNDS])
_SCRIPT = np.array([i for _, _, i in _BOUNDS])
UNDETERMINED = "und"
_SLICE_BYTES = 2 << 20


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script number of each code point, -1 outside all ranges."""
    at = np.searchsorted(_FROM, points, side="right") - 1
    hit = (at >= 0) & (points <= _TO[at])
    return np.where(hit, _SCRIPT[at], -1)


def _edges(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``words`` with a blank at both ends of each, and where each begins."""
    text = "".join([f" {w} " for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    return points, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def _trigrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes (21 bits a code point), and where each word's begin; none crosses words."""
    points, starts = _edges(words)
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    ends = np.append(starts[1:], len(points))
    keep = np.ones(len(codes), dtype=bool)
    cross = np.concatenate((ends - 2, ends - 1))
    keep[cross[cross < len(codes)]] = False
    counts = ends - starts - 2
    return codes[keep], np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # sorted trigrams
    logs: np.ndarray  # (trigrams + 1, languages), the last row for unseen ones
    uses: np.ndarray  # (scripts, languages), whether the language uses the script
    penalty: float = 6.0
    floor: float = -12.0
    _known: dict = field(default_factory=dict, repr=False)
    _rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_rows": []}

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Log posterior of each language for each word, at least ``floor``."""
        codes, starts = _trigrams(words)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        sums = np.add.reduceat(self.logs[at], starts, axis=0)
        first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
        script = scripts_of(first)
        allowed = np.where(script[:, None] >= 0, self.uses[script], False)
        allowed[~allowed.any(axis=1)] = True  # a script that nobody uses tells nothing
        sums = np.where(allowed, sums, -np.inf)
        top = sums.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(sums - top).sum(axis=1, keepdims=True))
        return np.maximum(sums - total, self.floor).astype(np.float32)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 1200,
    min_count: int = 2,
    smoothing: float = 0.5,
    min_script_share: float = 0.01,
    penalty: float = 6.0,
) -> LanguageModel:
    """Fit on about ``docs_per_language`` different whole texts of each language, chosen by a hash of the text.

    Equal texts of a language count once, so copies neither swamp the sample nor leave it
    empty. Trigrams seen ``min_count`` times or more are kept, however many those are; the sample
    bounds them. The number of languages is that of the labels. Words are counted by the tasks; the driver gets their counts.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l"))
    rows = rows.filter("t IS NOT NULL AND l IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("t"))
    totals = {r["l"]: max(r["n"], 1) for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros(1, np.int64), np.zeros((2, 0)), np.zeros((len(SCRIPTS), 0), bool))
    draw = F.pmod("h", F.lit(1_000_000)).cast("double") / 1_000_000
    chosen = F.lit(False)
    for lang in languages:
        chosen = F.when(F.col("l") == lang, draw < docs_per_language / totals[lang]).otherwise(chosen)
    counts = {lang: Counter() for lang in languages}
    sample = rows.filter(chosen).groupBy("l", "h").agg(F.first("t").alias("t")).select("t", "l")
    kind = sample.schema["l"].dataType.simpleString()
    words_ = sample.mapInArrow(_word_counts, f"l {kind}, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    for row in words_.toLocalIterator():
        counts[row["l"]][row["w"]] = row["n"]
    tri, scripts = [], np.zeros((len(SCRIPTS) + 1, len(languages)))
    for j, lang in enumerate(languages):
        words = [w for w in counts[lang] if any(c.isalpha() for c in w)]
        if not words:
            tri.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        codes, starts = _trigrams(words)
        times = np.fromiter((counts[lang][w] for w in words), dtype=np.float64, count=len(words))
        each = np.repeat(times, np.diff(np.append(starts, len(codes))))
        found, place = np.unique(codes, return_inverse=True)
        tri.append((found, np.bincount(place, weights=each)))
        points, begin = _edges(words)
        letters = np.repeat(times, np.diff(np.append(begin, len(points))))
        np.add.at(scripts[:, j], scripts_of(points), np.where(points == 32, 0, letters))
    every = np.unique(np.concatenate([f for f, _ in tri]))
    table_ = np.zeros((len(every), len(languages)))
    for j, (found, n) in enumerate(tri):
        table_[np.searchsorted(every, found), j] = n
    keep = table_.sum(axis=1) >= min_count
    every, table_ = every[keep], table_[keep]
    size = len(every) + 1
    logs = np.log((np.vstack([table_, np.zeros(len(languages))]) + smoothing) / (table_.sum(axis=0) + smoothing * size))
    share = scripts[:-1] / np.maximum(scripts[:-1].sum(axis=0), 1)
    return LanguageModel(languages, every, logs, share >= min_script_share, penalty)


def _split(texts: pa.Array) -> pa.Array:
    return pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pM]+")


def _words_of(text: str) -> list[str]:
    return [w for w in _split(pa.array([text]))[0].as_py() if w]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``l, w, n``: how often each word occurs in the texts of a slice, for (t, l) rows."""
    for batch in in_parts(batches):
        found: dict = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(_words_of(text.as_py()))
        flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        langs, names, times = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, batch.schema.field(1).type), pa.array(names, pa.string()), pa.array(times, pa.int64())],
            names=["l", "w", "n"],
        )


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``scores`` for many sequences at once.

    Sequences are stepped through together, longest first, so a step is one numpy
    operation over all that are still running.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    came = np.zeros(len(scores), dtype=np.uint16)
    stays = np.zeros(scores.shape, dtype=bool)
    best = np.zeros((len(lengths), scores.shape[1]), dtype=np.float64)
    for t in range(longest):
        n = running[t]
        at, state = starts[:n] + t, best[:n]
        if t:
            top = state.argmax(axis=1)
            jump = state[np.arange(n), top] - penalty
            stay = state >= jump[:, None]
            came[at], stays[at] = top, stay
            state = np.where(stay, state, jump[:, None])
        best[:n] = state + scores[at]
    labels = np.zeros(len(scores), dtype=np.uint16)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = np.where(stays[at, now[:n]], now[:n], came[at]) if t else now[:n]
    return labels


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of some megabytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        used = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, used + _SLICE_BYTES, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def _label(model: LanguageModel, texts: pa.Array, spans: bool) -> dict[str, list]:
    if not model.languages:
        nothing = {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)}
        return nothing | ({"lang_spans": [[] for _ in range(len(texts))]} if spans else {})
    parts = _split(pc.fill_null(texts, ""))
    offsets = parts.offsets.to_numpy()
    flat = parts.flatten().dictionary_encode()
    vocabulary = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy()
    base = offsets[0]
    is_word = np.array([any(c.isalpha() for c in w) for w in vocabulary], dtype=bool)
    if len(model._known) > 150_000:
        model._known.clear()
        model._rows.clear()
    known, rows = model._known, model._rows
    new = [w for w, ok in zip(vocabulary, is_word) if ok and w not in known]
    if new:
        known.update((w, len(rows) + i) for i, w in enumerate(new))
        rows.extend(model.word_scores(new))
    mine = np.zeros((len(vocabulary), len(model.languages)), dtype=np.float32)
    picked = [rows[known[w]] for w, ok in zip(vocabulary, is_word) if ok]
    if picked:
        mine[is_word] = np.array(picked)
    letters = np.fromiter((sum(map(str.isalpha, w)) for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    keep = is_word[codes] if len(codes) else np.zeros(0, dtype=bool)
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = kept_before[offsets[:-1] - base], kept_before[offsets[1:] - base]
    codes = codes[keep]
    labels = viterbi(mine[codes], starts, ends - starts, model.penalty) if len(codes) else np.zeros(0, np.uint16)
    n, k = len(texts), len(model.languages)
    doc = np.repeat(np.arange(n), ends - starts)
    share = np.bincount(doc * k + labels, weights=letters[codes], minlength=n * k).reshape(n, k) if k else np.zeros((n, 1))
    total, top = share.sum(axis=1), share.argmax(axis=1)
    out = {
        "lang_pred": [model.languages[j] if s else UNDETERMINED for j, s in zip(top, total)],
        "score": [float(share[i, j] / total[i]) if total[i] else 0.0 for i, j in enumerate(top)],
    }
    if spans:
        out["lang_spans"] = [_runs(model, labels[a:b], letters[codes[a:b]]) for a, b in zip(starts, ends)]
    return out


def _runs(model: LanguageModel, labels: np.ndarray, letters: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(labels)] if len(labels) else []
    return [
        {"lang": model.languages[labels[a]], "first_word": a, "n_words": b - a, "n_letters": int(letters[a:b].sum())}
        for a, b in zip(edges, edges[1:])
    ]


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_letters", T.LongType()),
        ]
    )
)


def identify(
    df: DataFrame, model: LanguageModel, text_col: str = "text", keep: Sequence[str] | None = None, spans: bool = False
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (and ``lang_spans``, words counted from 0, if asked) to each row.

    ``keep`` names the input columns to return; default all.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    added += [T.StructField("lang_spans", SPANS)] if spans else []
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    own = [F.col(f"`{c}`") for c in kept]
    source = df.select(*own)
    if kept.count(text_col) == 1 and source.schema[text_col].dataType == T.StringType():
        at = kept.index(text_col)  # a text that is kept is sent once
    else:
        source, at = df.select(*own, F.col(f"`{text_col}`").cast("string").alias("_identify_text")), len(kept)
    schema = T.StructType(source.schema.fields[: len(kept)] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(
            pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64())])
        )
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "lang_spans": span_type}
        for batch in in_parts(batches, 2000):
            found: dict[str, list] = {f.name: [] for f in added}
            for part in _slices(batch.column(at)):
                for name, values in _label(model, part, spans).items():
                    found[name].extend(values)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(found[f.name], kinds[f.name]) for f in added], names=[*kept, *found]
            )

    return source.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: not held out, language known."""
    return docs.filter(~held_out(F.col("doc_id"))).select("text", "lang").filter("lang IS NOT NULL")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
