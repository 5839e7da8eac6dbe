"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the tokens of a sentence into symbols (insult of three strengths,
threat, target, negation, reported speech, quotation mark, end of a clause, other). Four small letter
transducers rewrite and weigh them: negation weakens what it governs, reported speech and
quotations weaken what they hold, a target near an insult or a threat strengthens it. Their
composition, one deterministic machine, runs through a sentence and gives the weight of each of its
clauses; a word counts for what it does in its clause. A comma, colon or semicolon ends a clause:
negation and target reach no further, but reported speech goes on to the end of the sentence
and a quotation to its closing mark, if that comes first. Marks inside a token (3.5, an address)
end nothing.

Insults are learned: words whose document odds among toxic training rows are surely high, as many
as there are. How much a strength, a target or a report weighs is fixed by hand. A logistic curve over the document's strongest clause and its sum turns scores into a
probability. Both are fitted on a bounded sample of labelled rows (``train_rows``), equal
texts counting once.

Null and empty texts have no clause and get the score of a document without evidence.
Repeated rows are scored alike; very long texts count whole; an empty table gives no rows. Columns named like a result are replaced. If the training
rows have only one label, the score is that label's share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.llm.common import held_out, table
from harvestlens.llm.registry import query

# Closed word classes of the grammar (English, German, French, Spanish).
TARGETS = (
    "you your yours yourself u he him his she her they them their this that these those people everyone "
    "du dich dir dein ihr euch sie er diese tu toi te ton vous votre ils elle elles lui eux tú ti tu usted ustedes él ella ellos"
).split()
NEGATIONS = "not no never nobody nor cannot dont doesnt isnt arent nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORTS = (
    "said says say told wrote writes called calls quoted quote reported reports claimed alleged sagte schrieb nannte "
    "dit écrit appelé dijo escribió llamó"
).split()
THREATS = (
    "kill hurt destroy attack burn beat punch shoot stab töten schlagen verbrennen tuer frapper brûler matar golpear quemar"
).split()
SEED_INSULTS = "idiot moron scum stupid trash idiota imbécile dummkopf".split()

OTHER, TARGET, NOT, REPORT, QUOTE, CLAUSE, THREAT, MILD, STRONG, SEVERE = range(10)
_INSULTS = (MILD, STRONG, SEVERE)
_WEAK = {MILD: 10, STRONG: 11, SEVERE: 12, THREAT: 13}  # negated or reported
_WEIGHT = {MILD: 1.5, STRONG: 2.5, SEVERE: 4.0, THREAT: 1.0}
_SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Transducer:
    """Letter transducer: ``arcs[state, symbol] = (next state, symbol out, weight)``; what has
    no arc passes unchanged, with weight 0, to ``rest[state]``."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    rest: dict[int, int]

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (self.rest.get(state, state), symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: Sequence[int]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; weights add up."""
    names, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for s in symbols:
            a, out, w = first.step(pair[0], s)
            b, out, v = second.step(pair[1], out)
            if (a, b) not in names:
                names[a, b] = len(names)
                todo.append((a, b))
            arcs[names[pair], s] = (names[a, b], out, w + v)
    return Transducer(arcs, {})


def negation_transducer(reach: int = 3) -> Transducer:
    """After a negation, insults and threats among the next ``reach`` symbols come out weak."""
    arcs = {(0, NOT): (reach, NOT, 0.0)}
    rest = {0: 0}
    for k in range(1, reach + 1):
        rest[k] = k - 1
        arcs[k, CLAUSE] = (0, CLAUSE, 0.0)
        arcs[k, NOT] = (reach, NOT, 0.0)
        for strong, weak in _WEAK.items():
            arcs[k, strong] = (k - 1, weak, 0.0)
    return Transducer(arcs, rest)


def report_transducer() -> Transducer:
    """What follows a verb of speech, and what stands in quotation marks, comes out weak, over ends of clauses too."""
    arcs = {(0, REPORT): (1, REPORT, 0.0), (0, QUOTE): (2, QUOTE, 0.0), (1, QUOTE): (2, QUOTE, 0.0), (2, QUOTE): (0, QUOTE, 0.0)}
    for state in (1, 2):
        for strong, weak in _WEAK.items():
            arcs[state, strong] = (state, weak, 0.0)
    return Transducer(arcs, {})


def insult_transducer(weaken: float = 0.5) -> Transducer:
    """Weighs insults: more right after a target, and again for each further one of the clause."""
    arcs, rest = {}, {0: 0, 1: 0, 2: 2}
    for state, factor in ((0, 1.0), (1, 1.3), (2, 1.2)):
        arcs[state, TARGET] = (1 if state == 0 else 2, TARGET, 0.0)
        arcs[state, CLAUSE] = (0, CLAUSE, 0.0)
        for s in _INSULTS:
            arcs[state, s] = (2, s, factor * _WEIGHT[s])
            arcs[state, _WEAK[s]] = (state, _WEAK[s], weaken * _WEIGHT[s])
    return Transducer(arcs, rest)


def threat_transducer(weaken: float = 0.3) -> Transducer:
    """Weighs threats: alone a little, with a target on either side much more."""
    arcs = {
        (0, TARGET): (1, TARGET, 0.0),
        (0, THREAT): (2, THREAT, _WEIGHT[THREAT]),
        (1, THREAT): (3, THREAT, 3 * _WEIGHT[THREAT]),
        (2, TARGET): (3, TARGET, 2 * _WEIGHT[THREAT]),
        (3, THREAT): (3, THREAT, _WEIGHT[THREAT]),
    }
    for state in range(4):
        arcs[state, CLAUSE] = (0, CLAUSE, 0.0)
        arcs[state, _WEAK[THREAT]] = (state, _WEAK[THREAT], weaken * _WEIGHT[THREAT])
    return Transducer(arcs, {})


def grammar() -> Transducer:
    """Negation, then reported speech, then the weighing of insults and of threats."""
    symbols = range(10)
    machine = compose(negation_transducer(), report_transducer(), symbols)
    machine = compose(machine, insult_transducer(), symbols)
    return compose(machine, threat_transducer(), symbols)


_ENDS = re.compile(r"([.!?…;:,]+)[\"'’“”»)\]]*$")  # marks at the end of a token
_STOPS = re.compile(r"[.!?…]")
_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_QUOTES = "\"“”„«»"


@dataclass
class ToxicityModel:
    insults: dict[str, int]  # learned words, by strength
    curve: tuple[float, float, float]  # bias, weight of the strongest clause, weight of log(1 + sum)
    machine: Transducer = field(default_factory=grammar)

    def symbols_of(self, token: str) -> tuple[tuple[int, ...], bool]:
        """Symbols of a token between blanks, and whether a sentence ends with it."""
        out: list[int] = [QUOTE] if token[0] in _QUOTES else []
        for word in _CORE.findall(token):
            w = word.replace("'", "").replace("’", "")
            if w in self.insults:
                out.append(self.insults[w])
            elif w in _CLASSES:
                out.append(_CLASSES[w])
            else:
                out.append(OTHER)
        if len(token) > 1 and any(q in _QUOTES for q in token[1:]):
            out.append(QUOTE)
        end = _ENDS.search(token)
        if end:
            out.append(CLAUSE)
        return tuple(out), bool(end and _STOPS.search(end[1]))

    def clause_scores(self, symbols: Sequence[int]) -> list[float]:
        """Weights of the clauses of one sentence."""
        state, scores = 0, [0.0]
        for s in symbols:
            state, _, w = self.machine.step(state, s)
            if s == CLAUSE:
                scores.append(0.0)
            else:
                scores[-1] += w
        return scores

    def probability(self, strongest: float, total: float) -> float:
        z = self.curve[0] + self.curve[1] * strongest + self.curve[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


_CLASSES = (
    {w: THREAT for w in THREATS} | {w: REPORT for w in REPORTS} | {w: NOT for w in NEGATIONS} | {w: TARGET for w in TARGETS}
)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        used = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, used + _SLICE_BYTES, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def clause_evidence(model: ToxicityModel, texts: pa.Array, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(strongest clause, sum over clauses) of each text. Only sentences with an insult or a threat are run."""
    n = len(texts)
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\s+")
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    flat = parts.flatten().dictionary_encode()
    vocabulary, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    if len(known) > 400_000:
        known.clear()
    facts = []
    for token in vocabulary:
        fact = known.get(token)
        if fact is None:
            symbols, ends = model.symbols_of(token) if token else ((), False)
            fact = known[token] = (symbols, ends, any(s >= THREAT for s in symbols))
        facts.append(fact)
    strongest, total = np.zeros(n), np.zeros(n)
    if not len(codes):
        return strongest, total
    hit = np.array([f[2] for f in facts], dtype=bool)[codes]
    if not hit.any():
        return strongest, total
    ends = np.array([f[1] for f in facts], dtype=bool)[codes]
    stops = np.union1d(np.flatnonzero(ends) + 1, offsets[1:])  # a sentence ends here
    begins = np.concatenate(([0], stops[:-1]))
    for c in np.unique(np.searchsorted(stops, np.flatnonzero(hit), side="right")):
        symbols = [s for k in codes[begins[c] : stops[c]] for s in facts[k][0]]
        scores = model.clause_scores(symbols)
        doc = int(np.searchsorted(offsets, begins[c], side="right")) - 1
        strongest[doc] = max(strongest[doc], *scores)
        total[doc] += sum(scores)
    return strongest, total


def _evidence(rows: DataFrame, model: ToxicityModel, text_at: int, schema: T.StructType, probability: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            parts = [clause_evidence(model, p, known) for p in _slices(batch.column(text_at))]
            strongest = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            total = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            if probability:
                added = [pa.array([model.probability(a, b) for a, b in zip(strongest, total)], pa.float64())]
            else:
                added = [pa.array(strongest), pa.array(total)]
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(columns + added, names=schema.names)

    return rows.mapInArrow(run, schema)


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """About ``train_rows`` labelled texts as ``text, toxic``, never held-out ones.

    Drawn from the labels by a hash of the id before the texts are touched; the drawn
    labels, bounded by ``train_rows``, go to the texts, so that no text is shuffled.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    share = min(1.0, train_rows / max(usable.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)).cast("double") / 1_000_000
    return docs.select("doc_id", "text").join(F.broadcast(usable.filter(draw < share)), "doc_id").select("text", "toxic")


def train(labelled: DataFrame, min_docs: int = 3, min_log_odds: float = 1.3) -> ToxicityModel:
    """Fit on rows ``text, toxic``, a bounded number of them (see ``training_sample``)."""
    rows = labelled.filter("text IS NOT NULL AND toxic IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = rows.groupBy(F.xxhash64("text").alias("k")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")
    ).drop("k")
    sample = sample.persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad or not good:
            p = (bad + 1) / (bad + good + 2)
            return ToxicityModel({}, (math.log(p / (1 - p)), 0.0, 0.0))
        found = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: w != ""))
        words = sample.select("toxic", F.explode(found).alias("w")).groupBy("w").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
        )
        # lower end of the 90 % interval of the log odds: rare words need clear evidence
        spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1)) - 1.64 * spread
        top = words.filter(F.col("bad") >= min_docs).withColumn("odds", odds).filter(F.col("odds") >= min_log_odds)
        top = top.select("w", "odds").collect()  # of the vocabulary of a bounded number of texts
        closed = set(_CLASSES)
        insults = {w: STRONG for w in SEED_INSULTS}
        for r in top:
            if r["w"] not in closed:
                insults[r["w"]] = SEVERE if r["odds"] >= min_log_odds + 1 else STRONG if r["odds"] >= min_log_odds + 0.4 else MILD
        model = ToxicityModel(insults, (0.0, 0.0, 0.0))
        schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("strongest", T.DoubleType()), T.StructField("total", T.DoubleType())])
        points = _evidence(sample.select("text", "toxic"), model, 0, schema, False)
        # equal points together: clause scores take few values
        grouped = points.groupBy("toxic", F.round("strongest", 1).alias("a"), F.round(F.log1p("total"), 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        data = np.array([[r["toxic"], r["a"], r["b"], r["n"]] for r in grouped.collect()], dtype=float)
    finally:
        sample.unpersist()
    model.curve = _logistic(data[:, 1:3], data[:, 0], data[:, 3])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, float, float]:
    """Weighted ridge-penalised logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, ridge, ridge])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - penalty @ beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + penalty
        move = np.linalg.solve(hessian, gradient)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(df: DataFrame, model: ToxicityModel, keep: Sequence[str] | None = None, text_col: str = "text") -> DataFrame:
    """Add ``score``, the probability that the text is toxic. ``keep``: input columns to return, default all."""
    kept = [c for c in (df.columns if keep is None else keep) if c != "score"]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_toxicity_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return _evidence(rows, model, len(kept), schema, True)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(training_sample(docs, labels))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
