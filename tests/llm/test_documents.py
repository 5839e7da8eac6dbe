"""Document operators against brute-force versions, on awkward rows."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harvestlens.llm import jaccard, language, mixing, packing, quality, spans, toxicity
from harvestlens.llm.common import components, held_out
from tests.llm.data import awkward_docs, edited, empty_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


# --- quality rules


def measures_of(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, docs, rows):
    extra = ["a b c a b c", "x x x x x", "a\nb\na\n\n \na", "## |a| $5 & <b>", "é ü é ü é ü"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    got = sorted((tuple(r) for r in quality.measures(both).select("doc_id", *quality.MEASURES).collect()), key=str)
    want = sorted(((r["doc_id"], *measures_of(r["text"])) for r in both.collect()), key=str)
    assert got == want


def test_cascade_keeps_columns_and_ignores_order(docs):
    rules = quality.base_rules() + quality.page_rules()
    one = quality.cascade(quality.measures(docs), rules)
    two = quality.cascade(quality.measures(docs), rules[::-1])
    assert {"_w", "score", "kept", "rejected_by"} <= set(one.columns)
    clash = docs.withColumn("word_list", F.lit("mine"))
    assert {(r["_w"], r["word_list"]) for r in quality.measures(clash).collect()} == {("y", "mine")}
    verdicts = [{(r["doc_id"], r["text"]): r["kept"] for r in x.collect()} for x in (one, two)]
    assert verdicts[0] == verdicts[1] and set(verdicts[0].values()) == {True, False}
    assert verdicts[0][30, None] is False


def test_rules_are_ranked_by_rejection_per_cost(docs):
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("often", F.col("n_words") < 10**6)]
    assert [r.name for r in quality.rank_rules(quality.measures(docs), rules)] == ["often", "never"]
    equal = [quality.Rule(n, F.col("n_words") < 50) for n in ("b", "a", "c")]
    assert [r.name for r in quality.rank_rules(quality.measures(docs), equal)] == ["a", "b", "c"]
    assert quality.quality_filter(docs.limit(0)).count() == 0 and quality.screen(docs.limit(0)).count() == 0


def test_screen_judges_like_the_filter(docs):
    full = quality.quality_filter(docs).select("doc_id", "text", "kept").collect()
    lean = quality.screen(docs)
    assert set(lean.columns) == {*docs.columns, "rejected_by", "kept"}
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["kept"])
    assert sorted(map(key, full)) == sorted(map(key, lean.collect()))


def test_sample_is_drawn_by_content(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    ids = [{r["doc_id"] for r in quality.draw_sample(x, "text", 500).collect()} for x in (rows, rows.repartition(7))]
    assert ids[0] == ids[1] and 400 < len(ids[0]) < 600


# --- toxicity


def clauses_of(model, text):
    return model.clause_scores([s for t in text.split() for s in model.symbols_of(t)[0]])


def test_grammar_scores_clauses():
    model = toxicity.ToxicityModel({"clod": toxicity.STRONG}, (0.0, 1.0, 0.0))
    clause = lambda text: max(clauses_of(model, text))
    plain = clause("a clod here")
    assert clause("nothing to see") == 0 and plain > 0
    assert clause("you clod") > plain > clause("not a clod") > 0
    assert clause("he said clod") < plain and clause('"clod"') < plain
    assert clause("kill you") > clause("kill time") > 0
    assert clause("you clod you clod") > clause("you clod")
    # reports and quotations reach over commas and colons, not past the sentence or the closing mark
    weak = clause("he said you clod")
    for text in ("he said: you clod", "he said, you clod", 'he said "well, you clod"', "“well, you clod”", "she wrote; today: clod"):
        assert 0 < clause(text) <= weak < plain, text
    assert clause('he said "well" you clod') > plain  # the report became the quotation, which is closed
    scores = toxicity.clause_evidence(model, pa.array(["he said it. you clod", "you clod", "not here, you clod"]), {})[0]
    assert scores[0] == scores[1] == scores[2]
    # marks inside a token end nothing
    assert model.symbols_of("3.5")[1] is False and toxicity.CLAUSE not in model.symbols_of("http://a.b/c?d=1,2")[0]
    assert model.symbols_of("end.”")[1] and model.symbols_of("well,")[0][-1] == toxicity.CLAUSE


def test_evidence_equals_running_the_parts_over_every_sentence():
    """The four transducers one after the other over all sentences of a text, clause by clause."""
    parts = [toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.insult_transducer(), toxicity.threat_transducer()]
    model = toxicity.ToxicityModel({"clod": toxicity.STRONG, "oaf": toxicity.MILD, "fiend": toxicity.SEVERE}, (-2.0, 0.7, 0.4))
    draw = np.random.default_rng(8)
    pool = ["clod", "oaf", "fiend", "you", "not", "said", "kill", "tree", "house,", "sky:", "end.", "why?", '"so', 'it"', "3.5", "clod!", "you,"]
    texts = [" ".join(draw.choice(pool, draw.integers(0, 60))) for _ in range(60)] + ["", None, "clod"]

    def slow(text):
        sentence, sentences = [], []
        for token in (text or "").lower().split():
            symbols, ends = model.symbols_of(token)
            sentence += symbols
            if ends:
                sentences.append(sentence)
                sentence = []
        scores = [0.0]
        for symbols in [*sentences, sentence]:
            weights, stream = np.zeros(len(symbols)), symbols
            for part in parts:
                state, out = 0, []
                for i, s in enumerate(stream):
                    state, o, w = part.step(state, s)
                    out.append(o)
                    weights[i] += w
                stream = out
            scores.append(0.0)
            for s, w in zip(symbols, weights):
                if s == toxicity.CLAUSE:
                    scores.append(0.0)
                else:
                    scores[-1] += w
        z = -2.0 + 0.7 * max(scores) + 0.4 * np.log1p(sum(scores))
        return max(scores), sum(scores), 1 / (1 + np.exp(-z))

    strongest, total = toxicity.clause_evidence(model, pa.array(texts), {})
    for text, a, b in zip(texts, strongest, total):
        assert (a, b, model.probability(a, b)) == pytest.approx(slow(text)), text


def test_composition_equals_running_one_after_the_other():
    parts = [toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.insult_transducer(), toxicity.threat_transducer()]
    whole = toxicity.grammar()
    draw = np.random.default_rng(1)
    for _ in range(200):
        symbols = draw.integers(0, 10, draw.integers(1, 12)).tolist()
        total, stream = 0.0, symbols
        for part in parts:
            state, out = 0, []
            for s in stream:
                state, o, w = part.step(state, s)
                out.append(o)
                total += w
            stream = out
        state, got = 0, 0.0
        for s in symbols:
            state, _, w = whole.step(state, s)
            got += w
        assert got == pytest.approx(total)


def test_toxicity_learns_and_scores_every_row(spark, docs):
    bad = [(1000 + i, prose(i, 80) + f" you {'grob' if i % 3 else 'zank'} there.", 1) for i in range(60)]
    good = [(2000 + i, prose(500 + i, 80), 0) for i in range(200)]
    labelled = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    sample = toxicity.training_sample(labelled, labelled.select("doc_id", "toxic"))
    model = toxicity.train(sample)
    assert {"grob", "zank"} <= set(model.insults)
    scored = toxicity.score(labelled, model).filter(held_out(F.col("doc_id"))).collect()
    assert len(scored) > 40 and all((r["score"] >= 0.7) == bool(r["toxic"]) for r in scored)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty_docs(spark), model, keep=["doc_id"]).count() == 0
    only = toxicity.train(labelled.filter("toxic = 0").select("text", "toxic"))
    assert only.insults == {} and 0 < only.probability(0, 0) < 0.5


# --- Jaccard join


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = [shingles(r["text"], k) for r in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                part[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r["doc_id"])
    out = []
    for i, (r, s) in enumerate(zip(rows, sets)):
        ids = [x for x in low[find(i)] if x is not None]
        out.append((r["doc_id"], len(s), (min(ids) if ids else None) if s else r["doc_id"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [16, 1])
@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs, k, percent, crowded, monkeypatch):
    """With ``crowded`` at 1 every band left open goes through the finer bands; the tables of bits may fill up."""
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "MARK_BITS", 1 << (28 if crowded == 16 else 16))
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << (24 if crowded == 16 else 6))
    monkeypatch.setattr(jaccard, "PIECE", 1024 if crowded == 16 else 3)
    base = prose(7, 150)
    family = [(5000 + i, edited(base, i, 1 + i % 14)) for i in range(40)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    got = jaccard.similarity_classes(more, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(more.collect(), k, percent)


def test_bands_never_miss_a_pair():
    draw = np.random.default_rng(5)
    classes = jaccard.size_classes(80, 4000)
    for n in (6, 7, 13, 40, 41, 65, 66, 300, 1050):
        for _ in range(20):
            a = draw.integers(0, 2**63, n).astype(np.uint64)
            swaps = int(n * 0.2 / 1.8)  # the most that still links two sets of this size
            b = a.copy()
            b[:swaps] = draw.integers(0, 2**63, swaps).astype(np.uint64)
            if len(set(a) & set(b)) / len(set(a) | set(b)) < 0.8:
                continue
            i = next(i for i, (first, last, _) in enumerate(classes) if first <= n <= last)
            bands = [set(jaccard._bands(np.unique(s), i, classes[i][2]).tolist()) for s in (a, b)]
            assert bands[0] & bands[1]
            far = int(np.bitwise_count(jaccard._sketch(np.unique(a)).view(np.uint64) ^ jaccard._sketch(np.unique(b)).view(np.uint64)).sum())
            assert far <= len(set(a) ^ set(b))


@pytest.mark.parametrize("members", [16, 17])
def test_bands_about_as_crowded_as_the_border(spark, members):
    """Families that share half of their text, at either side of the border, with linked pairs inside."""
    common = prose(70, 120)
    family = [(i, common + " " + prose(100 + i, 120)) for i in range(members)]
    family += [(1000 + i, edited(t, i, 3)) for i, t in family[::4]]
    more = spark.createDataFrame(family, "doc_id long, text string")
    got = jaccard.similarity_classes(more, 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(more.collect(), 5, 80)


def test_keep_one(spark, docs, rows):
    named = docs.withColumn("gone_key", F.concat(F.lit("g"), "doc_id"))
    kept = jaccard.keep_one(named, 5, 80)
    assert kept.columns == named.columns
    assert all(r["gone_key"] == (None if r["doc_id"] is None else f"g{r['doc_id']}") for r in kept.collect())
    ids = [r["doc_id"] for r in kept.collect()]
    want = {b for a, n, b in brute_components(rows, 5, 80) if n}
    gone = {a for a, n, b in brute_components(rows, 5, 80) if n and a is not None and a != b}
    assert set(ids) >= want - {None} and 20 in gone and not gone & set(ids)
    assert {30, 31, 32} <= set(ids) and ids.count(34) == 2  # two texts share the id 34, one of them twice
    assert jaccard.keep_one(empty_docs(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 30)] + [(3, 3), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 30)}


# --- language


def test_viterbi_equals_brute_force():
    draw = np.random.default_rng(3)
    lengths = np.array([0, 1, 5, 4, 6])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores = draw.normal(size=(lengths.sum(), 3)) * 2
    labels = language.viterbi(scores, starts, lengths, 1.5)

    def value(path, part):
        return sum(part[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

    for s, n in zip(starts, lengths):
        part = scores[s : s + n]
        paths = [()]
        for _ in range(n):
            paths = [(*p, k) for p in paths for k in range(3)]
        if n:
            assert value(labels[s : s + n].tolist(), part) == pytest.approx(max(value(p, part) for p in paths))


def test_language_spans_and_held_out_accuracy(spark, docs):
    made = [(i, prose(i, 70, "abcdefgh" if i % 2 else "qrstuvwx"), "aa" if i % 2 else "bb") for i in range(300)]
    made += [(1000 + i, "".join(chr(0x430 + (i * 7 + j) % 25) for j in range(30)), "cc") for i in range(40)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(language.training_rows(table))
    assert model.languages == ["aa", "bb", "cc"]
    test = language.identify(table, model).filter(held_out(F.col("doc_id"))).collect()
    assert len(test) > 80 and all(r["lang"] == r["lang_pred"] and r["score"] > 0.9 for r in test)
    mixed = made[1][1] + " " + made[2][1] + " " + made[300][1]
    row = language.identify(spark.createDataFrame([(mixed,)], "text string"), model, spans=True).first()
    assert [s["lang"] for s in row["lang_spans"]] == ["aa", "bb", "cc"]
    assert sum(s["n_letters"] for s in row["lang_spans"]) == sum(map(str.isalpha, mixed))
    out = language.identify(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    found = {(r["doc_id"], r["text"]): r["lang_pred"] for r in out.collect()}
    assert [found[i, t] for i, t in [(30, None), (31, ""), (32, " \n\t "), (33, "123 456 ... !!")]] == ["und"] * 4
    nothing = language.train(table.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in language.identify(docs, nothing, spans=True).collect()} == {"und"}
    assert language.identify(empty_docs(spark), model).count() == 0


def test_copies_of_a_text_count_once_in_training(spark):
    hot = [("one two three four", "aa")] * 400  # a language of one text
    many = [(prose(i, 30, "qrstuvwx"), "bb") for i in range(3)] + [(prose(9, 30, "mnop"), "bb")] * 400
    table = spark.createDataFrame(hot + many, "text string, lang string")
    model = language.train(table, docs_per_language=20)
    once = language.train(table.distinct(), docs_per_language=20)
    assert np.array_equal(model.codes, once.codes) and np.array_equal(model.logs, once.logs)
    assert np.array_equal(model.uses, once.uses) and model.uses.any(axis=0).all()
    texts = spark.createDataFrame([("four three two one",), (prose(1, 30, "qrstuvwx"),)], "text string")
    assert [r["lang_pred"] for r in language.identify(texts, model).collect()] == ["aa", "bb"]


# --- mixing


def targets_of(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    open_, left = set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ = open_ - full if full else set()
    return target


def test_mix_meets_its_targets(docs, rows):
    placed, drawn = mixing.plan_mix(docs, block=8)
    out = mixing.taken_words(placed, drawn).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target, taken = targets_of(sizes), collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(8 * 3, 0.02 * target[s])
    again = mixing.taken_words(*mixing.plan_mix(docs.repartition(5), block=8)).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 5, 7, 31, 1000, 9999):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(4)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_shards_are_a_multinomial_draw(spark):
    """A source of a third: variance of its share by shard, and neighbouring shards independent."""
    n, shard = 3_000_000, 1024
    at = mixing.permuted(F.col("id"), F.lit(n), F.lit(17), F.lit(-1))
    got = spark.range(n // 3).groupBy(F.floor(at / shard).alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy("s").collect()
    share = np.array([r["k"] for r in got][: n // shard]) / shard
    expected = np.sqrt((1 / 3) * (2 / 3) / shard)
    assert abs(share.std() / expected - 1) < 0.05
    assert abs(np.corrcoef(share[1:], share[:-1])[0, 1]) < 0.05


def test_counts_of_each_shard(spark, docs):
    """Every slot is filled once, and a source has its quota of slots."""
    targets = mixing.source_targets(mixing.sizes(docs)).collect()
    slots = mixing.slots(mixing.source_targets(mixing.sizes(docs)), 8, 16, 17).collect()
    assert sorted(r["position"] for r in slots) == list(range(len(slots)))
    assert all(r["shard"] == r["position"] // 16 for r in slots)
    for t in targets:
        blocks = -(-t["source_size"] // 8)
        mine = [r for r in slots if r["_i"] == t["_i"]]
        assert len(mine) == (round(t["target"] * blocks / t["source_size"]) if t["source_size"] else 0)
        for e in {r["epoch"] for r in mine}:
            of = [r["_block"] for r in mine if r["epoch"] == e]
            assert len(set(of)) == len(of) and set(of) <= set(range(blocks))


def test_streams_are_cut_without_gaps(spark):
    """A third of the rows is one text with one id; sums run through all of a source."""
    rows = [(7, "same words here", "hot")] * 300 + [(i, "w " * (i % 9), "hot" if i % 2 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, drawn = mixing.plan_mix(docs, block=8)
    got = placed.select("_i", "_start", "size").collect()
    for i in (0, 1):
        at = 0
        for r in sorted((r for r in got if r["_i"] == i), key=lambda r: (r["_start"], r["size"])):
            assert r["_start"] == at
            at += r["size"]


def test_mixed_documents(spark, docs):
    out = mixing.mix_documents(docs, block=8)
    assert out.columns == docs.columns
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").split())
    for r in out.collect():
        words = r["text"].split()
        assert words and r["n_chars"] == len(r["text"])
        assert any(_is_subsequence(words, t) for t in texts[r["doc_id"]])
    assert mixing.mix_documents(empty_docs(spark)).count() == 0


def _is_subsequence(part, whole):
    it = iter(whole)
    return all(w in it for w in part)


# --- packing


def test_plan_is_sound_and_shrinks():
    draw = np.random.default_rng(2)
    for _ in range(30):
        lengths = sorted(draw.choice(np.arange(5, 200), 3, replace=False).tolist())
        counts = {int(s): int(draw.integers(1, 40)) for s in draw.integers(1, lengths[-1] + 1, 25)}
        plan = packing.plan_bins(counts, lengths, packing.default_costs(lengths))
        used = collections.defaultdict(list)
        seen = collections.Counter()
        for size, first, n, bin_, per, offset in plan.steps:
            assert first == seen[size]
            seen[size] += n
            for k in range(n):
                used[bin_ + k // per].append((offset + k % per * size, size))
        assert seen == counts
        for first, bins, length, words in plan.groups:
            for b in range(first, first + bins):
                parts = sorted(used.pop(b))
                assert all(a + s == b2 for (a, s), (b2, _) in zip(parts, parts[1:])) and parts[0][0] == 0
                assert sum(s for _, s in parts) == words <= length
                assert all(x >= length or x < words for x in lengths)  # the shortest that holds it
        assert not used


def test_plan_equals_best_fit_piece_by_piece():
    """One permitted length: the contents of all bins are those of best fit decreasing, each bin searched."""
    draw = np.random.default_rng(6)
    for _ in range(40):
        length = int(draw.integers(20, 120))
        counts = {int(s): int(draw.integers(1, 9)) for s in draw.integers(1, length + 1, 14)}
        bins = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fits = [b for b in bins if length - sum(b) >= size]
                if fits:
                    min(fits, key=lambda b: length - sum(b)).append(size)
                else:
                    bins.append([size])
        plan = packing.plan_bins(counts, [length], {length: length})
        got = collections.defaultdict(list)
        for size, _, n, bin_, per, _ in plan.steps:
            for k in range(n):
                got[bin_ + k // per].append(size)
        assert len(got) == len(bins)
        assert collections.Counter(sum(b) for b in got.values()) == collections.Counter(sum(b) for b in bins)


def test_packed_documents(spark, docs, rows):
    out = packing.pack(docs, lengths=(32, 64, 128)).collect()
    words = collections.Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    got = collections.Counter()
    for r in out:
        got[r["doc_id"]] += r["n_words"]
        assert r["bin_id"] is not None or r["n_words"] == 0
    assert +got == +words and {30, 31, 32} <= {r["doc_id"] for r in out}
    bins = packing.sequences(docs, lengths=(32, 64, 128)).collect()
    assert sum(b["n_words"] for b in bins) == sum(words.values())
    for b in bins:
        assert len(b["text"].split(" ")) == b["n_words"] <= b["length"] and b["length"] in (32, 64, 128)
        assert len(b["doc_ids"]) == len(b["offsets"]) and b["offsets"][0] == 0
    assert packing.pack(empty_docs(spark)).count() == 0 and packing.sequences(empty_docs(spark)).count() == 0


# --- sentence spans


def brute_removal(rows, run_words, run_sentences):
    """Every run of sentences, as short as it may be, compared as text."""
    order = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows if r["text"]}, key=lambda x: x[:2])
    first, marks = {}, {}
    for doc in order:
        parts, ends = spans.parts(doc[2])
        n = [len(p.split()) for p in parts]
        run = lambda i, j: j > i and sum(ends[i : j - 1]) >= run_sentences - 1 and sum(n[i:j]) >= run_words
        found = set()
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                if run(i, j) and not (run(i, j - 1) and run(i + 1, j)):
                    found.add((i, j))
        covered = set()
        for i, j in sorted(found):
            key = tuple(" ".join(p.split()) for p in parts[i:j])
            if key in first:
                covered.update(range(i, j))
            else:
                first[key] = doc
        marks[doc] = ("".join(p for i, p in enumerate(parts) if i not in covered), len(covered))
    return marks


@pytest.mark.parametrize("run_words,run_sentences", [(spans.RUN_WORDS, spans.RUN_SENTENCES), (25, 1), (12, 4)])
def test_repeated_passages_equal_brute_force(spark, run_words, run_sentences):
    passage = prose(1000, 60)
    lone = " ".join(f"v{i}" for i in range(30)) + ". "
    rows = [(i, prose(i, 80)) for i in range(10)]
    rows += [(20, prose(20, 50) + " " + passage), (21, prose(21, 40) + "\n" + passage + "\n" + prose(22, 30)), (22, passage)]
    rows += [(23, prose(23, 30) + " " + prose(1000, 60)[:150]), (24, passage + " " + passage), (25, None), (26, ""), (27, "one")]
    clauses = ", ".join(" ".join(f"c{i}{k}" for k in range(7)) for i in range(9)) + ". Then an end, of a kind."
    rows += [(40, f"{prose(41, 30)[:-1]} and {clauses}"), (41, f"So {clauses[:200]} {prose(42, 30)}"), (42, f"{clauses[60:]} {prose(43, 30)}")]
    rows += [(30, prose(30, 40) + " " + lone + prose(31, 40)), (31, prose(32, 40) + " " + lone + prose(33, 40))]
    rows += [(None, passage), (21, prose(21, 40) + "\n" + passage + "\n" + prose(22, 30))]
    table = spark.createDataFrame([(*r, 1, 2, f"k{r[0]}") for r in rows], "doc_id long, text string, n_removed int, other int, span_key string")
    out = spans.remove_repeats(table, run_words, run_sentences)
    assert out.columns == ["doc_id", "text", "other", "span_key", "n_sentences", "n_removed"]
    found = out.collect()
    assert all(r["span_key"] == f"k{r['doc_id']}" for r in found)
    got = collections.Counter((r["doc_id"], r["text"]) for r in found)
    marks = brute_removal(table.collect(), run_words, run_sentences)
    want = collections.Counter(
        (i, marks[(i is None, i or 0, t)][0] if t else t) for i, t in rows
    )
    assert got == want
    kept = sum(passage in (t or "") for _, t in got)
    assert kept == 1  # the first one stays
    assert all(lone in t for i, t in got if i in (30, 31)) == (run_sentences > 1)  # a single sentence is no run
    assert spans.remove_repeats(empty_docs(spark)).count() == 0


def test_passage_that_begins_and_ends_inside_sentences_goes(spark, tmp_path):
    """Through the query and the stage: only the edge sentences of the host stay."""
    sizes = [5, 9, 8, 6, 10, 7, 10]
    names = iter(f"w{i}" for i in range(100))
    passage = " ".join(" ".join(next(names) for _ in range(n)) + "." for n in sizes)[:-1]
    assert len(passage.split()) == 55
    inner = " ".join(spans.sentences(passage)[1:-1])
    short = " ".join(f"v{i}" for i in range(14)) + ". " + " ".join(f"u{i}" for i in range(14)) + ". "
    rows = [(i, f"{prose(i, 60)[:-1]} in as {passage} and on x{i}. {prose(50 + i, 60)}", "en", "s", 1) for i in (1, 2, 3)]
    rows += [(i, f"{prose(i, 60)} {short}{prose(50 + i, 60)}", "en", "s", 1) for i in (4, 5)]
    plain = [(i, prose(i, 90), "en", "s", 1) for i in range(10, 20)] + [(20, None, "en", "s", 1), (21, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows + plain, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    outs = spans.op9_sentence_spans(spark, str(tmp_path)), corpus_pipeline.repeated_passages(spark, docs, str(tmp_path))
    for out in outs:
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        want = {i: t for i, t, *_ in rows + plain}
        for i in (2, 3):
            head, tail = want[i].split(" ".join(inner.split()))
            want[i] = head + tail.lstrip()
        want[5] = want[5].replace(short, "")
        assert got == want


def test_sentences_are_the_text():
    for text in ("a, " * 40 + "b", "A b. C d!  E\n\nf g", "no end", "...", "\n\n a", "x." * 50):
        assert "".join(spans.sentences(text)) == text == "".join(spans.parts(text)[0])
        assert len(spans.sentences(text)) == sum(spans.parts(text)[1])
