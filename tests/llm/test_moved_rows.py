"""What the document operators move, send and leave behind."""

import os

import numpy as np

from harvestlens.llm import jaccard, language, packing, spans
from tests.llm.data import awkward_docs, edited, prose


def test_places_of_bands_follow_the_lists(spark, monkeypatch):
    """The rows that tell the places of bands grow with the lists, not with the size of the table of bits too."""
    draw = np.random.default_rng(3)
    bands = draw.integers(0, 2**63, (2000, 60)).astype(np.uint64)
    bands[1000:, :20] = bands[:1000, :20]  # these occur twice
    bands[5, :2] = bands[5, 2]  # one that only one row has, three times
    lists = spark.createDataFrame([(jaccard._narrow(b),) for b in bands], "bands binary").repartition(2).cache()
    sent, kind = [], type(lists)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: (sent.append(df.count()), plain(df, *by))[1])
    for expected in (bands.size, 1 << 26):
        marks, bits = jaccard.twice_marks(lists, "bands", expected)
        places = (jaccard._wide(jaccard._narrow(bands.reshape(-1))) & np.uint64(bits - 1)).astype(np.int64)
        value, n = np.unique(places, return_counts=True)
        found = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little"))
        assert found.tolist() == value[n > 1].tolist() and len(found)
    assert bits == jaccard.MARK_BITS
    assert sent[1] <= 1.1 * sent[0] and sent[1] <= 6 * 128  # batches of 500 rows, five or six


def test_packing_moves_texts_and_not_lists_of_words(spark):
    docs = awkward_docs(spark)

    def kinds_met(plan):
        met = []
        if plan.nodeName() == "Join":
            for side in (plan.left(), plan.right()):
                met += [side.output().apply(i).dataType().simpleString() for i in range(side.output().size())]
        for i in range(plan.children().size()):
            met += kinds_met(plan.children().apply(i))
        return met

    out = packing.sequences(docs, lengths=(32, 64, 128))
    met = kinds_met(out._jdf.queryExecution().optimizedPlan())
    assert "string" in met and "array<string>" not in met


def test_sequences_hold_every_copy_of_a_row(spark, tmp_path):
    """Rows that are there again, long ones and null ids among them, are in as many sequences as rows."""
    rows = [(1, prose(1, 300)), (2, prose(2, 20)), (None, prose(3, 90)), (3, "a \t b\nc"), (4, ""), (5, None)]
    rows = rows + rows[:4] * 3
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    out = packing.sequences(spark.read.parquet(str(tmp_path / "docs")), lengths=(32, 64, 128)).collect()
    got = {}
    for b in out:
        words = b["text"].split(" ")
        assert len(words) == b["n_words"]
        for doc, first, end in zip(b["doc_ids"], b["offsets"], [*b["offsets"][1:], len(words)]):
            got.setdefault(doc, []).append(" ".join(words[first:end]))
    want = {}
    for doc, text in rows:
        words = (text or "").split()
        for at in range(0, len(words), 128):
            want.setdefault(doc, []).append(" ".join(words[at : at + 128]))
    assert {d: sorted(t) for d, t in got.items()} == {d: sorted(t) for d, t in want.items()}


def test_no_table_of_all_runs_is_left(spark):
    text = prose(1, 200)
    docs = spark.createDataFrame([(1, text), (2, text + " " + text), (3, edited(text, 2, 9)), (None, None)], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    left = lambda: {d for d in os.listdir(folder) if d.startswith("runs-")} if os.path.isdir(folder) else set()
    before = left()
    out = spans.remove_repeats(docs, 16, 3)
    assert {r["doc_id"]: r["n_removed"] > 0 for r in out.collect()} == {1: False, 2: True, 3: True, None: False}
    assert left() == before


def test_a_kept_text_is_sent_once_for_its_language(spark):
    docs = awkward_docs(spark).drop("score")
    model = language.train(language.training_rows(docs))
    sent = lambda df: df._jdf.queryExecution().analyzed().children().apply(0).output().size()
    kept, apart = language.identify(docs, model), language.identify(docs, model, keep=["doc_id", "n_chars"])
    assert sent(kept) == len(docs.columns) and sent(apart) == 3
    assert kept.columns == [*docs.columns, "lang_pred", "score"] and apart.columns == ["doc_id", "n_chars", "lang_pred", "score"]
    both = [sorted(df.select("doc_id", "n_chars", "lang_pred", "score").collect(), key=str) for df in (kept, apart)]
    assert both[0] == both[1]
