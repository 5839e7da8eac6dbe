"""Embeddings, archives, pages and the pipeline."""

import base64
import contextlib
import hashlib
import html.parser
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harvestlens.llm import content, vectors, warc
from harvestlens.llm.catalog import ORACLES, QUERIES
from harvestlens.llm.labelled_pages import labelled_pages
from harvestlens.session import shared_folder
from tests.llm.data import awkward_docs, empty_docs, prose

# --- embeddings


def vector_rows(n=160, dim=16, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    x = centres[draw.integers(0, 12, n)] + 0.12 * draw.normal(size=(n, dim))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def brute_links(rows):
    clean = []
    for i, (_, v) in enumerate(rows):
        ok = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        clean.append(np.array(v, dtype=np.float64) if ok else None)
    part, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(clean):
        for j in range(i):
            b = clean[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= 0.95:
                degree[i] += 1
                degree[j] += 1
                part[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    low = [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(rows))]
    return [(k, d, m if clean[i] is not None else k) for i, ((k, _), d, m) in enumerate(zip(rows, degree, low))]


def test_links_equal_brute_force(spark):
    rows = vector_rows()
    rows += [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1]), (None, rows[1][1])]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] + [1.0] * 15)]
    rows += [(605, rows[2][1][:8]), (606, [2 * c for c in rows[2][1][:8]]), (607, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    out = vectors.near_duplicates(df, recall=0.9999)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str)
    assert got == sorted(brute_links(rows), key=str)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect() if r["vec_id"] is not None)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold_is_as_planned():
    draw = np.random.default_rng(8)
    k, tables = vectors.table_plan(50_000, 0.95, 0.95, vectors.WIDTH)
    a = draw.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    ha, hb = (vectors.bucket_hashes(x, k, tables, vectors.WIDTH, 11) for x in (a, b))
    assert (ha == hb).any(axis=1).mean() > 0.9
    far = (ha[:300] == ha[300:]).any(axis=1).mean()
    assert far < 0.05


# --- archives


@contextlib.contextmanager
def split_size(spark, size):
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def read_back(spark, pages, split=None, **options):
    path = shared_folder(spark, "test-archive")
    warc.write_warc(pages, path, **options)
    with split_size(spark, split):
        return warc.read_warc(spark, path).collect()


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("split", [None, 700])
def test_round_trip_with_records_inside_payloads(spark, split):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "http://a/WARC/1.1", "<p>plain é 漢</p>"),
        (2, "http://b\r\nX: y", "before\r\n\r\n" + inner + "\r\n\r\nWARC/1.0\r\nContent-Length: 1000\r\n\r\nafter"),
        (3, None, inner),
        (4, "http://d", None),
        (5, "http://e", "\r\n\r\nWARC/1."),
        (6, "http://f", "<p>plain é 漢</p>"),
        (7, "http://g", ""),
        (7, "http://g", "twice"),
        (7, "http://g", "twice"),
        (None, "http://h", "twice"),
        (8, "http://i", "x" * 5000 + "\r\n\r\n" + inner * 3),
        (9, "http://j", "WARC/1.1\r\n\r\n\r\n"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int").coalesce(2)
    found = read_back(spark, df, split)
    assert len(found) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        h = h or ""
        again = i != first[h]
        want.append((i, "revisit" if again else "response", first[h] if again else None, "sha1:" + sha(h), "" if again else h))
    number = lambda x: int(x[12:-1]) if x and x[12:-1] else None
    got = [(number(r["record_id"]), r["type"], number(r["refers_to"]), r["digest_header"], bytes(r["payload"]).decode()) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["digest"] == sha(bytes(r["payload"]).decode()) for r in found)


@pytest.mark.parametrize("plans", [(None, None), (6000, 6000), (None, 9000), (9000, None)])
def test_payloads_belong_to_their_records_whatever_the_split_plan(spark, plans):
    """The second pass over the files may be dealt otherwise than the first."""
    cut = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 40) + (cut * (i % 3) if i % 7 == 0 else "")) for i in range(150)]
    rows.append((1000, "http://long", "é" * (40_000 if any(plans) else 4_000_000) + cut + "end"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = shared_folder(spark, "test-archive")
    warc.write_warc(pages, path)
    with split_size(spark, plans[0]):
        found = warc.read_warc(spark, path)
    with split_size(spark, plans[1]):
        # a new plan: what was stored stays, the files are dealt anew
        got = {warc_id(r["record_id"]): bytes(r["payload"]).decode() for r in found.select("*").collect()}
    assert got == {i: h for i, _, h in rows}


def warc_id(name):
    return int(name[12:-1])


def test_changed_payload_is_reported(spark, tmp_path):
    page = spark.createDataFrame([(1, "http://a", "abcdef")], "page_id long, url string, html string")
    text = warc.records(page).first()["record"]
    (tmp_path / "x.warc").write_bytes((text.replace("abcdef", "abcxef") + "\r\n\r\n").encode())
    with pytest.raises(ValueError, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()
    kept = warc.read_warc(spark, f"file://{tmp_path}", strict=False).collect()
    assert [bytes(r["payload"]) for r in kept] == [b"abcxef"]


def test_broken_archives_are_reported(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError, match="x.warc"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_back(spark, empty) == []


def test_small_payloads_can_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    kinds = sorted(r["type"] for r in read_back(spark, df, revisit_from=5))
    assert kinds == ["response", "response", "response", "revisit"]


# --- pages


def brute_marginals(model, parents, features):
    n = len(parents)
    total, main = 0.0, np.zeros(n)
    phi = sum(u[features[:, j]] for j, u in enumerate(model.unary))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        log = sum(phi[i, y[i]] for i in range(n)) + model.root[y[0]]
        log += sum(model.edge[y[parents[i]], y[i]] for i in range(1, n))
        total += np.exp(log)
        main += np.exp(log) * np.array(y)
    return main / total


def test_marginals_equal_enumeration():
    model = content.default_model()
    page = content.parse(labelled_pages(1, seed=3)[0])
    n = min(11, len(page.parents))
    parents, depths, features = (np.array(x[:n]) for x in (page.parents, page.depths, page.features))
    assert model.marginals(parents, depths, features) == pytest.approx(brute_marginals(model, parents, features))
    # two trees side by side are two trees
    both = model.marginals(np.concatenate((parents, np.where(parents < 0, -1, parents + n))), np.tile(depths, 2), np.tile(features, (2, 1)))
    assert both[:n] == pytest.approx(both[n:])


def test_held_out_pages():
    model = content.default_model()
    right = wrong = missed = 0
    for source in labelled_pages(150, seed=77):
        page = content.parse(source)
        keep = model.marginals(np.array(page.parents), np.array(page.depths), np.array(page.features)) >= 0.5
        for b, text in page.segments:
            right += len(text) * (keep[b] and page.marked[b])
            wrong += len(text) * (keep[b] and not page.marked[b])
            missed += len(text) * (not keep[b] and page.marked[b])
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.97


def test_texts_of_pages(spark):
    pages = [
        (1, "<html><body><nav><a href=1>Home</a></nav><article><h1>T &amp; t</h1><p>One<br>two\n  three&nbsp;four.<p>Last <b>bo</b>ld.</article><footer>&copy; x</footer>"),
        (2, None),
        (3, ""),
        (4, "<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Only this &lt;b&gt;.</p>"),
        (5, "<nav><a href=/>a</a></nav>"),
        (6, "<article><p>Good text here.</p><div class='comments'><p>A reader wrote this, at length. Really.</p></div><form><p>Your name</p></form></article>"),
        (6, "<article><p>" + "long text. " * 20000 + "</p></article>"),
        (7, "<p>unclosed <b>tags <i>everywhere"),
        (8, "<" * 2000 + "p>" + "<p class=\"" * 500),
    ]
    df = spark.createDataFrame([(*p, "old", "u") for p in pages], "page_id long, html string, text string, url string")
    out = content.extract(df)
    assert out.columns == ["page_id", "html", "url", "text", "n_chars"]
    rows = [(r["page_id"], r["text"]) for r in out.collect()]
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    found = dict(rows[:6] + rows[7:])
    assert found[1] == "T & t\nOne two three four.\nLast bold."
    assert (found[2], found[3], found[5]) == ("", "", "") and found[4] == "Only this <b>."
    assert found[6] == "Good text here." and found[7] == "unclosed tags everywhere"
    assert len(rows[6][1]) == len("long text. " * 20000) - 1
    assert content.extract(df.limit(0)).count() == 0


def test_text_behind_heads_and_scripts_is_not_skipped():
    def text(source):
        return "\n".join(t for _, t in content.parse(source).segments)

    header = "<html><head><title>No</title><body><article><p>First.</p><header><h1>Title</h1></header><p>Last.</p></article>"
    assert text(header) == "First.\nTitle\nLast."
    assert text(header.replace("<body>", "")) == "First.\nTitle\nLast."
    assert text(header.replace("<body>", "</HEAD ><BODY class=x>")) == "First.\nTitle\nLast."
    dotted = "<p>" + "\u0130" * 40 + "</p><script>var a = '</scripts>';</SCRIPT\n><p>Kept text.</p><style>p{}</style><p>Too.</p>"
    assert text(dotted) == "\u0130" * 40 + "\nKept text.\nToo."
    assert text("<p>A</p><script>cut</script") == text("<p>A</p><style>cut") == "A"


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 200_000 + "x",
        "<b>" * 100_000 + "</b>" * 100_000,
        "<b>" * 100_000 + "<div>a</div>" * 50_000,
        "<div>" * 100_000 + "<li>a</li>" * 50_000,
        "<svg>" * 100_000,
        "</b>" * 200_000,
        "<p><i>" * 100_000,
    ],
)
def test_pages_of_unclosed_tags_take_linear_time(page):
    started = time.process_time()
    content.parse(page)
    assert time.process_time() - started < 4


class _Blocks(html.parser.HTMLParser):
    """Texts by innermost block element, by the standard library's parser, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [[]], []

    def handle_starttag(self, tag, attrs):
        if tag not in content._INLINE:
            self.close_text()
            self.open.append([])

    def handle_endtag(self, tag):
        if tag not in content._INLINE:
            self.close_text()
            self.open.pop()

    def handle_data(self, data):
        self.open[-1].append(data)

    def close_text(self):
        text = " ".join("".join(self.open[-1]).split())
        if text:
            self.found.append(text)
        self.open[-1] = []


def test_tree_builder_agrees_with_a_second_parser_on_well_formed_pages():
    draw = np.random.default_rng(12)

    def piece(depth):
        kind = draw.integers(0, 6)
        if depth > 5 or kind == 0:
            return f" w{draw.integers(0, 99)} &amp; é&#233; "
        if kind == 1:
            name = draw.choice(["b", "i", "span", "em", "math", "mi"])
            return f"<{name}>x{draw.integers(0, 99)}</{name}>"
        name = draw.choice(["div", "section", "article", "blockquote", "td", "figure"])
        inner = "".join(piece(depth + 1) for _ in range(draw.integers(0, 4)))
        return f'<{name} class="c{kind}">{inner}</{name}>'

    for _ in range(60):
        page = "".join(piece(0) for _ in range(6)).replace("td", "div")
        other = _Blocks()
        other.feed(page)
        other.close()
        other.close_text()
        assert [t for _, t in content.parse(page).segments] == other.found, page


def test_formulas_in_an_article_stay():
    text = [t for _, t in content.parse("<article><p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows</p></article>").segments]
    assert text == ["as x=2 shows"]


# --- pipeline and queries


def test_pipeline_on_awkward_rows(spark):
    docs = awkward_docs(spark).drop("score", "kept", "_w")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        path = shared_folder(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {20, 30, 31, 32, 33}
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert bins and all(len(b["text"].split(" ")) == b["n_words"] for b in bins)
    none = empty_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_language_stage_keeps_clean_documents(spark):
    rows = [(i, prose(i, 80, "abcdefgh" if i % 2 else "qrstuvwx"), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "12 34", "aa"), (101, None, "bb")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(60))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_sql(spark, name):
    from tests.compare import database, difference, spark_rows, sql_rows

    sf_dir = "/root/testdata/sf0.001"
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert difference(got, sql_rows(database(sf_dir), ORACLES[name])) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
