"""Page extraction, vector searches, the piece codec, the pipeline and the queries against SQL."""

from __future__ import annotations

import heapq
import html as markup
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from pulseframe.llm.block_ann import TileSettings, nearest
from pulseframe.llm.html_extract import extract_pages, main_text
from pulseframe.llm.piece_codec import MODEL, Encoder, decode_column, encode_column, occurrence_ranges, piece_words, read_model, suffix_array, tokenized
from pulseframe.llm.pivot_search import PivotSettings, top_products
from pulseframe.llm.registry import llm_oracles, llm_queries
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


# --- pages


def article(page):
    """The given pages' own template, read by a pattern."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", inside.replace("<b>", ""))
    return "\n".join(x for x in (" ".join(markup.unescape(p).split()) for p in parts) if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


BOILERPLATE = (
    "<header><h1>Site name</h1><p>The best site, of all sites. Really.</p></header>", '<div id="cookie-notice">We use cookies, and more. Accept them all, please.</div>',
    '<ul class="menu"><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul>', "<aside><p>Read this as well, it is good. Very good, they say.</p></aside>",
    '<div class="sidebar"><p>Some side text that is long enough, truly. With commas, and stops.</p></div>', "<form><label>Your name, please.</label><input name=x><button>Send</button></form>",
    '<section class="comments"><p>I liked it, thanks. Do write more, soon.</p></section>', "<script>if (a < b) { x = '</p>'; }</script>", "<style>p > a { color: red }</style>",
    "<!-- <p>not shown, at all.</p> -->", "<footer>&copy; all rights, reserved.</footer>", '<div role="navigation"><a href="/">Home</a></div>', "<noscript>Turn it on, please.</noscript>",
)
ARTICLES = (
    ("<article><h1>A title</h1><p>First paragraph, with &lt;text&gt; &amp; more.<p>Second one;\n it goes on.</article>", "A title\nFirst paragraph, with <text> & more.\nSecond one; it goes on."),
    ('<main><h2>Head</h2><p>Some <b>bold</b> and <a href="/x">linked</a> text, here. And so on, and on.</p><ul><li>one<li>two</ul><p>Last words, of all.</p></main>', "Head\nSome bold and linked text, here. And so on, and on.\none\ntwo\nLast words, of all."),
    ('<div class="content"><p>Text in a plain div, of some length. It has stops.</p><table><tr><td>a<td>b<tr><td>c</table>Loose&nbsp; text, too.<p>And an end, at last.</div>', "Text in a plain div, of some length. It has stops.\na\nb\nc\nLoose text, too.\nAnd an end, at last."),
)


@pytest.mark.parametrize("text", ARTICLES)
def test_articles_amid_boilerplate(text):
    body, want = text
    draw = random.Random(1)
    for _ in range(20):
        parts = draw.sample(BOILERPLATE, 6)
        page = f"<html><head><title>T</title></head><body>{''.join(parts[:3])}{body}{''.join(parts[3:])}</body></html>"
        assert main_text(page) == want


PARAGRAPHS = [f"Paragraph {i}, of some length. It ends here, at last." for i in range(12)]


def test_nested_and_unwrapped_articles():
    lead, body = PARAGRAPHS[:2], PARAGRAPHS[2:]
    marked = ["".join(f"<p>{p}</p>" for p in x) for x in (lead, body)]
    nested = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><div class=lead>{marked[0]}</div><div class=body>{marked[1]}</div></article><footer>End, of all.</footer></body>"
    assert main_text(nested) == "\n".join(["Title", *PARAGRAPHS])
    unwrapped = f"<body><nav><a href=/>Home</a></nav><h1>Title</h1>{marked[0]}<h2>Part</h2><ul><li>one<li>two</ul><table><tr><td>cell</table>{marked[1]}<footer>End, of all.</footer></body>"
    assert main_text(unwrapped) == "\n".join(["Title", *lead, "Part", "one", "two", "cell", *body])


@pytest.mark.parametrize("attribute", ['class="content has-sidebar"', 'id="search-results"', 'class="skip social"', 'style="overflow: hidden"', 'data-hidden="false"', 'title="the hidden valley"', "aria-hidden=false", 'data-class="menu"'])
def test_marked_article(attribute):
    inside = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f'<body><nav><a href=/>Home</a></nav><div {attribute}><div class="entry-header"><h1>Title</h1></div>{inside}<div class="share"><a href=/s>Share this</a></div></div><div class="sidebar"><p>Some side text, of a length. Truly.</p></div></body>'
    assert main_text(page) == "\n".join(["Title", *PARAGRAPHS])


def test_hidden_parts_stay_silent():
    inside = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for hidden in ("hidden", 'hidden=""', "aria-hidden='true'", 'class=x HIDDEN'):
        assert main_text(f"<body><article>{inside}<p {hidden}>Not shown, at all. Never.</p></article></body>") == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a", "a"), ("<b>x</b> &amp; y", "x & y"), ("<<<>", "<<<>"), ("<p>" * 3000, ""), ("<div>" * 400 + "deep, text." + "</div>" * 400, "deep, text.")])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_long_page_and_columns(spark):
    body = "".join(f"<p>Paragraph {i}, of some length. It ends.</p>" for i in range(5000))
    rows = [(1, "u", f"<nav>x</nav><article>{body}</article>", "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", "<p>same id, again.</p>", "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [len(r.text.split("\n")) for r in got] == [5000, 1, 1, 1] and [r.n_chars for r in got[1:]] == [0, 0, len("same id, again.")]
    assert got[0].text == "\n".join(f"Paragraph {i}, of some length. It ends." for i in range(5000))


# --- vectors


def odd_vectors(spark, n=400, width=6):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=width) * (100 if i == 7 else 1)]) for i in range(n)]
    common = rows[5][1]
    rows += [(1000 + i, common) for i in range(150)]  # one very common vector
    rows += [(2000, None), (2001, [0.0] * width), (2002, [float("nan")] * width), (2003, [None, 1.0]), (2004, [float("inf"), 1.0]), (None, common), (40, rows[40][1]), (2005, []), (2006, [1.5, -2.0]), (2100, [1e-300, 0.0]), (2200, [-0.5] * (width + 2))]
    schema = "vec_id long, embedding array<float>, id long, score string, rank int, vector string, asks int"
    return spark.createDataFrame([(*r, 1, "s", 2, "v", 3) for r in rows], schema).repartition(4), rows


def brute(rows, every, k, take_zero, convert):
    clean = {}
    for i, v in rows:
        v = None if v is None else [x if x is None else float(np.float32(x)) for x in v]
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (take_zero or any(v)):
            clean[i] = convert(v)
    out = []
    for q, a in sorted(clean.items()):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in clean.items() if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(heapq.nsmallest(k, scored), 1)]
    return out


@pytest.mark.parametrize("settings", [TileSettings(), TileSettings(candidates=50, queries=7, strip=3, pairs=11)])
def test_nearest(spark, settings):
    frame, rows = odd_vectors(spark)
    got = [tuple(r) for r in nearest(frame, F.col("vec_id") % 20 == 0, 20, settings=settings).orderBy("query_id", "rank").collect()]
    want = brute(rows, 20, 20, False, lambda v: v)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("settings", [PivotSettings(), PivotSettings(sample=9, part=40, queries=3, annulus=5)])
def test_top_products(spark, settings):
    frame, rows = odd_vectors(spark)
    got = [tuple(r) for r in top_products(frame, F.col("vec_id") % 100 == 0, 10, settings=settings).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 100, 10, True, lambda v: [math.floor(1024 * x) for x in v])


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in nearest(few, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()] == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert [tuple(r) for r in top_products(few, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()] == [(0, 1, 20, 4 * 2**20), (0, 2, 3, 3 * 2**19)]
    for frame in (few.limit(0), few.where("vec_id = 3"), few.where("vec_id = 0")):
        assert nearest(frame, F.col("vec_id") % 20 == 0, 20).count() == 0 and top_products(frame, F.col("id") % 100 == 0, 10).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def model():
    return read_model()


def test_suffix_array_and_ranges():
    draw = random.Random(2)
    text = bytes(draw.choice(b"abc") for _ in range(700))
    data = np.frombuffer(text, dtype=np.uint8)
    order, found = suffix_array(data, 24)
    assert [text[i : i + 24] for i in order] == sorted(text[i : i + 24] for i in range(len(text)))
    pieces = [bytes(draw.choice(b"abcd") for _ in range(draw.randrange(1, 20))) for _ in range(200)]
    lo, hi = occurrence_ranges(order, found, piece_words(pieces))
    for piece, a, b in zip(pieces, lo, hi, strict=True):
        assert sorted(order[a:b]) == [i for i in range(len(text)) if text.startswith(piece, i)]


def test_pieces_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(5)
    names = [p.decode().replace("▁", " ") for p in model.pieces if p]
    texts = ["", " ", "   ", "a", " a", "a ", "\n\t", "a\x00b", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "日本語 梦 𒀀☃ ﬁ é́", "a" * 3000, "ab" * 500, "x " * 500, "  two  spaces   three", "The end.\n\nNew  line"]
    texts += ["".join(draw.choice("abcdeth ▁\néà梦ß.,<0x>") for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += ["".join(draw.choice(names) for _ in range(12)) for _ in range(500)]
    texts += [t for _, t in cases.texts() if t is not None]
    for encoder in (Encoder(model),):
        got = encode_column(encoder, pa.array(texts)).to_pylist()
        assert got == [library.encode(t) for t in texts]
        assert decode_column(model, pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in got]


def test_known_segments_are_bounded(model, monkeypatch):
    from pulseframe.llm import piece_codec

    monkeypatch.setattr(piece_codec, "KNOWN_SEGMENTS", 5)
    monkeypatch.setattr(piece_codec, "PORTION_BYTES", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [" ".join(cases.words(i, 12)) for i in range(30)]
    assert encode_column(Encoder(model), pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_tokenized(spark, model):
    frame = cases.documents(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = sorted(((r.text, r.doc_id) for r in frame.collect()), key=str)
    found = sorted(((library.decode(list(r.pieces)) if r.pieces is not None else None, r.doc_id) for r in tokenized(frame, model).collect()), key=str)
    assert found == texts and all(r.round_trip for r in tokenized(frame, model).collect())
    assert tokenized(cases.empty(spark), model).count() == 0


# --- pipeline


def test_stages(spark):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, cases.empty(spark), FOLDER).count() == 0
    rows = {(r.doc_id, r.text): r for r in corpus_pipeline.no_secrets(spark, docs, FOLDER).collect()}
    secret = next(t for i, t in rows if i == 16)
    assert secret == "[secret]' and [secret] é [secret]" and rows[16, secret].n_chars == len(secret)
    assert len({(i, t) for i, t in rows if i != 16} - set(cases.texts())) == 0
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, FOLDER).collect()}
    assert kept.isdisjoint({6, 7, 8, 11})
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, given, FOLDER).collect()}
    assert kept == {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(out) == len({r.doc_id for r in out}) and all(r.round_trip for r in out)
    from pulseframe.llm.secret_scan import spans_of

    for r in out:
        text = docs[r.doc_id].text
        if not spans_of(text):
            assert list(r.pieces) == library.encode(text)
    from tests.llm.test_text_operators import near_components

    letters = [(i, r.text) for i, r in docs.items() if any(c.isalpha() for c in r.text or "")]
    assert {r.doc_id for r in out} == {i for i, _, _, kept in near_components(letters, 5) if kept}


def test_mix_survives_files(spark, tmp_path):
    """Rows written to several files and read again in another order carry positions by which the sources keep their shares."""
    sizes = {"hot": 3600, "a": 400, "b": 400}
    rows = [(f"{s} {i}", s, "en") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    corpus_pipeline.in_mixed_order(spark, docs, FOLDER).repartition(7, "doc_id").write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.as_pieces(spark, spark.read.parquet(str(tmp_path / "mixed")), FOLDER).select("mix_position", "source").collect()
    assert len({r.mix_position for r in out}) == len(out) == 4400
    order = [r.source for r in sorted(out)]
    shares = {s: n**0.5 / 100 for s, n in sizes.items()}
    for t in range(32, 1600, 32):
        assert all(abs(order[:t].count(s) - share * t) <= 64 for s, share in shares.items())


# --- queries against SQL


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = database.execute(llm_oracles()[name])
    names = [c[0] for c in cursor.description]
    frame = llm_queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert want and sorted((tuple(r) for r in frame.select(*names).collect()), key=str) == want


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in llm_queries()} == set(range(1, 14))
    assert set(llm_queries()) | {"pipeline"} <= set(contract.queries())
