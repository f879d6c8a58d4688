"""Packing, token output, HTML and the pipeline: exact round trips."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tanteo.llm import best_fit_packing, html_text, token_output
from tanteo.llm.tokens import default_vocabulary, pieces

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", "a few words", "the the the", "long text " * 3_000, "long text " * 3_000, "x" * 5_000, "a <|endoftext|> b", "ünïcödé"]


def whole_ids(text):
    known = tokenizers.Tokenizer.from_file(default_vocabulary())
    return np.array([*known.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_pieces_cut_only_what_is_too_long():
    assert pieces(5, 5) == [(0, 5)] and pieces(11, 5) == [(0, 1), (1, 5), (6, 5)] and pieces(10, 5) == [(0, 5), (5, 5)]


def test_every_token_has_one_place(docs):
    rows = best_fit_packing.pack(docs(*TEXTS)).collect()
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole_ids(TEXTS[r.doc_id])[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for found in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(found))])
        assert [at for at, _ in sorted(found)] == ends[:-1].tolist() and ends[-1] <= best_fit_packing.CAPACITY
    for i, text in enumerate(TEXTS):
        assert sorted(by_doc[i]) == [(n, *p) for n, p in enumerate(pieces(len(whole_ids(text)), best_fit_packing.CAPACITY))]
    assert best_fit_packing.pack(docs(*TEXTS).limit(0)).count() == 0


def fewest(lengths, capacity):
    """Least number of sequences, by trying everything."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for j in {f: k for k, f in enumerate(free) if f >= lengths[i]}.values():
            place(i + 1, [f - lengths[i] * (k == j) for k, f in enumerate(free)])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    source = random.Random(5)
    for _ in range(150):
        capacity = source.choice([10, 15, 20])
        lengths = sorted((source.randint(1, capacity) for _ in range(source.randint(0, 8))), reverse=True)
        counts = {n: lengths.count(n) for n in set(lengths)}
        fixed, left = best_fit_packing.reduced(counts, capacity)
        rest = [n for n, k in left.items() for _ in range(k)]
        assert sum(uses for _, uses in fixed) + fewest(sorted(rest, reverse=True), capacity) == fewest(lengths, capacity)
        plan = best_fit_packing.ranges(counts, capacity)
        assert plan["sequence"].nunique() <= fewest(lengths, capacity) + 1


def test_segment_tree_finds_the_tightest_sequence():
    source = random.Random(6)
    for _ in range(200):
        capacity = source.choice([7, 8, 31, 100])
        lengths = [source.randint(1, capacity) for _ in range(source.randint(0, 60))]
        free = []
        for n in sorted(lengths, reverse=True):
            fitting = [f for f in free if f >= n]
            if fitting:
                free.remove(min(fitting))
            free.append((min(fitting) if fitting else capacity) - n)
        packed = token_output.best_fit_decreasing(lengths, capacity)
        assert sorted(i for s in packed for i in s) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[i] for i in s) for s in packed) == sorted(free)


def test_binary_rows_round_trip(docs, tmp_path, spark):
    token_output.write(docs(*TEXTS), str(tmp_path / "out"), buffer_tokens=4_000)
    texts = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(places) == token_output.CAPACITY and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            texts[doc][start] = ids[a:b]
    for i, text in enumerate(TEXTS):
        assert np.concatenate([p for _, p in sorted(texts[i].items())]).tolist() == whole_ids(text).tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header>
<nav><ul><li><a>m</a></ul></nav><div class="ad">ad</div><article><h1>Ti &amp; tle</h1><p><b>A b.<br><p>C  d&nbsp;e <i>f</i>g</p>
<ul><li>x<li>y</ul><div class="comments"><p>no</p></div><aside>z</aside><form>f</form><p>end &am</article><footer>&copy;</footer>"""


def test_main_text_of_a_page():
    assert html_text.read(PAGE)[0] == ["Ti & tle", "A b.", "C d e fg", "x", "y", "end &am"]
    assert html_text.read(None)[0] == html_text.read("")[0] == html_text.read("<p><!-- <p>x")[0] == []


def test_only_comments_hide_text():
    for before in ("<script><!-- x</script>", '<script>document.write("<!--")</script>', "<style><!-- </style>", "<textarea><!--</textarea>",
                   '<a title="<!--">', "<!-- x --!>", "<!-->", "<!--->", "<!-- a -- b -->", "<title>a <!-- b</title>"):
        assert html_text.read(f"<body>{before}<article><p>The text</p></article>")[0] == ["The text"], before
    assert html_text.read("<p>a</p><!-- <p>b</p> -- > <p>c")[0] == ["a"]


def test_recurring_boxes_go_and_copies_stay(spark):
    box = "<div><p>Read our other pages</p></div>"
    rows = [(i, f"https://a.org/{i}", f"<body>{box}<div><p>Text number {i}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "https://b.org/x", f"<body>{box}<div><p>The one text</p></div></body>") for i in range(30)]
    rows += [(200, None, None), (201, "https://c.org", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    texts = {r.page_id: r.text for r in html_text.extracted(frame).collect()}
    assert all(texts[i] == f"Text number {i}" for i in range(30))
    assert all(texts[100 + i] == "Read our other pages\nThe one text" for i in range(30)) and texts[200] == texts[201] == ""
    assert html_text.extracted(frame.limit(0)).count() == 0


def test_template_does_not_depend_on_the_size_of_the_host(spark):
    box, line, links = "<div>Read this next</div>", "<p>All rights belong to us</p>", "<ul><li>one<li>two</ul>"
    rows = [(i, "https://a.org/", f"<article><p>Text {i}</p>{box if i < 12 else ''}{'<h2>Summary</h2>' if i < 11 else ''}{line}{links}</article>") for i in range(200)]
    rows += [(300 + i, "https://b.org/", f"<body>{box}<p>Text {i}</p></body>") for i in range(6)]
    rows += [(400 + i, "https://c.org/", f"<article><p>Text {i}</p><table><tr><td>Yes<td>{i}</table></article>") for i in range(20)]
    texts = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(texts[i] == (f"Text {i}\nSummary" if i < 11 else f"Text {i}") for i in range(200))
    assert all(texts[300 + i] == f"Text {i}" for i in range(6)) and all(texts[400 + i] == f"Text {i}\nYes\n{i}" for i in range(20))


def test_pipeline_keeps_clean_documents(spark, prose, tmp_path):
    item = prose(40, 1)
    texts = [prose(120, s) for s in range(10, 40)]
    texts[1] = texts[0] + " more"
    texts[2] = "junk " * 80
    texts[3] = f"{prose(60, 2)} {item} {prose(60, 3)}"
    texts[4] += " password=abcdefgh"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        left.append({r.doc_id for r in docs.collect()})
    everything = set(range(len(texts)))
    assert left == [everything - {2}, everything - {1, 2}, everything - {1, 2, 3}, everything - {1, 2, 3}]
    assert docs.where("doc_id = 4").first().text.endswith(" [secret]")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[-1]
