"""Pages whose main text is known because they were built around it."""

from __future__ import annotations

import html as escapes
import random
import time

import pytest

from tanteo.llm import html_text

MAIN = "<p>Main text of this page</p>"


@pytest.mark.parametrize("page", [
    f'<div class="post no-sidebar">{MAIN}</div>',
    f'<div class="content related">{MAIN}</div>',
    f'<div id="social-history">{MAIN}</div>',
    f'<div class="page-widget">{MAIN}</div>',
    f'<article><div class="search-results-story">{MAIN}</div></article>',
    f'<form id="aspnetForm"><article>{MAIN}</article></form>',
    f'<form id="aspnetForm"><input name="q"><div>{MAIN}</div><button>Go</button></form>',
    f'<div class="sidebar">{MAIN}</div>',
    f'<div class="widget"><main>{MAIN}</main></div><div>{"other words " * 30}</div>',
    f'<div class="wrapper"><div class="cookie-banner">We use cookies</div>{MAIN}</div>',
    f'{MAIN}<form>Your mail <button>Send</button></form><div id="comments">{"<article>I think so too and more</article>" * 5}</div>',
    f'<div>{MAIN}<ul class="share-buttons"><li>x</ul><section class="related posts">Read on</section><div class="ad top">Buy</div></div>',
])
def test_the_main_text_survives_its_surroundings(page):
    for whole in (page, f"<html><body>{page}</body></html>"):
        assert "\n".join(html_text.read(whole).texts) == "Main text of this page"


def built(source):
    """A page and its main text: blocks inside random boxes, furniture between them that the reader must drop."""
    word = lambda: source.choice(["uno", "d&os", "tres", "<b>cua</b>tro", "cinco", "s eis"])
    expected = []

    def sentence():
        words = [word() for _ in range(source.randint(3, 12))]
        expected.append(" ".join(" ".join(words).replace("<b>", "").replace("</b>", "").split()))
        return escapes.escape(" ".join(words)).replace("&lt;b&gt;", "<b>").replace("&lt;/b&gt;", source.choice(["</b>"]))

    def furniture():
        return source.choice([
            "<nav><ul><li>menu</ul></nav>", '<div class="ad">buy</div>', "<script>var p = '<p>';</script>", "<style>p{}</style>", "<aside>more</aside>",
            '<div class="cookie-notice">cookies</div>', "<form><input>mail</form>", "<!-- no -->", '<div role="banner">x</div>', "<div hidden>x</div>",
        ])

    def block(depth):
        kind = source.randint(0, 5 if depth else 2)
        if kind == 0:
            return f"<p>{sentence()}" + source.choice(["</p>", ""])
        if kind == 1:
            return f"<h2>{sentence()}</h2>"
        if kind == 2:
            return "<ul>" + "".join(f"<li>{sentence()}" for _ in range(source.randint(1, 3))) + "</ul>"
        if kind == 3:
            return furniture()
        tag = source.choice(["div", "section", "div class='row no-ads'", "blockquote"])
        return f"<{tag}>" + "".join(block(depth - 1) for _ in range(source.randint(1, 3))) + f"</{tag.split()[0]}>"

    body = "<p>" + sentence() + "</p>" + "".join(block(3) for _ in range(source.randint(2, 6)))
    body = source.choice(["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>"]).format(body)
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><header>head</header>{furniture()}{body}{furniture()}<footer>foot</footer></body></html>"
    return page, "\n".join(expected)


def test_built_pages_give_back_their_text(spark):
    source = random.Random(31)
    pages = [built(source) for _ in range(200)]
    # each on a host of its own, so that nothing recurs
    frame = spark.createDataFrame([(i, f"https://h{i}.example/", p) for i, (p, _) in enumerate(pages)], "page_id int, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in html_text.extracted(frame).collect()}
    wrong = [i for i, (_, text) in enumerate(pages) if found[i] != text]
    assert not wrong, (pages[wrong[0]], found[wrong[0]])


def test_template_is_removed_the_same_whether_sent_or_joined(spark):
    source = random.Random(32)
    boxes = [f"<div><p>Box {k} of the site, with its words</p></div>" for k in range(4)]
    lines = ["<p>This line of ten words stands on many pages</p>", "<p>Yes.</p>"]
    rows = []
    for i in range(300):
        parts = [b for b in boxes if source.random() < 0.6] + [x for x, share in zip(lines, (0.4, 0.1), strict=True) if source.random() < share]
        rows.append((i, source.choice(["https://a.org/x", "HTTPS://A.org?x", "https://b.org/"]), f"<body>{''.join(parts)}<div><p>Only text {i} is here</p></div>"))
    rows += [rows[3]] * 3 + [(None, None, boxes[0]), (500, None, None)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    sent, joined = order(html_text.extracted(frame)), order(html_text.extracted(frame, max_sent=-1))
    assert sent == joined and len(sent) == len(rows)
    wrong = [r for r in sent if r[0] not in (None, 500) and not (r[2].endswith(f"Only text {r[0]} is here") and "Box" not in r[2])]
    assert not wrong
    assert any("Yes." in r[2] for r in sent) and not any("ten words" in r[2] for r in sent)


def test_time_grows_with_the_page_only():
    started = time.perf_counter()
    n = 100_000
    deep = html_text.read("<div>" * n + "<p>x</p>" + "</div>" * n)
    assert deep.texts == ["x"] and len(deep.hashes) == n + 1
    each = html_text.read("".join(f"<div>t{i}" for i in range(n // 4)))
    assert len(each.texts) == n // 4
    assert html_text.read("<div>" * n + "</b>" * n + "<p>x").texts == ["x"]
    assert html_text.read("<form><div class='ad'>" * (n // 4) + "x").texts == ["x"]
    assert time.perf_counter() - started < 30
