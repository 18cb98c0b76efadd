"""HTML extraction on chosen pages, and against a plain version on pages with one article."""

import html
import random
import re

import pytest

from mdloom.llm.html_extraction import extract, main_text, op12_tree_scoring_html_extraction

P = "Some words of prose that stand here, with commas, and go on for a while until the sentence ends."
Q = "Other words, as many as it takes to make a paragraph that a reader would stop to read, follow."

PAGES = {
    "": "",
    "just text": "just text",
    "<p>Short.": "Short.",
    "a &lt;b&gt; &amp;amp; &eacute;&#x4e2d;&#20013; &am x&nbsp;y": "a <b> &amp; é中中 &am x y",
    "<nav>menu</nav>": "",
    f"<article><p>{P}</p></article><aside><p>{Q}</p></aside>": P,
    f"<article><p>{P}<p>{Q}": f"{P} {Q}",
    f"<article><p>wo<b>r</b>d<i> x</i><br>y\n\t z</p></article><div class=ad><p>{P}</p></div>": "word x y z",
    f"<article><p>Tiny.</p></article><div><p>{P}</p></div><footer>f</footer>": f"{P}",
    f"<article><p>{P}</p></article><section class='comments-area'><article class=comment><p>{P * 9}</p></article></section>": P,
    f"<div id=header>Site</div><div id=c><h2>T</h2><p>{P}<div class=x><p>{Q}</div>End.</div><div class=sidebar><p>{Q}</p></div>": f"T {P} {Q} End.",
    f"<main><header><h1>Title</h1><p>by line</p></header><section><p>{P}</section><form><p>{Q}</p></form></main>": f"Title {P}",
    f"<main><h1>T</h1><article><p>{P}</p></article></main><p>{Q}</p>": f"T {P}",
    f"<body class='has-sidebar'><div class=cookie-banner>{Q}</div><div><p>{P}</p><p>{Q}</p></div>": f"{P} {Q}",
    f"<div class=advert><p>{P}</p></div>": P,
    f"<div>{P}<br><br>{Q}</div>": f"{P} {Q}",
    f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a><td>{P}<p>{Q}</table>": f"{P} {Q}",
    f"<article><p>{P}<ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul><p>{Q}</article>": f"{P} {Q}",
    f"<article><p>{P}<ul><li>one<li>two, <a href=/c>three</a></ul></article>": f"{P} one two, three",
    f"<article><script>'</article>' < 1</script><p>x < y, {P}<!-- <p>no --><style>p</style></article>": f"x < y, {P}",
    f"<article><p title=\"a > b\" class='x'>{P}</p><p hidden>{Q}</p><p style='display: none'>{Q}</p></article>": P,
    f"<article><p>{P}<!-- no end <p>{Q}": P,
    f"<div class=post><p>{P}</p></div><div class=post><p>{Q}</p></div>": f"{P} {Q}",
    f"<h1>T</h1><div><p>{P}</p><p>{P}</p></div><p>Closing words.</p>": f"T {P} {P} Closing words.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


def plain(page):
    inner = re.search("<article[^>]*>(.*?)</article>", page, re.S)[1]
    inner = re.sub("</?(?:p|h1|h2|li|ul|br|blockquote)(?:\\s[^>]*)?>", " ", inner)
    return " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())


def page_of(rng):
    words = ["alpha", "béta,", "gamma.", "漢字", "&amp;", "&lt;x&gt;", "<b>bold</b>", "<i>it", "x\n y", "<br>", "&quot;q&quot;", "<a href='/l'>link</a>"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    body = "".join(rng.choice([f"<p>{some(60)}</p>", f"<p class='x y'>{some(9)}", f"<blockquote>{some(20)}</blockquote>", f"<ul><li>{some(9)}<li>plain</ul>"]) for _ in range(rng.randint(1, 8)))
    furniture = [f"<nav><ul><li><a href=/>{some(3)}</a></ul></nav>", f"<div class='{rng.choice(['ad', 'side-bar menu', 'cookieNotice', 'Share'])}'>{some(40)}</div>", f"<aside>{some(9)}</aside>"]
    rng.shuffle(furniture)
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{furniture[0]}<!-- c --><article><h1>{some(6)}</h1>{body}</article>{furniture[1]}<footer>&copy;</footer>" + rng.choice(["", "</body></html>"])


def test_pages_with_one_article_against_a_plain_version(spark):
    rng = random.Random(5)
    pages = [page_of(rng) for _ in range(300)]
    pages.append(f"<body><article><h1>long</h1>{''.join(f'<p>{P} {i}' for i in range(20_000))}</article>")
    rows = [(i, f"u{i}", p, "clash", 3) for i, p in enumerate(pages)] + [(0, "u0", pages[0], "clash", 3), (None, None, None, None, None), (7, None, "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert len(got) == len(rows)
    for r, want in zip(got, rows, strict=True):
        text = plain(want[2]) if want[2] else ""
        assert (r.page_id, r.url, r.text, r.n_chars) == (want[0], want[1], text, len(text))
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<a x="', "<div>", "</div>", "<!--", "<script>", "<p>", "&", "<li>", "<table><tr><td>", "<b><p>", "<article>", "<p>" + P])
def test_awkward_pages_take_linear_time(piece):
    import time

    began = time.time()
    main_text(piece * 20_000)
    assert time.time() - began < 20


def test_the_query_reads_whole_pages(spark, tmp_path):
    spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in op12_tree_scoring_html_extraction(spark, str(tmp_path)).collect()] == [(1, "u", P, len(P))]
