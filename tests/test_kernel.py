"""The Markdown kernel on one document at a time."""

import random

import pytest

from mdloom.kernel import grammar, parse
from mdloom.kernel.constructs import Constructs
from mdloom.kernel.inlines import classify, literal_kind, pairs
from mdloom.kernel.render import encode_href, html, signature
from mdloom.kernel.snapshot import snapshot
from mdloom.sources.corpus import TOKENS


def draw(text, constructs=None):
    raw = text.encode()
    return html(raw, parse(raw, constructs)[0])


@pytest.mark.parametrize(
    "text,want",
    [
        ("\tfoo\tbaz\t\tbim\n", "<pre><code>foo\tbaz\t\tbim\n</code></pre>\n"),
        ("  - foo\n\n\tbar\n", "<ul>\n<li>\n<p>foo</p>\n<p>bar</p>\n</li>\n</ul>\n"),
        ("- foo\n\n\t\tbar\n", "<ul>\n<li>\n<p>foo</p>\n<pre><code>  bar\n</code></pre>\n</li>\n</ul>\n"),
        (">\t\tfoo\n", "<blockquote>\n<pre><code>  foo\n</code></pre>\n</blockquote>\n"),
        ("- `one\n- two`\n", "<ul>\n<li>`one</li>\n<li>two`</li>\n</ul>\n"),
        ("+++\n", "<p>+++</p>\n"),
        ("Foo\n***\nbar\n", "<p>Foo</p>\n<hr />\n<p>bar</p>\n"),
        ("# foo *bar* \\*baz\\*\n", "<h1>foo <em>bar</em> *baz*</h1>\n"),
        ("### foo \\###\n", "<h3>foo ###</h3>\n"),
        ("Foo *bar\nbaz*\n====\n", "<h1>Foo <em>bar\nbaz</em></h1>\n"),
        ("`Foo\n----\n`\n", "<h2>`Foo</h2>\n<p>`</p>\n"),
        ("> foo\n-----\n", "<blockquote>\n<p>foo</p>\n</blockquote>\n<hr />\n"),
        ("```\naaa\n~~~\n```\n", "<pre><code>aaa\n~~~\n</code></pre>\n"),
        ("> ```\n> aaa\n\nbbb\n", "<blockquote>\n<pre><code>aaa\n</code></pre>\n</blockquote>\n<p>bbb</p>\n"),
        ("<div>\n*foo*\n</div>\n", "<div>\n*foo*\n</div>\n"),
        ("[foo]: <my url>\n'title'\n\n[foo]\n", '<p><a href="my%20url" title="title">foo</a></p>\n'),
        ("[foo]: /url '\ntitle\n'\n\n[foo]\n", '<p><a href="/url" title="\ntitle\n">foo</a></p>\n'),
        ("[ΑΓΩ]: /φου\n\n[αγω]\n", '<p><a href="/%CF%86%CE%BF%CF%85">αγω</a></p>\n'),
        ("> bar\nbaz\n> foo\n", "<blockquote>\n<p>bar\nbaz\nfoo</p>\n</blockquote>\n"),
        ("123456789. ok\n", '<ol start="123456789">\n<li>ok</li>\n</ol>\n'),
        ("- foo\n-\n- bar\n", "<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n"),
        ("1. a\n\n  2. b\n\n    3. c\n", "<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n<pre><code>3. c\n</code></pre>\n"),
        ("``foo`bar``\n", "<p><code>foo`bar</code></p>\n"),
        ("*foo`*`\n", "<p>*foo<code>*</code></p>\n"),
        ("*foo**bar**baz*\n", "<p><em>foo<strong>bar</strong>baz</em></p>\n"),
        ("***foo** bar*\n", "<p><em><strong>foo</strong> bar</em></p>\n"),
        ("foo***bar***baz\n", "<p>foo<em><strong>bar</strong></em>baz</p>\n"),
        ("**foo*bar**\n", "<p><strong>foo*bar</strong></p>\n"),
        ("*foo _bar* baz_\n", "<p><em>foo _bar</em> baz_</p>\n"),
        ("[link](foo(and(bar)))\n", '<p><a href="foo(and(bar))">link</a></p>\n'),
        ("[foo [bar](/uri)](/uri)\n", '<p>[foo <a href="/uri">bar</a>](/uri)</p>\n'),
        ("![[[foo](uri1)](uri2)](uri3)\n", '<p><img src="uri3" alt="[foo](uri2)" /></p>\n'),
        ("<MAILTO:FOO@BAR.BAZ>\n", '<p><a href="MAILTO:FOO@BAR.BAZ">MAILTO:FOO@BAR.BAZ</a></p>\n'),
        ("<a><bab><c2c>\n", "<p><a><bab><c2c></p>\n"),
        ("foo  \n     bar\n", "<p>foo<br />\nbar</p>\n"),
        ("&nbsp; &copy; &#35; &bogus; &#0;\n", "<p>\u00a0 © # &amp;bogus; \ufffd</p>\n"),
    ],
)
def test_specification_examples(text, want):
    assert draw(text, Constructs.commonmark()) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("| a | b |\n| - | :-: |\n| c |\n", '<table>\n<thead>\n<tr>\n<th>a</th>\n<th align="center">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>c</td>\n<td align="center"></td>\n</tr>\n</tbody>\n</table>\n'),
        ("~~a~~ ~~~b~~~\n", "<p><del>a</del> ~~~b~~~</p>\n"),
        ("- [x] a\n", '<ul>\n<li><input type="checkbox" disabled="" checked="" /> a</li>\n</ul>\n'),
        ("www.a.com/x(y). u@e.org\n", '<p><a href="http://www.a.com/x(y)">www.a.com/x(y)</a>. <a href="mailto:u@e.org">u@e.org</a></p>\n'),
        ("ftp://a.b\n", "<p>ftp://a.b</p>\n"),
    ],
)
def test_extensions(text, want):
    assert draw(text) == want


@pytest.mark.parametrize(
    "text,types",
    [
        ("a\n> 2. b\n", ["Paragraph", "Blockquote"]),
        ("    code\n2. x\n", ["CodeBlock", "List"]),
        ("> a\n<a>\n> c\n", ["Blockquote"]),
        ("a\n{% x\nb\n", ["Paragraph"]),
        ("a\n{% x %}\nb\n", ["Paragraph", "Liquid", "Paragraph"]),
        ("{%\n<!-->\n2)  \n", ["Paragraph", "HtmlBlock", "List"]),
        (":::😀\nx\n", ["Paragraph"]),
        ("::: tip t\nx\n:::\n", ["ContainerDirective"]),
        ("- [x]   \n  :-:\n", ["List"]),
    ],
)
def test_chosen_behaviour(text, types):
    assert [k.type for k in parse(text.encode())[0].kids] == types


def test_indented_code_is_one_block_without_trailing_blanks():
    assert draw(">\n    a\n    b\n") == "<blockquote>\n</blockquote>\n<pre><code>a\nb\n</code></pre>\n"
    assert draw("    a\n      \nb\n") == "<pre><code>a\n</code></pre>\n<p>b</p>\n"


def test_snapshot_has_spans_and_segments():
    root, blocks = parse(b"> [a]: /u\n\n\t\xc3\xa9\n")
    assert snapshot(root, blocks) == (
        'Root [0..15]\n  Blockquote [0..9]\n    Definition [2..9] dest=[7..9] "/u" angle=false\n      label[0] [3..4] "a"\n'
        '  CodeBlock [12..14] kind=indented\n    lines[0] [12..14] "é"\nblanks: [10..10]\n'
    )


def test_presets():
    assert not Constructs.commonmark().gfm_table and Constructs.gfm().gfm_table and not Constructs.gfm().wiki_link
    with pytest.raises(NotImplementedError):
        Constructs.mdx()
    assert [k.type for k in parse(b"a $$b$$ [[c]]", Constructs.gfm())[0].kids[0].kids] == ["Text"]


def test_lexical_pieces():
    assert pairs([("*", 1, "", "a"), ("*", 1, "a", "")]) == [(0, 1, False)]
    assert pairs([("**", 2, "", "a")][:0]) == []
    assert classify("_", "a", "b") == (False, False) and classify("*", "a", "b") == (True, True)
    assert [literal_kind(x) for x in ("http://x.y", "www.x.y", "u@e.com")] == ["Http", "Www", "Email"]
    assert grammar.normalize_label(" ẞ \n a ") == "ss a" and grammar.decode("\\* &amp; &#x41; &nope;") == "* & A &nope;"
    assert encode_href("a b%zz%41&é") == "a%20b%zz%41&amp;%C3%A9"
    assert grammar.row_cells(b"| a \\| b | c |") == [(2, 8), (11, 12)]


def test_signature_of_equal_structures():
    one, two = b"*a* b\n", b"_a_ b"
    assert signature(one, parse(one)[0]) == signature(two, parse(two)[0]) == '[p(em(t{"a"})t{" b"}),]'


def walk(node, source, low, high):
    assert low <= node.start <= node.end <= high
    at = node.start
    for kid in node.kids:
        assert kid.start >= at
        at = kid.end
        walk(kid, source, node.start, node.end)
    assert node.type != "Text" or node.end > node.start
    for a, b, pad in (s for key, x in node.segments.items() if key != "text" for s in x):
        assert node.start <= a <= b <= node.end and 0 <= pad <= 3 and not {10, 13} & set(source[a:b])


def test_spans_hold_on_token_soup():
    rng = random.Random(0)
    for _ in range(3000):
        source = "".join(rng.choice([*TOKENS, "\r\n", "\r"]) for _ in range(rng.randint(2, 40))).encode()
        root, blocks = parse(source)
        walk(root, source, 0, len(source))
        html(source, root), signature(source, root)
        assert blocks.blanks == sorted(blocks.blanks) and all(not source[a:b].strip(b" \t") for a, b in blocks.blanks)


def test_long_runs_stay_fast():
    for text in ("[" * 3000, "*a " * 3000, "> " * 400, "`" * 50 + " `" * 3000, "{{ " * 3000, "[[" * 3000, "a@" * 2000, "<!-- " * 2000, "www." * 2000):
        parse(text.encode())
