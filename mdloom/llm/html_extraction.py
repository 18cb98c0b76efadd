"""Main text of web pages by tree scoring.

A page's tags become a tree of its block elements. Every block with text of its own passes points, for its length and
its commas and less what share of it is link text, to its ancestors: in full to the nearest, half to the next, ever less further
up. A container's points are discounted by its own link density once more; the best container is kept, with the siblings
that have points or read like paragraphs. What lies in an article or main element is taken as far as that element reaches.
Page furniture gets no points and is left out wherever it stands. Pages are independent: there is no shuffle.

What counts as furniture: elements and roles that say so (nav, aside, footer, form, script and the like), elements hidden by attribute or
inline style, class or id words (menu, sidebar, cookie, advert, comments and the like, see below), and lists of short links.
Class words never take an element that holds an article, main or h1, except in comment threads; where they would leave no
text at all, they are not used. Of a header element, only headings within an article or main are kept.

Defined cases: null is the empty page; a page without a container keeps all its text that is no furniture; tags are closed as HTML
implies, an unclosed comment, script or tag reaches to the page's end; character references are decoded as HTML5 does, once;
white space is what Unicode calls so, no-break spaces included; an empty table gives no rows; rows that share page_id or all they
have are taken one by one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

#: Least characters of a block that passes points, and characters that are worth as much as the block itself.
LEAST, LENGTH = 25, 100
#: A sibling stays from this share of the best container's points on; a paragraph beside it, up to this link density.
SHARE, DENSITY = 0.2, 0.25
#: Elements that say that they hold the content have their points times this.
OWN, _CONTENT = 3, ("article", "main")
#: A list of so many links, each of so many characters at most on average, is a menu if this share of its text is links.
LINKS, LINK_CHARS, LINK_SHARE = 3, 40, 0.9

_RAW = "script style textarea title noscript iframe noembed noframes xmp template svg math select option button object audio video canvas"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{_RAW.replace(' ', '|')})(?=[\s/>])(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z|(?=<))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?P<rest>(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure "
    "figcaption address center details summary fieldset hgroup header footer nav aside form dialog menu search hr head".split()
)
_FURNITURE = set("nav aside footer form dialog menu search head fieldset".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element, up to the element that bounds the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"})}
_CLOSES |= dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})) | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"}))
_BOUNDS = set("td th caption table html".split())

_THREAD = set("comment comments commentlist disqus respond replies reply discussion livefyre".split())
_WORDS = _THREAD | set(
    "nav navbar navigation navigationbar menu submenu breadcrumb breadcrumbs sidebar sidebars sidenav rail widget widgets footer masthead topbar header "
    "toolbar ad ads adbox adslot advert adverts advertisement advertising advertisment adsense sponsor sponsored sponsors promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup signin login paywall alert "
    "related recommended recommendations share sharing social shares pagination pager paginator skip copyright disclaimer legal outbrain taboola".split()
)
_NOT = set("has with no without is".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _marks(rest: str) -> tuple[bool, set[str]]:
    """(furniture by role or hidden, words of class and id) of a tag's attributes."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    gone = "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", ""))) or values.get("role", "").lower() in _ROLES
    words = {w.lower() for k in ("class", "id") if k in values for w in _SPLIT.split(html.unescape(values[k])) if w}
    return gone, set() if words & _NOT else words & _WORDS


class Page:
    """A page's block elements in page order, and its text by the element it stands in."""

    def __init__(self, page: str):
        self.parent, self.name, self.gone, self.words, self.pieces = [-1], ["html"], [False], [set()], []
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # name, element, within a link
        self.open = {"html": 1}
        at = 0
        for m in _TOKEN.finditer(page):
            self._text(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if m["end"]:
                self._end(name)
            elif name:
                self._start(name, m["rest"])
        self._text(page[at:])

    def _text(self, text: str) -> None:
        if text:
            _, element, link = self.stack[-1]
            self.pieces.append((element, html.unescape(text) if "&" in text else text, link))

    def _break(self) -> None:
        self.pieces.append((self.stack[-1][1], " ", False))

    def _pop(self, size: int) -> None:
        for name, _, _ in self.stack[size:]:
            self.open[name] -= 1
        block = any(name in _BLOCKS for name, _, _ in self.stack[size:])
        del self.stack[size:]
        if block:
            self._break()

    def _close(self, names: set[str], bounds: set[str]) -> None:
        if any(self.open.get(n) for n in names):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in names:
                    return self._pop(i)
                if self.stack[i][0] in bounds:
                    return None
        return None

    def _start(self, name: str, rest: str) -> None:
        if name in _BLOCKS:
            self._close({"p"}, _BOUNDS)
            if name in _CLOSES:
                self._close(*_CLOSES[name])
            if name == "body" and len(self.stack) > 1 and self.stack[1][0] == "head":
                self._pop(1)
        elif name == "a":
            self._close({"a"}, _BOUNDS)
        if name in ("html", "br") or name in _VOID and name in _BLOCKS:
            self._break()
        if name in _VOID or name == "html":
            return
        gone, words = _marks(rest) if rest.strip("/ \n\t") else (False, set())
        _, element, link = self.stack[-1]
        if name in _BLOCKS or gone or words:
            if name in _BLOCKS:
                self._break()
            self.parent.append(element)
            self.name.append(name)
            self.gone.append(gone or name in _FURNITURE)
            self.words.append(words if name not in ("body", "main") else set())
            element = len(self.name) - 1
        self.stack.append((name, element, link or name == "a"))
        self.open[name] = self.open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if self.open.get(name) and name not in ("html", "body"):
            i = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name)
            if i:
                self._pop(i)

    def dropped(self, by_words: bool) -> list[bool]:
        """The elements that are furniture or within it."""
        size = len(self.name)
        holds, thread, inside = [False] * size, [False] * size, [False] * size
        for i in range(1, size):
            thread[i] = thread[self.parent[i]] or bool(self.words[i] & _THREAD)
            inside[i] = inside[self.parent[i]] or self.name[i] in _CONTENT
        for i in range(size - 1, 0, -1):
            if holds[i] or self.name[i] in ("article", "main", "h1") and not thread[i]:
                holds[self.parent[i]] = True
        out = [False] * size
        heads = [False] * size
        for i in range(1, size):
            by = by_words and bool(self.words[i]) and (bool(self.words[i] & _THREAD) or not (holds[i] or self.name[i] in ("article", "main", "h1")))
            heads[i] = (heads[self.parent[i]] or self.name[i] == "header") and not (inside[i] and re.fullmatch("h[1-6]", self.name[i]))
            out[i] = out[self.parent[i]] or self.gone[i] or by
        out = [a or b for a, b in zip(out, heads, strict=True)]
        return self._menus(out)

    def _sums(self, out: list[bool]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """Per element: own characters and commas, link characters of its own, and characters and link characters below it too."""
        size = len(self.name)
        own, commas, linked = [0] * size, [0] * size, [0] * size
        for element, text, link in self.pieces:
            if not out[element]:
                n = len(text.strip())
                own[element] += n
                commas[element] += text.count(",") + text.count("，") + text.count("、")
                linked[element] += n * link
        total, links = own[:], linked[:]
        for i in range(size - 1, 0, -1):
            total[self.parent[i]] += total[i]
            links[self.parent[i]] += links[i]
        return own, commas, linked, total, links

    def _menus(self, out: list[bool]) -> list[bool]:
        _, _, _, total, links = self._sums(out)
        count, menus = [0] * len(out), [False] * len(out)
        for element, text, link in self.pieces:
            count[element] += bool(link and text.strip())
        for i in range(len(out) - 1, 0, -1):
            count[self.parent[i]] += count[i]
        for i in range(1, len(out)):
            menu = self.name[i] in ("ul", "ol", "table", "div", "section", "dl") and count[i] >= LINKS
            menus[i] = menus[self.parent[i]] or menu and links[i] >= LINK_SHARE * total[i] and links[i] <= LINK_CHARS * count[i]
        return [a or b for a, b in zip(out, menus, strict=True)]

    def kept(self, out: list[bool]) -> list[bool]:
        """The elements whose text is kept: the best container and its siblings, without furniture."""
        own, commas, linked, total, links = self._sums(out)
        points = [0.0] * len(out)
        for i in range(len(out)):
            if own[i] >= LEAST and not out[i]:
                worth = (1 + commas[i] + own[i] / LENGTH) * (1 - linked[i] / own[i])
                up, level = self.parent[i] if self.name[i] in _PARAGRAPHS or self.name[i] == "li" else i, 0
                while up >= 0:
                    points[up] += worth / (1, 2)[level] if level < 2 else worth / (3 * level)
                    up, level = self.parent[up], level + 1
                    if level > 8:
                        break
        points = [p * (1 - links[i] / total[i]) * (OWN if self.name[i] in _CONTENT else 1) if total[i] else 0.0 for i, p in enumerate(points)]
        best = max(range(len(points)), key=points.__getitem__)
        if points[best] <= 0:
            best = next((i for i in range(len(out)) if self.name[i] in _CONTENT and total[i] and not out[i]), 0)
        whole = self._whole(best, out)
        chosen = {whole or best}
        for i in range(1, len(points)):
            if not whole and best and self.parent[i] == self.parent[best] and not out[i] and total[i]:
                if points[i] >= SHARE * points[best] or self.name[i] in _PARAGRAPHS and links[i] <= DENSITY * total[i]:
                    chosen.add(i)
        under = [False] * len(out)
        for i in range(len(out)):
            under[i] = i in chosen or i > 0 and under[self.parent[i]]
        return [a and not b for a, b in zip(under, out, strict=True)]

    def _whole(self, best: int, out: list[bool]) -> int:
        """The article or main element that ``best`` belongs to: a main element if it holds one article at most; 0 if there is none."""
        up, line = best, []
        while up > 0:
            line += [up] * (self.name[up] in _CONTENT)
            up = self.parent[up]
        for i in line:
            if self.name[i] == "main" and sum(n == "article" and not out[k] and self._within(k, i) for k, n in enumerate(self.name)) <= 1:
                return i
        return line[0] if line else 0

    def _within(self, element: int, outer: int) -> bool:
        while element > outer:
            element = self.parent[element]
        return element == outer

    def text(self) -> str:
        out = self.dropped(True)
        if not any(t.strip() and not out[e] for e, t, _ in self.pieces):
            out = self.dropped(False)
        keep = self.kept(out)
        return " ".join("".join(t for e, t, _ in self.pieces if keep[e]).split())


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op12_tree_scoring_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages whose one article element holds the main text and nothing else, as those of ``pages`` do.
OP12_SQL = r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's') AS t FROM pages
), b AS (
    SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a
), c AS (
    SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b
), e AS (
    SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c
)
SELECT page_id, url, text, length(text) AS n_chars FROM e
"""
