"""A tree as HTML, and as a canonical signature: handlers by node type over an explicit work list."""

from __future__ import annotations

import json
import re

from . import grammar as g
from .inlines import literal_kind
from .tree import Node, Segment

SAFE = frozenset(b"-_.+!*'(),#@?=;:/$~" + bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))


def join(source: bytes, pieces: list[Segment]) -> str:
    """Pieces as text: lines joined, virtual spaces written out."""
    return "\n".join(" " * pad + source[a:b].decode(errors="replace") for a, b, pad in pieces)


def join_stripped(source: bytes, pieces: list[Segment], most: int) -> str:
    """As ``join``, but continuation lines lose up to ``most`` columns of leading white space."""
    out = []
    for i, (a, b, pad) in enumerate(pieces):
        text = source[a:b].decode(errors="replace")
        if i:
            cols = min(pad, most)
            pad -= cols
            while cols < most and text[:1] in (" ", "\t"):
                cols += 1 if text[0] == " " else 4 - cols % 4
                text = text[1:]
        out.append(" " * pad + text)
    return "\n".join(out)


def title_text(source: bytes, pieces: list[Segment] | None) -> str:
    return g.decode(join_stripped(source, pieces, 1 << 30)[1:-1]) if pieces else ""


def destination_text(raw: str, angle: bool) -> str:
    return g.decode(raw[1:-1] if angle else raw)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def encode_href(text: str) -> str:
    raw, out = text.encode(), []
    for i, b in enumerate(raw):
        if b == 0x26:
            out.append("&amp;")
        elif b == 0x25:
            out.append("%" if re.match(rb"[0-9A-Za-z]{2}", raw[i + 1 : i + 3]) else "%25")
        else:
            out.append(chr(b) if b in SAFE else f"%{b:02X}")
    return "".join(out)


class Cooked:
    """What both consumers need from a tree."""

    def __init__(self, source: bytes, root: Node):
        self.source = source
        self.targets: dict[str, tuple[str, str]] = {}
        todo = [root]
        while todo:
            node = todo.pop()
            if node.type == "Definition":
                self.targets.setdefault(self.label(node), (self.url(node), self.title(node)))
            todo += reversed(node.kids) if "text" not in node.segments else ()

    def slice(self, a: int, b: int) -> str:
        return self.source[a:b].decode(errors="replace")

    def span(self, node: Node, key: str) -> str:
        return self.slice(*node.spans[key]) if key in node.spans else ""

    def lines(self, node: Node, key: str = "pieces") -> str:
        return join(self.source, node.segments.get(key, []))

    def label(self, node: Node) -> str:
        return g.normalize_label(self.span(node, "label") if "label" in node.spans else self.lines(node, "label"))

    def url(self, node: Node) -> str:
        return destination_text(self.span(node, "dest"), node.props["angle"])

    def title(self, node: Node) -> str:
        return title_text(self.source, node.segments.get("title"))

    def target(self, node: Node) -> tuple[str, str] | None:
        return (self.url(node), self.title(node)) if node.props["kind"] == "inline" else self.targets.get(self.label(node))

    def plain(self, nodes: list[Node]) -> str:
        """The text content of inlines."""
        out = []
        todo = list(reversed(nodes))
        while todo:
            n = todo.pop()
            if n.type == "Text":
                out.append(g.decode(self.slice(n.start, n.end)))
            elif n.type == "SoftBreak":
                out.append("\n")
            elif n.type in ("CodeSpan", "HtmlInline", "Liquid"):
                out.append(self.lines(n))
            elif n.type == "MathSpan":
                out.append(self.lines(n).strip("$"))
            elif n.type == "Autolink":
                out.append(self.slice(n.start + 1, n.end - 1))
            elif n.type == "AutolinkLiteral":
                out.append(self.slice(n.start, n.end))
            elif n.type == "WikiLink":
                out.append(self.slice(n.start + 2, n.end - 2))
            else:
                todo += reversed(n.kids)
        return "".join(out)


class Html(Cooked):
    """HTML of a tree. Footnotes, math, template tags, wiki links and directives draw nothing."""

    def render(self, root: Node) -> str:
        self.out: list[str] = []
        work: list = [(k, False, False) for k in reversed(root.kids)]
        while work:
            job = work.pop()
            if isinstance(job, str):
                self.out.append(job)
            elif job is None:
                self.line()
            else:
                work += reversed(list(self.node(*job)))
        return "".join(self.out)

    def line(self) -> None:
        if self.out and not self.out[-1].endswith("\n") and any(self.out):
            last = next((x for x in reversed(self.out) if x), "")
            if last and not last.endswith("\n"):
                self.out.append("\n")

    def node(self, n: Node, tight: bool, cell: bool):
        """Strings, None for the start of a line, and nodes still to draw."""
        kids = [(k, False, cell) for k in n.kids]
        t, p = n.type, n.props
        if t == "Paragraph":
            yield from kids if tight else (None, "<p>", *kids, "</p>\n")
        elif t == "Heading":
            yield from (None, f"<h{p['level']}>", *kids, f"</h{p['level']}>\n")
        elif t == "ThematicBreak":
            yield from (None, "<hr />\n")
        elif t == "CodeBlock":
            lang = f' class="language-{escape(g.decode(self.span(n, "lang")))}"' if "lang" in n.spans else ""
            body = "".join(escape(join(self.source, [s])) + "\n" for s in n.segments["lines"])
            yield from (None, f"<pre><code{lang}>", body, "</code></pre>\n")
        elif t == "HtmlBlock":
            yield from (None, self.lines(n, "lines"), "\n" if p["newline"] else "", None)
        elif t == "Blockquote":
            yield from (None, "<blockquote>\n", *kids, None, "</blockquote>\n")
        elif t == "List":
            start = int(re.sub(r"\D", "", self.span(n.kids[0], "marker")) or 1) if p["ordered"] else 1
            yield from (None, f'<ol start="{start}">\n' if p["ordered"] and start != 1 else "<ol>\n" if p["ordered"] else "<ul>\n")
            for item in n.kids:
                yield from ("<li>", *self.item(item, p["tight"]), "</li>\n")
            yield "</ol>\n" if p["ordered"] else "</ul>\n"
        elif t == "Table":
            yield from self.table(n)
        elif t == "Text":
            yield escape(g.decode(self.slice(n.start, n.end)))
        elif t == "SoftBreak":
            yield "\n"
        elif t == "HardBreak":
            yield "<br />\n"
        elif t == "CodeSpan":
            text = self.lines(n).replace("\n", " ")
            yield f"<code>{escape(text.replace(chr(92) + '|', '|') if cell else text)}</code>"
        elif t == "HtmlInline":
            yield join_stripped(self.source, n.segments["pieces"], 3)
        elif t == "Autolink":
            inner = self.slice(n.start + 1, n.end - 1)
            yield f'<a href="{"mailto:" if p["email"] else ""}{encode_href(inner)}">{escape(inner)}</a>'
        elif t == "AutolinkLiteral":
            raw = self.slice(n.start, n.end)
            prefix = {"Http": "", "Www": "http://", "Email": "mailto:"}[literal_kind(raw)]
            yield f'<a href="{prefix}{encode_href(raw)}">{escape(raw)}</a>'
        elif t in ("Emphasis", "Strong", "Strikethrough"):
            tag = {"Emphasis": "em", "Strong": "strong"}.get(t, "del")
            yield from (f"<{tag}>", *kids, f"</{tag}>")
        elif t in ("Link", "Image"):
            target = self.target(n)
            if target:
                url, title = target
                title = f' title="{escape(title)}"' if title else ""
                if t == "Link":
                    yield from (f'<a href="{encode_href(url)}"{title}>', *kids, "</a>")
                else:
                    yield f'<img src="{encode_href(url)}" alt="{escape(self.plain(n.kids))}"{title} />'

    def item(self, item: Node, tight: bool):
        rest = item.kids
        if "checkbox" in item.spans:
            checked = ' checked=""' if item.props["checked"] else ""
            yield from ("" if tight else "\n<p>", f'<input type="checkbox" disabled=""{checked} />')
            while rest and rest[0].type == "Definition":
                rest = rest[1:]
            if rest and rest[0].type == "Paragraph":
                gap = self.slice(item.spans["checkbox"][1], rest[0].start)
                yield "\n" if "\n" in gap else gap
                yield from ((k, False, False) for k in rest[0].kids)
                rest = rest[1:]
            yield "" if tight else "</p>\n"
        for kid in rest:
            yield kid, tight, False

    def table(self, n: Node):
        head, *rows = n.kids

        def cells(tag: str, row: Node):
            for i, align in enumerate(n.props["align"]):
                style = f' align="{align.lower()}"' if align != "None" else ""
                kids = row.kids[i].kids if i < len(row.kids) else []
                yield from (f"<{tag}{style}>", *((k, False, True) for k in kids), f"</{tag}>\n")

        yield from (None, "<table>\n<thead>\n<tr>\n", *cells("th", head), "</tr>\n</thead>\n")
        if rows:
            yield "<tbody>\n"
            for row in rows:
                yield from ("<tr>\n", *cells("td", row), "</tr>\n")
            yield "</tbody>\n"
        yield "</table>\n"


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


class Signature(Cooked):
    """A canonical string of a tree with its values cooked, equal for trees that mean the same."""

    def of(self, root: Node) -> str:
        out: list[str] = []
        work: list = list(reversed(self.blocks(root.kids)))
        while work:
            job = work.pop()
            if isinstance(job, str):
                out.append(job)
            else:
                work += reversed(list(job[0](*job[1:])))
        return "".join(out)

    def blocks(self, nodes: list[Node], after_checkbox: bool = False) -> list:
        out: list = ["["]
        for i, n in enumerate(nodes):
            first = after_checkbox and n.type == "Paragraph" and all(k.type == "Definition" for k in nodes[:i])
            out += [(self.block, n, first), ","]
        return [*out, "]"]

    def inlines(self, nodes: list[Node], drop_break: bool = False) -> list:
        out: list = ["("]
        if drop_break and nodes and nodes[0].type == "SoftBreak":
            nodes = nodes[1:]
        text = ""
        for n in nodes:
            if n.type == "Text":
                text += g.decode(self.slice(n.start, n.end))
            elif n.type == "SoftBreak":
                text += "\n"
            else:
                out += [f"t{{{quote(text)}}}"] * bool(text) + [(self.inline, n)]
                text = ""
        return [*out, *[f"t{{{quote(text)}}}"] * bool(text), ")"]

    def block(self, n: Node, after_checkbox: bool):
        t, p = n.type, n.props
        if t in ("Paragraph", "Heading"):
            yield "p" if t == "Paragraph" else f"h{p['level']}"
            yield from self.inlines(n.kids, after_checkbox)
        elif t == "ThematicBreak":
            yield "hr"
        elif t == "CodeBlock":
            yield "code" + "".join(f"{{{quote(x)}}}" for x in (g.decode(self.span(n, "lang")), g.decode(self.span(n, "meta")), self.lines(n, "lines")))
        elif t == "HtmlBlock":
            value = self.lines(n, "lines") + ("\n" if p["newline"] else "")
            yield f"html{{{quote(value)}}}"
        elif t == "List":
            start = str(int(re.sub(r"\D", "", self.span(n.kids[0], "marker")))) if p["ordered"] else ""
            yield f"list{{{str(p['ordered']).lower()},{start},spread={str(not p['tight']).lower()}}}["
            for item in n.kids:
                box = "checkbox" in item.spans
                checked = ("x" if item.props["checked"] else "o") if box else ""
                yield f"li{{{checked},spread={str(item.props['spread']).lower()}}}"
                yield from self.blocks(item.kids, box)
                yield ","
            yield "]"
        elif t == "Definition":
            yield f"def{{{quote(self.label(n))},{quote(self.url(n))},{quote(self.title(n))}}}"
        elif t == "Table":
            yield "table{" + "".join({"None": "-"}.get(a, a[0].lower()) for a in p["align"]) + "}["
            for row in n.kids:
                yield "tr["
                for cell in row.kids:
                    yield "td"
                    yield from self.inlines(cell.kids)
                    yield ","
                yield "],"
            yield "]"
        elif t == "MathBlock":
            yield f"math{{{quote(g.decode(self.span(n, 'meta')))}}}{{{quote(self.lines(n, 'lines'))}}}"
        elif t == "Liquid":
            yield f"liquid{{{quote(self.lines(n))}}}"
        else:
            yield f"fn{{{quote(self.label(n))}}}" if t == "FootnoteDefinition" else {"Blockquote": "bq"}.get(t, "dir")
            yield from self.blocks(n.kids)

    def inline(self, n: Node):
        t = n.type
        if t in ("Emphasis", "Strong", "Strikethrough"):
            yield {"Emphasis": "em", "Strong": "strong"}.get(t, "del")
            yield from self.inlines(n.kids)
        elif t in ("Link", "Image"):
            tag, kind = "a" if t == "Link" else "img", n.props["kind"]
            yield f"{tag}{{{quote(self.url(n))},{quote(self.title(n))}}}" if kind == "inline" else f"{tag}ref{{{kind},{quote(self.label(n))}}}"
            yield from self.inlines(n.kids) if t == "Link" else [f"{{{quote(self.plain(n.kids))}}}"]
        elif t in ("Autolink", "AutolinkLiteral"):
            yield f"auto{{{quote(self.slice(n.start, n.end))}}}"
        elif t == "FootnoteReference":
            yield f"fnref{{{quote(self.label(n))}}}"
        elif t in ("CodeSpan", "HtmlInline", "Liquid"):
            yield {"CodeSpan": "code", "HtmlInline": "ihtml"}.get(t, "liquid") + f"{{{quote(self.lines(n))}}}"
        else:
            yield {"HardBreak": "br", "MathSpan": "imath"}.get(t, "wiki")


def html(source: bytes, root: Node) -> str:
    return Html(source, root).render(root)


def signature(source: bytes, root: Node) -> str:
    return Signature(source, root).of(root)
