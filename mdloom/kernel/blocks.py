"""Block structure: one pass over the lines with a stack of open containers."""

from __future__ import annotations

import re
from bisect import bisect_left

from . import grammar as g
from .constructs import Constructs
from .tree import Joined, Node, Segment

LINE = re.compile(rb"([^\r\n]*)(\r\n|\n|\r|\Z)")


class Cursor:
    """A place in a line. Columns count tab stops from the line's own start; ``pad`` is what is left of a tab."""

    __slots__ = ("base", "col", "i", "line", "pad")

    def __init__(self, line: bytes, base: int):
        self.line, self.base, self.i, self.col, self.pad = line, base, 0, 0, 0

    def copy(self) -> Cursor:
        c = Cursor(self.line, self.base)
        c.i, c.col, c.pad = self.i, self.col, self.pad
        return c

    def indent(self) -> int:
        col, start = self.col + self.pad, self.col
        for c in self.line[self.i :]:
            if c == 0x20:
                col += 1
            elif c == 0x09:
                col += 4 - col % 4
            else:
                break
        return col - start

    def take(self, n: int) -> None:
        """Consume ``n`` columns of white space."""
        while n > 0:
            if self.pad:
                k = min(n, self.pad)
                self.pad -= k
            else:
                c = self.line[self.i]
                width = 1 if c == 0x20 else 4 - self.col % 4
                k = min(n, width)
                self.pad = width - k
                self.i += 1
            self.col += k
            n -= k

    def skip(self, n: int) -> None:
        """Consume up to ``n`` columns of white space."""
        self.take(min(n, self.indent()))

    def bump(self, n: int) -> None:
        self.i += n
        self.col += n

    def tail(self) -> bytes:
        return self.line[self.i :]

    def blank(self) -> bool:
        return not self.line[self.i :].strip(g.WS)

    @property
    def at(self) -> int:
        return self.base + self.i

    @property
    def end(self) -> int:
        return self.base + len(self.line)

    def segment(self) -> Segment:
        return self.at, self.end, self.pad

    def trimmed(self) -> tuple[int, int]:
        return self.at, self.base + len(self.line.rstrip(g.WS))

    def flow(self) -> Cursor | None:
        """Where a block may start on this line: at most three columns in, and no tab cut in two."""
        if self.indent() >= 4:
            return None
        c = self.copy()
        c.skip(3)
        return None if c.pad else c


class Open:
    """An open container and its node."""

    __slots__ = ("fence", "indent", "kind", "node")

    def __init__(self, kind: str, node: Node, indent: int = 0, fence: int = 0):
        self.kind, self.node, self.indent, self.fence = kind, node, indent, fence


class Leaf:
    """An open leaf: its kind, lines, and where it lies."""

    __slots__ = ("deep", "end", "extra", "indent", "kind", "lazy", "lines", "newline", "pending", "rows", "start")

    def __init__(self, kind: str, start: int, end: int, lines: list[Segment], extra=None, indent: int = 0):
        self.kind, self.start, self.end, self.lines, self.extra, self.indent = kind, start, end, lines, extra, indent
        self.lazy: set[int] = set()
        self.pending: list[Segment] = []
        self.rows: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
        self.deep = self.newline = False


class Blocks:
    """Parses the block structure; leaves keep their lines in ``segments['text']`` for the inline phase."""

    def __init__(self, source: bytes, constructs: Constructs):
        self.source, self.on = source, constructs
        self.root = Node("Root", 0, len(source))
        self.stack: list[Open] = []
        self.leaf: Leaf | None = None
        self.blanks: list[tuple[int, int]] = []
        self.loosening: list[tuple[int, int]] = []
        self.labels: set[str] = set()
        self.footnotes: set[str] = set()
        self.skip_to = -1
        self.liquid_dead = {b"%}": -1, b"}}": -1}

    # ---- driving

    def parse(self) -> Node:
        at, n = 0, len(self.source)
        while at < n:
            m = LINE.match(self.source, at)
            if at >= self.skip_to:
                self.line(Cursor(m[1], at))
            at = m.end()
        self.raw_html_ends(self.source[-1:] in (b"\n", b"\r"))
        self.close_to(0)
        self.finish(self.root)
        return self.root

    def line(self, cur: Cursor) -> None:
        matched = self.prefixes(cur)
        if matched is None:
            return
        whole = matched == len(self.stack)
        if whole and self.verbatim(cur):
            return
        if cur.blank():
            return self.blank_line(cur, matched, whole)
        if not whole and self.lazy_line(cur, matched):
            return
        if self.leaf and self.leaf.kind != "paragraph" and self.more(cur):
            return
        self.starts(cur)

    def prefixes(self, cur: Cursor, probe: bool = False) -> int | None:
        """How many open containers the line continues; None if it closed a directive (or would)."""
        for k, c in enumerate(self.stack):
            if c.kind == "Blockquote":
                mark = cur.copy()
                mark.skip(3)
                if mark.pad or mark.line[mark.i : mark.i + 1] != b">":
                    return k
                mark.bump(1)
                mark.skip(1)
                cur.i, cur.col, cur.pad = mark.i, mark.col, mark.pad
            elif c.kind in ("ListItem", "FootnoteDefinition"):
                if cur.blank():
                    if c.kind == "ListItem":
                        cur.skip(c.indent)
                elif cur.indent() >= c.indent:
                    cur.take(c.indent)
                else:
                    return k
            elif c.kind == "ContainerDirective":
                mark = cur.copy()
                mark.skip(3)
                tail = mark.tail()
                size = len(tail) - len(tail.lstrip(b":"))
                if not mark.pad and size >= c.fence and not tail[size:].strip(g.WS):
                    if not probe:
                        self.raw_html_ends(True)
                        self.close_to(k + 1)
                        c.node.spans["closing"] = (mark.at, cur.end)
                        c.node.end = cur.end
                        self.close_to(k)
                    return None
                cur.skip(c.indent)
        return len(self.stack)

    # ---- continuing leaves

    def verbatim(self, cur: Cursor) -> bool:
        leaf = self.leaf
        if not leaf:
            return False
        if leaf.kind == "fence":
            mark, (char, size, _) = cur.copy(), leaf.extra
            mark.skip(3)
            tail = mark.tail()
            run = len(tail) - len(tail.lstrip(char))
            leaf.end = cur.end
            if not mark.pad and run >= size and not tail[run:].strip(g.WS):
                self.close_leaf()
            else:
                cur.skip(leaf.indent)
                leaf.lines.append(cur.segment())
            return True
        if leaf.kind == "html" and leaf.extra <= 5:
            leaf.lines.append(cur.segment())
            leaf.end = cur.end
            if g.HTML_END[leaf.extra].search(cur.tail()):
                self.close_leaf()
            return True
        return False

    def blank_line(self, cur: Cursor, matched: int, whole: bool) -> None:
        in_quote = whole and bool(self.stack) and self.stack[-1].kind == "Blockquote"
        leaf = self.leaf
        if leaf and leaf.kind in ("paragraph", "html", "table"):
            self.close_leaf()
        elif leaf and leaf.kind == "indented":
            c = cur.copy()
            c.skip(4)
            leaf.pending.append(c.segment())
        if not whole:
            self.give_back(False)
            self.close_to(matched)
        for c in reversed(self.stack[:matched]):
            if c.kind == "Blockquote":
                c.node.end = max(c.node.end, cur.end)
                break
        blank = (cur.at, cur.end)
        self.blanks.append(blank)
        if not in_quote:
            self.loosening.append(blank)
        if not self.leaf and self.stack and self.stack[-1].kind == "ListItem" and not self.stack[-1].node.kids:
            self.close_to(len(self.stack) - 1)

    def lazy_line(self, cur: Cursor, matched: int) -> bool:
        c = cur.flow()
        start = self.probe(c.tail(), False) if c else None
        if start and start[0] == "liquid" and not self.liquid(c):
            start = None
        inside = any(o.kind == "ContainerDirective" for o in self.stack[matched:])
        leaf = self.leaf
        if leaf and leaf.kind == "paragraph" and not inside:
            if not start:
                leaf.lazy.add(len(leaf.lines))
                leaf.lines.append(cur.segment())
                return True
            if start == ("html", 7) and cur.end < len(self.source):
                self.close_leaf()  # the block opens beside the paragraph, inside the containers
                return False
        self.give_back(bool(start) and start[0] in ("quote", "item", "footnote"))
        self.close_to(matched)
        return False

    def give_back(self, opens_container: bool) -> None:
        """Who owns the line ending before containers close."""
        leaf = self.leaf
        if not leaf:
            return
        if opens_container:
            if leaf.kind == "html" and leaf.extra <= 5:
                leaf.newline = True
        elif leaf.kind == "fence" and leaf.lines and leaf.lines[-1][0] == leaf.lines[-1][1] and not leaf.lines[-1][2]:
            leaf.end = leaf.lines.pop()[0]

    def raw_html_ends(self, after_line: bool) -> None:
        leaf = self.leaf
        if after_line and leaf and leaf.kind == "html" and leaf.extra <= 5 and all(c.kind != "Blockquote" for c in self.stack):
            leaf.newline = True

    def more(self, cur: Cursor) -> bool:
        """Offer the line to an open leaf other than a paragraph; it closes if it refuses."""
        leaf = self.leaf
        if leaf.kind == "html":
            leaf.lines.append(cur.segment())
            leaf.end = cur.end
            return True
        if leaf.kind == "indented" and cur.indent() >= 4:
            cur.take(4)
            leaf.lines += [*leaf.pending, cur.segment()]
            leaf.pending = []
            leaf.end = cur.end
            return True
        if leaf.kind == "table":
            c = cur.flow()
            start = self.probe(c.tail(), False) if c else ("code",)
            tag = self.liquid(c) if start and start[0] == "liquid" else None
            if tag:
                self.close_leaf()
                self.put_liquid(tag)
                return True
            if not start or start[0] == "liquid":
                leaf.rows.append(((c.at, c.end), [(c.at + a, c.at + b) for a, b in g.row_cells(c.tail())]))
                leaf.end = c.end
                return True
        self.close_leaf()
        return False

    # ---- starting blocks

    def probe(self, tail: bytes, para_open: bool) -> tuple | None:
        """What kind of block a line starts, in order of precedence."""
        on, head = self.on, tail[:1]
        if head == b">":
            return ("quote",)
        if para_open and head in b"=-" and (m := g.SETEXT.match(tail)):
            return ("setext", 1 if m[1][:1] == b"=" else 2)
        if head in b"-_*" and g.THEMATIC.match(tail):
            return ("break",)
        if head == b"#" and (m := g.ATX.match(tail)):
            return ("atx", len(m[1]))
        if head in b"`~" and (m := g.FENCE.match(tail)):
            k = 1 if m[1] else 3
            return ("fence", m[k][:1], len(m[k]), m.start(k + 1))
        if on.html_flow and head == b"<" and (kind := g.html_start(tail, para_open)):
            return ("html", kind)
        if on.math_flow and head == b"$" and (m := g.MATH.match(tail)):
            return ("fence", b"$", len(m[1]), m.start(2))
        if on.liquid and tail[:2] in g.LIQUID_CLOSERS:
            return ("liquid",)
        if on.container_directive and head == b":" and (m := g.DIRECTIVE.match(tail)):
            c = tail[m.end() : m.end() + 4].decode(errors="ignore")[:1]
            if c.isalnum() or c in "_{[":
                return ("directive", len(m[1]))
        if on.gfm_footnote and head == b"[" and (label := g.footnote_label(tail, 0)) and tail[label[2] : label[2] + 1] == b":":
            return ("footnote", label)
        if m := g.BULLET.match(tail):
            return ("item", m[1], not tail[m.end() :].strip(g.WS))
        if on.gfm_table and para_open and (align := g.alignments(tail)):
            return ("delimiter", align)
        return None

    def starts(self, cur: Cursor) -> None:
        while not cur.blank():
            column, indent = cur.col, cur.indent()
            para = self.leaf is not None and self.leaf.kind == "paragraph"
            if indent >= 4:
                if para or not self.on.code_indented:
                    self.text(cur, True)
                else:
                    cur.take(4)
                    self.close_list()
                    self.leaf = Leaf("indented", cur.at, cur.end, [cur.segment()])
                return
            whole = cur.copy()
            cur.skip(3)
            if cur.pad:
                return self.text(cur, False)
            start = self.probe(cur.tail(), para)
            kind = start[0] if start else ""
            if kind == "quote":
                self.close_leaf_and_list()
                self.push("Blockquote", Node("Blockquote", cur.at, cur.at + 1))
                cur.bump(1)
                cur.skip(1)
                continue
            if kind == "item" and (not para or not start[2] and (len(start[1]) == 1 or int(start[1][:-1]) == 1)):
                self.item(cur, start[1], start[2], column)
                continue
            if kind == "footnote":
                self.close_leaf_and_list()
                a, b, end = start[1]
                node = Node("FootnoteDefinition", cur.at, cur.at)
                node.spans["label"] = (cur.at + a, cur.at + b)
                self.footnotes.add(g.normalize_label(cur.tail()[a:b].decode(errors="replace")))
                self.push("FootnoteDefinition", node, 4)
                cur.bump(end + 1)
                cur.skip(1 << 30)
                continue
            return self.leaf_start(start, kind, cur, whole, indent, para)

    def leaf_start(self, start, kind: str, cur: Cursor, whole: Cursor, indent: int, para: bool) -> None:
        if kind == "setext":
            if not self.setext(cur, start[1]):
                if g.THEMATIC.match(cur.tail()):
                    self.close_leaf_and_list()
                    self.put(Node("ThematicBreak", *cur.trimmed()))
                else:
                    self.text(cur, False)
        elif kind == "break":
            self.close_leaf_and_list()
            self.put(Node("ThematicBreak", *cur.trimmed()))
        elif kind == "atx":
            self.close_leaf_and_list()
            node = Node("Heading", *cur.trimmed(), level=start[1], kind="atx")
            raw = cur.tail()[start[1] :]
            m = g.ATX_TAIL.search(raw.strip(g.WS))
            lead = len(raw) - len(raw.lstrip(g.WS))
            size = m.start() if m else len(raw.strip(g.WS))
            at = cur.at + start[1] + lead
            node.segments["text"] = [(at, at + size, 0)] if size else []
            self.put(node)
        elif kind == "fence":
            self.close_leaf_and_list()
            raw = cur.tail()[start[3] :]
            lead = len(raw) - len(raw.lstrip(g.WS))
            at = cur.at + start[3] + lead
            info = (at, at + len(raw.strip(g.WS)))
            self.leaf = Leaf("fence", cur.at, cur.end, [], (start[1], start[2], info), indent)
        elif kind == "directive":
            self.close_leaf_and_list()
            node = Node("ContainerDirective", cur.at, cur.end)
            node.spans["opening"] = (cur.at, cur.end)
            self.push("ContainerDirective", node, indent, start[1])
        elif kind == "liquid" and (tag := self.liquid(cur)):
            self.close_leaf()
            self.put_liquid(tag)
        elif kind == "html":
            self.close_leaf_and_list()
            self.leaf = Leaf("html", whole.at, whole.end, [whole.segment()], start[1])
            if start[1] <= 5 and g.HTML_END[start[1]].search(whole.tail()):
                self.close_leaf()
        elif kind == "delimiter" and self.table(start[1], whole):
            pass
        else:
            self.text(whole if para else cur, False)

    def text(self, cur: Cursor, deep: bool) -> None:
        if self.leaf and self.leaf.kind == "paragraph":
            self.leaf.lines.append(cur.segment())
        else:
            self.close_list()
            cur.skip(1 << 30)
            self.leaf = Leaf("paragraph", cur.at, cur.end, [cur.segment()])
        self.leaf.deep = deep

    def item(self, cur: Cursor, marker: bytes, empty: bool, column: int) -> None:
        self.close_leaf()
        ordered, char = len(marker) > 1, marker[-1:].decode()
        top = self.stack[-1] if self.stack else None
        if not (top and top.kind == "List" and top.node.props["ordered"] == ordered and top.node.props["marker"] == char):
            self.close_list()
            self.push("List", Node("List", cur.at, cur.at, ordered=ordered, marker=char))
        node = Node("ListItem", cur.at, cur.at + len(marker), padding=0, spread=False)
        node.spans["marker"] = (cur.at, cur.at + len(marker))
        cur.bump(len(marker))
        space = cur.indent()
        if empty:
            content = cur.col - column + 1
        else:
            node.props["padding"] = space if 1 <= space <= 4 else 1
            cur.take(node.props["padding"])
            content = cur.col - column
        self.push("ListItem", node, content)

    def setext(self, cur: Cursor, level: int) -> bool:
        leaf, self.leaf = self.leaf, None
        lines, lazy = self.definitions(leaf)
        if not lines:
            return False
        a, b = cur.trimmed()
        node = Node("Heading", lines[0][0], b, level=level, kind="setext")
        node.spans["underline"] = (a, b)
        node.segments["text"], node.lazy = lines, lazy or ()
        self.put(node)
        return True

    def table(self, align: list[str], row: Cursor) -> bool:
        leaf = self.leaf
        last = len(leaf.lines) - 1
        if last in leaf.lazy or leaf.deep:
            return False
        a, b, pad = header = leaf.lines[last]
        cells = g.row_cells(self.source[a:b])
        if len(cells) != len(align):
            return False
        as_html = self.probe(self.source[a:b].lstrip(g.WS), False) == ("html", 7)
        leaf.lines.pop()
        self.close_leaf_and_list()
        if as_html:
            self.leaf = Leaf("html", a, row.end, [header, row.segment()], 7)
        else:
            self.leaf = Leaf("table", a, row.end, [], align)
            self.leaf.rows.append(((a, b), [(a + x, a + y) for x, y in cells]))
        return True

    def liquid(self, cur: Cursor) -> tuple | None:
        """(pieces, end of the last line) of a template tag that fills its lines."""
        closer, start = g.LIQUID_CLOSERS[cur.tail()[:2]], cur.at
        if start + 2 <= self.liquid_dead[closer]:
            return None
        pieces, skip = [], 2
        while True:
            tail = cur.tail()
            found = tail.find(closer, skip)
            if found >= 0:
                stop = cur.at + found + 2
                if tail[found + 2 :].strip(g.WS):
                    self.liquid_dead[closer] = stop - 2
                    return None
                return [*pieces, (cur.at, stop, cur.pad)], stop, cur.end
            pieces.append(cur.segment())
            ending = LINE.match(self.source, cur.end).end()
            if ending >= len(self.source):
                self.liquid_dead[closer] = len(self.source) + 2
                return None
            cur, skip = Cursor(LINE.match(self.source, ending)[1], ending), 0
            if self.prefixes(cur, probe=True) != len(self.stack):
                return None
            c = cur.flow()
            start = self.probe(c.tail(), False) if c else None
            if start and (start[0] in ("quote", "footnote") or start[0] == "item" and not start[2] and (len(start[1]) == 1 or int(start[1][:-1]) == 1)):
                return None

    def put_liquid(self, tag: tuple) -> None:
        self.close_list()
        pieces, end, self.skip_to = tag
        node = Node("Liquid", pieces[0][0], end)
        node.segments["pieces"] = pieces
        self.put(node)

    # ---- closing

    def push(self, kind: str, node: Node, indent: int = 0, fence: int = 0) -> None:
        self.stack.append(Open(kind, node, indent, fence))

    def put(self, node: Node) -> None:
        """Attach a finished block to the innermost container; a list only takes items."""
        while self.stack and self.stack[-1].kind == "List" and node.type != "ListItem":
            self.pop()
        parent = self.stack[-1].node if self.stack else self.root
        parent.kids.append(node)
        if parent is not self.root:
            parent.end = node.end if parent.type == "List" else max(parent.end, node.end)

    def pop(self) -> None:
        self.put(self.stack.pop().node)

    def close_to(self, keep: int) -> None:
        self.close_leaf()
        while len(self.stack) > keep:
            self.pop()

    def close_list(self) -> None:
        if self.stack and self.stack[-1].kind == "List":
            self.pop()

    def close_leaf_and_list(self) -> None:
        self.close_leaf()
        self.close_list()

    def close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if not leaf:
            return
        if leaf.kind == "paragraph":
            lines, lazy = self.definitions(leaf)
            if lines:
                node = Node("Paragraph", lines[0][0], lines[-1][1])
                node.segments["text"], node.lazy = lines, lazy or ()
                self.put(node)
            return
        if leaf.kind == "indented":
            node = Node("CodeBlock", leaf.start, leaf.end, kind="indented")
            node.segments["lines"] = leaf.lines
        elif leaf.kind == "html":
            node = Node("HtmlBlock", leaf.start, leaf.end, html=leaf.extra, newline=leaf.newline)
            node.segments["lines"] = leaf.lines
        elif leaf.kind == "table":
            node = Node("Table", leaf.start, leaf.end, align=leaf.extra)
            for (a, b), cells in leaf.rows:
                row = Node("TableRow", a, b)
                node.kids.append(row)
                for x, y in cells:
                    cell = Node("TableCell", x, y)
                    cell.segments["text"] = [(x, y, 0)] if y > x else []
                    row.kids.append(cell)
        else:
            char, _, (a, b) = leaf.extra
            raw = self.source[a:b]
            if char == b"$":
                node = Node("MathBlock", leaf.start, leaf.end)
                if raw:
                    node.spans["meta"] = (a, b)
            else:
                node = Node("CodeBlock", leaf.start, leaf.end, kind="fenced", fence=char.decode())
                if raw:
                    lang = len(re.match(rb"[^ \t]*", raw)[0])
                    node.spans["lang"] = (a, a + lang)
                    rest = raw[lang:].lstrip(g.WS)
                    if rest:
                        node.spans["meta"] = (b - len(rest), b)
            node.segments["lines"] = leaf.lines
        self.put(node)

    def definitions(self, leaf: Leaf) -> tuple[list[Segment], list[tuple[int, int]]]:
        """A paragraph's lines without the definitions it starts with, which are put; and its lazy lines."""
        lines, first = leaf.lines, 0
        if lines and self.source[lines[0][0] : lines[0][1]].startswith(b"["):
            joined = Joined(self.source, lines)
            at, t = 0, joined.text
            while at < len(t) and (found := self.definition(joined, at)):
                at = found
            first = len(lines) if at >= len(t) else joined.line(at)
        rest = lines[first:]
        if first and rest:
            a, b, _ = rest[0]
            rest[0] = (a + len(self.source[a:b]) - len(self.source[a:b].lstrip(g.WS)), b, 0)
        if rest:
            a, b, pad = rest[-1]
            rest[-1] = (a, a + len(self.source[a:b].rstrip(g.WS)), pad)
        lazy = [rest[k - first][:2] for k in sorted(leaf.lazy) if k >= first]
        return rest, lazy

    def definition(self, joined: Joined, at: int) -> int | None:
        """Put the definition at a line start; past its last line ending."""
        t = joined.text
        start = g.SPACES.match(t, at).end()
        end = g.label_end(t, start) if t[start : start + 1] == b"[" else None
        if not end or t[end : end + 1] != b":":
            return None
        dest = g.SPACES_LINE.match(t, end + 1).end()
        found = g.destination(t, dest)
        if not found or found[0] == dest:
            return None
        stop, angle = found
        line_end = re.compile(rb"[ \t]*(?:\n|\Z)")
        node = Node("Definition", *joined.span(start, stop), angle=angle)
        title = g.SPACES_LINE.match(t, stop).end()
        title_end = g.title(t, title) if title > stop else None
        after = line_end.match(t, title_end) if title_end else None
        if after:
            node.segments["title"] = joined.pieces(title, title_end)
            node.end = joined.place(title_end)
        else:
            after = line_end.match(t, stop)
            if not after:
                return None
        node.segments["label"] = joined.pieces(start + 1, end - 1)
        node.spans["dest"] = joined.span(dest, stop)
        self.labels.add(g.normalize_label(t[start + 1 : end - 1].decode(errors="replace")))
        self.put(node)
        return after.end()

    # ---- lists, once all is known

    def gap(self, a: int, b: int) -> bool:
        """Whether a loosening blank line lies between two places."""
        k = bisect_left(self.loosening, (a, -1))
        return k < len(self.loosening) and self.loosening[k][0] < b and self.loosening[k][1] <= b

    def finish(self, root: Node) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            if node.type == "ListItem":
                if self.on.gfm_task_list_item:
                    self.checkbox(node)
                node.props["spread"] = any(self.gap(x.end, y.start) for x, y in zip(node.kids, node.kids[1:], strict=False))
            todo += node.kids
        todo = [root]
        while todo:
            node = todo.pop()
            if node.type == "List":
                loose = any(self.gap(x.end, y.start) for x, y in zip(node.kids, node.kids[1:], strict=False))
                node.props["tight"] = not loose and not any(k.props["spread"] for k in node.kids)
            todo += node.kids

    def checkbox(self, item: Node) -> None:
        k = 0
        while k < len(item.kids) and item.kids[k].type == "Definition":
            if k + 1 >= len(item.kids) or self.gap(item.kids[k].end, item.kids[k + 1].start):
                return
            k += 1
        if k >= len(item.kids) or item.kids[k].type != "Paragraph":
            return
        para = item.kids[k]
        a, b, pad = para.segments["text"][0]
        raw = self.source[a:b]
        m = re.match(rb"\[([ \txX])\]([ \t]*)", raw)
        if not m or len(raw) > 3 and not m[2]:
            return
        rest = raw[m.end() :]
        if not rest and len(para.segments["text"]) == 1:
            return
        item.spans["checkbox"] = (a, a + 3)
        item.props["checked"] = m[1] in b"xX"
        skip = m.end() if rest else 3
        para.segments["text"][0] = (a + skip, b, pad)
        para.start = a + skip
