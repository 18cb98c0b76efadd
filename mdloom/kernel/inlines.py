"""Inline structure of one leaf: a scan that jumps between special bytes, then delimiter pairs, then nesting."""

from __future__ import annotations

import re

from . import grammar as g
from .constructs import Constructs
from .tree import Joined, Node, Segment

MARKS = rb"[\n\\`$\{<_*~\[!\]]"
# Where an address may start: a scheme or www. that no letter precedes, or the run of characters before an @.
WEB = rb"|(?<![A-Za-z])(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)"
MAIL = rb"|(?<![A-Za-z0-9+\-._/])[A-Za-z0-9+\-.][A-Za-z0-9+\-._]*@"
SPECIAL = {(web, mail): re.compile(MARKS + WEB * web + MAIL * mail) for web in (False, True) for mail in (False, True)}
WEB_HINT = re.compile(rb"://|[wW]\.")
PLAIN = re.compile(rb"[^\n\\`$\{<_*~\[!\]@:w]*\Z", re.I)
EMAIL = re.compile(rb"[A-Za-z0-9+\-._]+@((?:[A-Za-z0-9_\-]|\.(?=[A-Za-z0-9]))+)")
BACKTICKS, DOLLARS = re.compile(rb"`+"), re.compile(rb"\$+")
HTTP = re.compile(rb"https?://", re.I)
WWW = re.compile(rb"www\.(?=.)", re.I | re.S)
TRAILING = frozenset("!\"'),*.:;?_~")
PATH_STOPS = frozenset("!\"&')*,.:;<?]_~")


def char_before(t: bytes, i: int) -> str:
    k = i
    while k > 0 and i - k < 4:
        k -= 1
        if t[k] & 0xC0 != 0x80:
            return t[k:i].decode(errors="replace")[-1:]
    return ""


def char_at(t: bytes, i: int) -> str:
    return t[i : i + 4].decode(errors="ignore")[:1] if i < len(t) and t[i] >= 0x80 else chr(t[i]) if i < len(t) else ""


def trailing(t: bytes, i: int) -> bool:
    """Whether only punctuation lies between here and the end of an address."""
    n = len(t)
    while i < n:
        c = char_at(t, i)
        if c == "<" or c in g.WHITE:
            return True
        if c in TRAILING:
            i += 1
        elif c == "&":
            m = re.compile(rb"&[A-Za-z]+;").match(t, i)
            if not m:
                return False
            i = m.end()
        elif c == "]":
            i += 1
            c = char_at(t, i)
            if c in ("", "(", "[") or c in g.WHITE:
                return True
        else:
            return False
    return True


def address(t: bytes, i: int) -> int | None:
    """The end of a bare address whose domain starts at ``i``."""
    n, seen, here, before = len(t), False, False, False
    while i < n:
        c = char_at(t, i)
        if c in "._":
            if trailing(t, i):
                break
            here, before = (True, before) if c == "_" else (False, here)
            i += 1
        elif c in g.WHITE or c != "-" and g.is_punctuation(c):
            break
        else:
            seen = True
            i += len(c.encode())
    if here or before or not seen:
        return None
    opened = closed = 0
    while i < n:
        c = char_at(t, i)
        if c == "(":
            opened += 1
        elif c == ")" and closed < opened:
            closed += 1
        elif c in PATH_STOPS:
            if trailing(t, i):
                break
            closed += c == ")"
        elif c in g.WHITE:
            break
        i += len(c.encode())
    return i


def email_end(t: bytes, at: int, before: str) -> int | None:
    if before and (before == "/" or before.isascii() and (before.isalnum() or before in "+-._")):
        return None
    m = EMAIL.match(t, at)
    if not m or b"." not in m[1] or not m[1][-1:].isalpha() or not m[1].strip(b"."):
        return None
    return m.end()


def literal_end(t: bytes, at: int, before: str, at_ahead: bool) -> int | None:
    """The end of an address written out at ``at``: mail, http(s) or www."""
    if at_ahead and (end := email_end(t, at, before)):
        return end
    head = t[at : at + 1].lower()
    if head == b"h" and not (before.isascii() and before.isalpha()) and (m := HTTP.match(t, at)):
        c = char_at(t, m.end())
        if not c or c in g.WHITE or ord(c) < 32 or ord(c) == 127 or g.is_punctuation(c):
            return None
        return address(t, m.end())
    if head == b"w" and (not before or before in "(*_[]~ \t\n") and (m := WWW.match(t, at)):
        return address(t, m.end())
    return None


def literal_kind(text: str) -> str:
    raw = text.encode()
    if HTTP.match(raw):
        return "Http"
    return "Email" if b"@" in raw and email_end(raw, 0, "") == len(raw) else "Www"


def classify(marker: str, before: str, after: str, tilde: bool = True) -> tuple[bool, bool]:
    """(can open, can close) of a delimiter run between two characters."""

    def group(c: str) -> int:
        return 1 if not c or c in g.WHITE else 2 if g.is_punctuation(c) else 0

    def beside(c: str) -> bool:
        return marker != "~" and (c in ("*", "_") or tilde and c == "~")

    b, a = group(before), group(after)
    opens = a == 0 or a == 2 and b != 0 or beside(after)
    closes = b == 0 or b == 2 and a != 0 or beside(before)
    if marker == "_":
        return opens and (b != 0 or not closes), closes and (a != 0 or not opens)
    return opens, closes


class Run:
    """A delimiter run; pairs take characters from its inner ends."""

    __slots__ = ("closes", "left", "marker", "opens", "start", "stop")

    def __init__(self, marker: str, start: int, stop: int, opens: bool, closes: bool):
        self.marker, self.start, self.stop, self.opens, self.closes = marker, start, stop, opens, closes
        self.left = stop - start


def make_run(marker: str, length: int, before: str, after: str, constructs: Constructs, at: int = 0) -> tuple[Run, bool]:
    least = 1 if constructs.gfm_strikethrough_single_tilde else 2
    valid = marker != "~" or least <= length <= 2
    opens, closes = classify(marker, before, after, constructs.gfm_strikethrough) if valid else (False, False)
    return Run(marker, at, at + length, opens, closes), valid


Pair = tuple[int, int, str, int]  # start, end, marker, characters used


def match_runs(runs: list[Run], tilde_first: bool, out: list[Pair]) -> None:
    """Pair delimiter runs: one family at a time, and inside a pair the other family first settles on its own."""
    todo = [(runs, tilde_first)]
    while todo:
        runs, tilde_first = todo.pop()
        for tilde in (tilde_first, not tilde_first):
            if any(r.left and r.closes and (r.marker == "~") == tilde for r in runs):
                _family(runs, tilde, out, todo)


def _family(runs: list[Run], tilde: bool, out: list[Pair], todo: list) -> None:
    floor: dict[tuple, int] = {}
    k = 0
    while k < len(runs):
        c = runs[k]
        if (c.marker == "~") != tilde or not c.closes or not c.left:
            k += 1
            continue
        kind = (c.marker, c.left if tilde else c.left % 3, c.opens and not tilde)
        j = k - 1
        while j >= floor.get(kind, 0):
            o = runs[j]
            if o.marker == c.marker and o.opens and o.left:
                if tilde:
                    if o.left == c.left:
                        break
                elif not ((o.closes or c.opens) and c.left % 3 and (o.left + c.left) % 3 == 0):
                    break
            j -= 1
        else:
            floor[kind] = k
            if not c.opens:
                c.left = 0
            k += 1
            continue
        o, between = runs[j], runs[j + 1 : k]
        used = c.left if tilde else 2 if o.left >= 2 and c.left >= 2 else 1
        if any(r.left and (r.marker == "~") != tilde for r in between):
            inner = []
            for r in between:
                if (r.marker == "~") == tilde:
                    r.left = 0
            inner = [r for r in between if r.left]
            match_runs(inner, True, out)
        for r in between:
            r.left = 0
        out.append((o.stop - used, c.start + used, o.marker, used))
        o.stop -= used
        c.start += used
        o.left -= used
        c.left -= used
        if not tilde and o.left:
            for other in floor:
                if other[0] == o.marker:
                    floor[other] = min(floor[other], j)
        if not c.left:
            k += 1


def pairs(runs: list[tuple[str, int, str, str]], in_link: bool = False, constructs: Constructs = Constructs()) -> list[tuple[int, int, bool]]:
    """(opener, closer, strong) for delimiter runs given as (marker, length, character before, after)."""
    made, at, first = [], 0, None
    for marker, length, before, after in runs:
        run, valid = make_run(marker, length, before, after, constructs, at)
        if valid and first is None:
            first = marker == "~"
        made.append(run)
        at += length + 1
    starts, out = [r.start for r in made], []
    match_runs([r for r in made if r.opens or r.closes], in_link or bool(first), out)
    from bisect import bisect_right

    return sorted((bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, m != "~" and n == 2) for a, b, m, n in out)


class Bracket:
    __slots__ = ("active", "at", "image", "item", "runs")

    def __init__(self, at: int, image: bool, item: int, runs: int):
        self.at, self.image, self.item, self.runs, self.active = at, image, item, runs, True

    @property
    def inside(self) -> int:
        return self.at + 1 + self.image


class Inlines:
    """Items are (start, end, node) in the joined text; text items have no node and are cut by pairs later."""

    def __init__(self, source: bytes, lines: list[Segment], constructs: Constructs, labels: set[str], footnotes: set[str]):
        self.source, self.on, self.labels, self.footnotes = source, constructs, labels, footnotes
        self.joined = Joined(source, lines)
        self.t = self.joined.text
        self.items: list[tuple[int, int, Node | None]] = []
        self.runs: list[Run] = []
        self.brackets: list[Bracket] = []
        self.found: list[Pair] = []
        self.mark = 0  # start of text not yet an item
        self.tilde_first: bool | None = None

    def nodes(self) -> list[Node]:
        t = self.t
        if PLAIN.match(t):
            end = len(t.rstrip(g.WS))
            return [self.text_node(0, end)] if end else []
        self.scan()
        match_runs(self.runs, bool(self.tilde_first), self.found)
        return self.nest(self.items, self.found)

    # ---- scanning

    def text(self, upto: int) -> None:
        if self.mark < upto:
            self.items.append((self.mark, upto, None))
        self.mark = max(self.mark, upto)

    def add(self, node_type: str, a: int, b: int, pieces: tuple[int, int] | None = None, **props) -> Node:
        self.text(a)
        node = Node(node_type, *self.joined.span(a, b), **props)
        if pieces:
            node.segments["pieces"] = self.joined.pieces(*pieces)
        self.items.append((a, b, node))
        self.mark = b
        return node

    def scan(self) -> None:
        t, on, n, i = self.t, self.on, len(self.t), 0
        last_at = t.rfind(b"@")
        dead: dict[bytes, bool] = {}
        wiki_dead = 0
        literals = on.gfm_autolink_literal
        special = SPECIAL[bool(literals and WEB_HINT.search(t)), literals and last_at >= 0]
        while True:
            m = special.search(t, i)
            if not m:
                break
            i = m.start()
            c = t[i : i + 1]
            if c == b"\n":
                i = self.line_ending(i)
            elif c == b"\\":
                if t[i + 1 : i + 2] == b"\n":
                    self.add("HardBreak", i, i + 1, kind="backslash")
                    i = self.mark = g.SPACES.match(t, i + 2).end()
                else:
                    i += 2 if g.ESCAPE.match(t, i) else 1
            elif c == b"`":
                run = len(BACKTICKS.match(t, i)[0])
                close = self.closing(i + run, b"`", run)
                if close is None:
                    i += run
                    continue
                a, b = i + run, close
                inner = t[a:b]
                if len(inner) >= 2 and inner[:1] in b" \n" and inner[-1:] in b" \n" and inner.strip(b" \n"):
                    a, b = a + 1, b - 1
                self.add("CodeSpan", i, close + run, (a, b))
                i = close + run
            elif c == b"$" and on.math_text:
                run = len(DOLLARS.match(t, i)[0])
                close = self.closing(i + run, b"$", run) if run >= (1 if on.math_text_single_dollar else 2) else None
                if close is None:
                    i += run
                    continue
                self.add("MathSpan", i, close + run, (i, close + run))
                i = close + run
            elif c == b"{" and on.liquid and t[i : i + 2] in g.LIQUID_CLOSERS:
                closer = g.LIQUID_CLOSERS[t[i : i + 2]]
                end = -1 if dead.get(closer) else t.find(closer, i + 2)
                if end < 0:
                    dead[closer] = True
                    i += 1
                    continue
                self.add("Liquid", i, end + 2, (i, end + 2))
                i = end + 2
            elif c == b"<":
                i = self.angle(i)
            elif c in (b"*", b"_") or c == b"~" and on.gfm_strikethrough:
                if c == b"_" and literals and not self.brackets and last_at > i and (end := email_end(t, i, char_before(t, i))):
                    self.add("AutolinkLiteral", i, end)
                    i = end
                else:
                    i = self.delimiters(i, c)
            elif c == b"[":
                label = self.footnote(i)
                if label:
                    self.call(label, i)
                    i = self.mark
                    continue
                if on.wiki_link and t[i + 1 : i + 2] == b"[" and i + 2 >= wiki_dead:
                    w = re.compile(rb"\[\[([^\]\n]*)\]\]").match(t, i)
                    if w and w[1].strip(g.WS):
                        self.add("WikiLink", i, w.end())
                        i = w.end()
                        continue
                    wiki_dead = re.compile(rb"[^\]\n]*").match(t, i + 2).end()
                i = self.open(i, False)
            elif c == b"!":
                i = self.open(i, True) if t[i + 1 : i + 2] == b"[" else i + 1
            elif c == b"]":
                i = self.close(i)
            elif literals and not self.brackets and c not in b"~{$" and (end := literal_end(t, i, char_before(t, i), last_at > i)):
                self.add("AutolinkLiteral", i, end)
                i = end
            else:
                i += 1
        self.text(len(t.rstrip(g.WS)))

    def closing(self, at: int, mark: bytes, size: int) -> int | None:
        for m in re.compile(re.escape(mark) + b"+").finditer(self.t, at):
            if m.end() - m.start() == size:
                return m.start()
        return None

    def line_ending(self, i: int) -> int:
        t = self.t
        raw = t[self.mark : i]
        trail = len(raw) - len(raw.rstrip(g.WS))
        self.text(i - trail)
        if trail >= 2 and b"\t" not in t[i - trail : i]:
            self.add("HardBreak", i - trail, i, kind="spaces")
        else:
            at = g.SPACES.match(t, i + 1).end()
            node = Node("SoftBreak", 0, 0)
            node.start = node.end = self.joined.place(i + 1)
            self.items.append((i, i + 1, node))
            self.mark = at
        self.mark = g.SPACES.match(t, i + 1).end()
        return self.mark

    def angle(self, i: int) -> int:
        t = self.t
        if self.on.autolink:
            for pattern, email in ((g.AUTOLINK, False), (g.EMAIL_AUTOLINK, True)):
                if m := pattern.match(t, i):
                    self.add("Autolink", i, m.end(), email=email)
                    return m.end()
        if self.on.html_text and (end := self.html(i)):
            self.add("HtmlInline", i, end, (i, end))
            return end
        return i + 1

    def html(self, i: int) -> int | None:
        t = self.t
        for head, closer, skip in ((b"<!--", b"-->", 4), (b"<![CDATA[", b"]]>", 9), (b"<?", b"?>", 2)):
            if t.startswith(head, i):
                if head == b"<!--" and (m := re.compile(rb"-?>").match(t, i + 4)):
                    return m.end()
                at = t.find(closer, i + skip)
                return at + len(closer) if at >= 0 else None
        if t.startswith(b"<!", i):
            at = t.find(b">", i) if t[i + 2 : i + 3].isalpha() else -1
            return at + 1 if at >= 0 else None
        m = g.INLINE_TAG.match(t, i)
        return m.end() if m else None

    def delimiters(self, i: int, c: bytes) -> int:
        t = self.t
        end = i
        while t[end : end + 1] == c:
            end += 1
        run, valid = make_run(c.decode(), end - i, char_before(t, i), char_at(t, end), self.on, i)
        self.text(i)
        self.items.append((i, end, None))
        self.mark = end
        if valid and self.tilde_first is None:
            self.tilde_first = c == b"~"
        if run.opens or run.closes:
            self.runs.append(run)
        return end

    # ---- brackets

    def footnote(self, i: int) -> tuple[int, int, int] | None:
        if not self.on.gfm_footnote or not self.footnotes:
            return None
        label = g.footnote_label(self.t, i)
        return label if label and g.normalize_label(self.t[label[0] : label[1]].decode(errors="replace")) in self.footnotes else None

    def call(self, label: tuple[int, int, int], i: int) -> None:
        node = self.add("FootnoteReference", i, label[2])
        node.spans["label"] = self.joined.span(label[0], label[1])

    def open(self, i: int, image: bool) -> int:
        self.text(i)
        self.brackets.append(Bracket(i, image, len(self.items), len(self.runs)))
        end = i + 1 + image
        self.items.append((i, end, None))
        self.mark = end
        return end

    def defined(self, a: int, b: int) -> bool:
        return bool(self.labels) and g.normalize_label(self.t[a:b].decode(errors="replace")) in self.labels

    def close(self, p: int) -> int:
        t = self.t
        self.text(p)
        b = self.brackets.pop() if self.brackets else None
        if b and b.active:
            after = t[p + 1 : p + 2]
            if after == b"(" and (suffix := self.suffix(p + 1)):
                dest, angle, title, end = suffix
                node = self.link(b, p, end, kind="inline", angle=angle)
                node.spans["dest"] = self.joined.span(*dest)
                if title:
                    node.segments["title"] = self.joined.pieces(*title)
                return end
            label, end, kind = (b.inside, p), p + 1, "shortcut"
            if after == b"[":
                if t[p + 2 : p + 3] == b"]":
                    end, kind = p + 3, "collapsed"
                else:
                    end, kind = g.label_end(t, p + 1), "full"
                    label = (p + 2, end - 1) if end else None
            if label and self.defined(*label):
                node = self.link(b, p, end, kind=kind)
                node.segments["label"] = self.joined.pieces(*label)
                return end
            if b.image and after != b"[" and (call := self.footnote(b.at + 1)) and call[2] == p + 1:
                del self.items[b.item :], self.runs[b.runs :]
                self.items.append((b.at, b.at + 1, None))
                self.mark = b.at + 1
                self.call(call, b.at + 1)
                return self.mark
        self.items.append((p, p + 1, None))
        self.mark = p + 1
        return p + 1

    def suffix(self, at: int):
        t = self.t
        p = g.SPACES_LINES.match(t, at + 1).end()
        found = g.destination(t, p)
        if not found:
            return None
        dest, angle, title = (p, found[0]), found[1], None
        q = g.SPACES_LINES.match(t, found[0]).end()
        if q > found[0] and (end := g.title(t, q)):
            title = (q, end)
            q = g.SPACES_LINES.match(t, end).end()
        return (dest, angle, title, q + 1) if t[q : q + 1] == b")" else None

    def link(self, b: Bracket, p: int, end: int, **props) -> Node:
        found: list[Pair] = []
        match_runs(self.runs[b.runs :], True, found)
        node = Node("Image" if b.image else "Link", *self.joined.span(b.at, end), **props)
        node.kids = self.nest(self.items[b.item + 1 :], found)
        if b.image:
            node.segments["alt"] = self.joined.pieces(b.inside, p)
        else:
            for other in self.brackets:
                other.active = other.active and other.image
        del self.items[b.item :], self.runs[b.runs :]
        self.items.append((b.at, end, node))
        self.mark = end
        return node

    # ---- nesting

    def text_node(self, a: int, b: int) -> Node:
        node = Node("Text", *self.joined.span(a, b))
        raw = self.t[a:b]
        if not raw.isascii() and g.CJK.search(raw.decode(errors="replace")):
            node.props["cjk"] = True
        return node

    def nest(self, items, found: list[Pair]) -> list[Node]:
        """Items and pairs as a tree: pairs open and close between the pieces of text that they cut."""
        opens, closes = {}, {}
        for a, b, marker, used in sorted(found, key=lambda x: (x[0], -x[1])):
            opens.setdefault(a, []).append((a, b, marker, used))
            closes.setdefault(b, 0)
            closes[b] += 1
        cuts = sorted({x for a, b, _, used in found for x in (a, a + used, b - used, b)})
        root: list[Node] = []
        stack: list[tuple[Node, int]] = []
        out, run_a, run_b = root, -1, -1
        hidden = {x for a, b, _, used in found for x in (*range(a, a + used), *range(b - used, b))}

        def flush():
            nonlocal run_a
            if run_a >= 0 and run_b > run_a:
                out.append(self.text_node(run_a, run_b))
            run_a = -1

        from bisect import bisect_right

        for a, b, node in items:
            at = a
            while True:
                while stack and stack[-1][1] <= at:
                    flush()
                    stack.pop()
                    out = stack[-1][0].kids if stack else root
                for pair in opens.pop(at, ()):
                    flush()
                    _, end, marker, used = pair
                    kind = "Strikethrough" if marker == "~" else "Strong" if used == 2 else "Emphasis"
                    new = Node(kind, *self.joined.span(pair[0], end), **({"tildes": used} if marker == "~" else {"marker": marker}))
                    out.append(new)
                    stack.append((new, end))
                    out = new.kids
                if node is not None:
                    flush()
                    out.append(node)
                    break
                if at >= b:
                    break
                k = bisect_right(cuts, at)
                to = min(b, cuts[k]) if k < len(cuts) else b
                if at not in hidden:
                    if run_a >= 0 and run_b == at:
                        run_b = to
                    else:
                        flush()
                        run_a, run_b = at, to
                at = to
        flush()
        return root
