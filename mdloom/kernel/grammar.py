"""Lexical grammar over bytes: compiled patterns and a few small scanners."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import html5

WS = b" \t"
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ESCAPE = re.compile(rb"\\[!-/:-@\[-`{-~]")

# HTML element names that open a block of type 6, and of type 1.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
RAW_TAGS = "pre script style textarea".split()

ATTRIBUTE = rb"[A-Za-z_:][A-Za-z0-9_:.\-]*(?:%(ws)s*=%(ws)s*(?:\"[^\"]*\"|'[^']*'|[^ \t\n\"'=<>`]+))?"
OPEN_TAG = rb"<[A-Za-z][A-Za-z0-9\-]*(?:%(ws)s+" + ATTRIBUTE + rb")*%(ws)s*/?>"
CLOSE_TAG = rb"</[A-Za-z][A-Za-z0-9\-]*%(ws)s*>"


def _tags(ws: bytes) -> bytes:
    return rb"(?:" + OPEN_TAG % {b"ws": ws} + rb"|" + CLOSE_TAG % {b"ws": ws} + rb")"


THEMATIC = re.compile(rb"(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})\Z")
SETEXT = re.compile(rb"(=+|-+)[ \t]*\Z")
ATX = re.compile(rb"(#{1,6})(?:[ \t]|\Z)")
ATX_TAIL = re.compile(rb"(?:^|[ \t]+)#+[ \t]*\Z")
FENCE = re.compile(rb"(`{3,})([^`]*)\Z|(~{3,})(.*)\Z", re.S)
MATH = re.compile(rb"(\${2,})([^$]*)\Z", re.S)
DIRECTIVE = re.compile(rb"(:{3,})[ \t]*(?=[^ \t])")
BULLET = re.compile(rb"([-*+]|[0-9]{1,9}[.)])(?=[ \t]|\Z)")
FOOTNOTE = re.compile(rb"\[\^((?:\\[\[\\\]]|\\(?![\[\\\]])|[^\]\[ \t\n\\])+)\]")
DELIMITER_BYTES = re.compile(rb"[|\-: \t]+\Z")
DELIMITER_CELL = re.compile(rb"(:?)-+(:?)\Z")
HTML_RAW = re.compile(rb"<(?:%s)(?=[ \t>]|\Z)" % b"|".join(t.encode() for t in RAW_TAGS), re.I)
HTML_NAMED = re.compile(rb"(?:<(?:%(n)s)(?=[ \t>]|/>|\Z)|</(?:%(n)s)(?=[ \t>]|\Z))" % {b"n": b"|".join(t.encode() for t in BLOCK_TAGS)}, re.I)
# A name may start with a digit or hyphen here, unlike in text.
HTML_LONE = re.compile(_tags(rb"[ \t]").replace(rb"<[A-Za-z][A-Za-z0-9\-]*", rb"<[A-Za-z0-9\-]+").replace(rb"</[A-Za-z][A-Za-z0-9\-]*", rb"</[A-Za-z0-9\-]+") + rb"[ \t]*\Z")
HTML_END = {1: re.compile(rb"</(?:pre|script|style|textarea)>", re.I), 2: re.compile(rb"-->"), 3: re.compile(rb"\?>"), 4: re.compile(rb">"), 5: re.compile(rb"\]\]>")}
INLINE_TAG = re.compile(_tags(rb"[ \t\n]"))
AUTOLINK = re.compile(rb"<[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^<>\x00-\x20\x7f]*>")
EMAIL_LABEL = rb"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
EMAIL_AUTOLINK = re.compile(rb"<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@" + EMAIL_LABEL + rb"(?:\." + EMAIL_LABEL + rb")*>")
LIQUID_CLOSERS = {b"{%": b"%}", b"{{": b"}}"}
TITLES = {
    0x22: re.compile(rb'"(?:\\.|[^"\\])*"', re.S),
    0x27: re.compile(rb"'(?:\\.|[^'\\])*'", re.S),
    0x28: re.compile(rb"\((?:\\.|[^()\\])*\)", re.S),
}
ANGLE_DESTINATION = re.compile(rb"<(?:\\[!-/:-@\[-`{-~]|[^<>\n])*>")
LABEL = re.compile(rb"\[((?:\\[!-/:-@\[-`{-~]|[^\[\]])*)\]")
SPACES = re.compile(rb"[ \t]*")
PIPES = re.compile(rb"\\(?s:.)?|\|")
SPACES_LINE = re.compile(rb"[ \t]*(?:\n[ \t]*)?")
SPACES_LINES = re.compile(rb"[ \t\n]*")

# The code points whose text counts as Chinese, Japanese or Korean.
CJK = re.compile("[\u1100-\u11ff\u2e80-\u303f\u3040-\u30ff\u3130-\u318f\u31f0-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0003fffd]")

# Unicode White_Space without U+0085, with U+FEFF.
WHITE = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))


@lru_cache(65536)
def is_punctuation(c: str) -> bool:
    """Categories P and S, as the interpreter's Unicode tables have them."""
    return unicodedata.category(c)[0] in "PS"


def html_start(tail: bytes, para_open: bool) -> int:
    """The type of HTML block that a line starts, or 0."""
    if tail.startswith(b"<!--"):
        return 2
    if tail.startswith(b"<?"):
        return 3
    if tail.startswith(b"<![CDATA["):
        return 5
    if tail[:2] == b"<!" and tail[2:3].isalpha():
        return 4
    if HTML_RAW.match(tail):
        return 1
    if HTML_NAMED.match(tail):
        return 6
    return 7 if not para_open and HTML_LONE.match(tail) else 0


def row_cells(line: bytes) -> list[tuple[int, int]]:
    """Cell ranges of a table row, trimmed; outer pipes are decoration."""
    end = len(line.rstrip(WS))
    at = SPACES.match(line, 0, end).end()
    at += line[at : at + 1] == b"|"
    cuts, i = [], line.find(b"|", at, end)
    if line.find(b"\\", at, end) < 0:
        while i >= 0:
            cuts.append(i)
            i = line.find(b"|", i + 1, end)
    elif i >= 0:
        cuts = [m.start() for m in PIPES.finditer(line, at, end) if m[0] == b"|"]
    cells = []
    for stop in (*cuts, end):
        raw = line[at:stop]
        lead = len(raw) - len(raw.lstrip(WS))
        size = len(raw.strip(WS))
        if stop != end or stop in cuts or size:
            cells.append((at + lead, at + lead + size) if size else (at + lead, at + lead))
        at = stop + 1
    return cells


def alignments(tail: bytes) -> list[str] | None:
    """The alignments of a table's delimiter row."""
    if not DELIMITER_BYTES.match(tail):
        return None
    out = []
    for a, b in row_cells(tail):
        m = DELIMITER_CELL.match(tail, a, b)
        if not m:
            return None
        out.append({(1, 1): "Center", (1, 0): "Left", (0, 1): "Right"}.get((len(m[1]), len(m[2])), "None"))
    return out or None


def label_end(t: bytes, at: int) -> int | None:
    """Past the ``]`` of a link label that starts at ``at``."""
    m = LABEL.match(t, at)
    if not m or not m[1].strip(b" \t\n") or len(m[1]) > 999 and len(m[1].decode(errors="replace")) > 999:
        return None
    return m.end()


def footnote_label(t: bytes, at: int) -> tuple[int, int, int] | None:
    """(label start, label end, past the bracket)."""
    m = FOOTNOTE.match(t, at)
    return (m.start(1), m.end(1), m.end()) if m and m.end(1) - m.start(1) <= 999 else None


def destination(t: bytes, at: int) -> tuple[int, bool] | None:
    """(end, in angle brackets) of a link destination."""
    if t[at : at + 1] == b"<":
        m = ANGLE_DESTINATION.match(t, at)
        return (m.end(), True) if m else None
    depth, i, n = 0, at, len(t)
    while i < n:
        c = t[i]
        if c == 0x5C and ESCAPE.match(t, i):
            i += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            if not depth:
                break
            depth -= 1
        elif c <= 0x20 or c == 0x7F:
            break
        i += 1
    return None if depth else (min(i, n), False)


def title(t: bytes, at: int) -> int | None:
    """Past a title's closing mark."""
    pattern = TITLES.get(t[at]) if at < len(t) else None
    m = pattern.match(t, at) if pattern else None
    return m.end() if m else None


def normalize_label(text: str) -> str:
    """White space collapsed, and each character folded by lower, upper, lower."""
    text = re.sub(r"[\t\n\r ]+", " ", text).strip(" ")
    return "".join(c.lower().upper().lower() for c in text)


REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6});|#([0-9]{1,7});|([A-Za-z0-9]+;))")


def decode(raw: str, escapes: bool = True) -> str:
    """Character references, and backslash escapes, resolved."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            n = int(m[1], 16) if m[1] else int(m[2])
            return "\ufffd" if n == 0 or n > 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)
        return html5.get(m[3], m[0])

    if not escapes:
        return REFERENCE.sub(one, raw)
    out, at = [], 0
    for m in re.finditer(r"\\([!-/:-@\[-`{-~])|" + REFERENCE.pattern, raw):
        whole = m[0]
        out.append(raw[at : m.start()])
        out.append(m[1] if m[1] else one(REFERENCE.match(whole)))
        at = m.end()
    return "".join(out) + raw[at:]
