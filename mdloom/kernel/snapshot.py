"""A tree as text: a line for each node, its facts, and its segments below it."""

from __future__ import annotations

from .blocks import Blocks
from .tree import Node

SHOWN = {"Text", "HardBreak", "ThematicBreak", "Autolink", "AutolinkLiteral", "WikiLink", "FootnoteReference"}
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"', "\0": "\\0"}


def quoted(source: bytes, a: int, b: int) -> str:
    text = source[a:b].decode(errors="replace")
    body = "".join(ESCAPES.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text)
    return f'[{a}..{b}] "{body}"'


def facts(node: Node, source: bytes) -> list[str]:
    p = node.props
    low = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
    span = lambda k: [f"{k}={quoted(source, *node.spans[k])}"] if k in node.spans else []
    lazy = [f"lazy=[{', '.join(quoted(source, *s) for s in node.lazy)}]"] if node.lazy else []
    dest = [*span("dest"), f"angle={low(p.get('angle'))}"] if "dest" in node.spans else []
    t = node.type
    if t == "Paragraph":
        return lazy
    if t == "Heading":
        return [f"level={p['level']}", f"kind={p['kind']}", *span("underline"), *lazy]
    if t == "CodeBlock":
        return ["kind=indented"] if p["kind"] == "indented" else [f"fence={p['fence']}", *span("lang"), *span("meta")]
    if t == "HtmlBlock":
        return [f"kind={p['html']}", f"trailing_newline={low(p['newline'])}"]
    if t == "List":
        return [f"marker={'ordered' if p['ordered'] else 'bullet'} '{p['marker']}'", f"tight={low(p['tight'])}"]
    if t == "ListItem":
        check = [*span("checkbox"), f"checked={low(p['checked'])}"] if "checkbox" in node.spans else []
        return [*span("marker"), f"padding={p['padding']}", f"spread={low(p['spread'])}", *check]
    if t == "Table":
        return [f"align=[{', '.join(p['align'])}]"]
    if t in ("Link", "Image"):
        return [f"kind={p['kind']}", *dest]
    if t == "Definition":
        return dest
    if t == "Text":
        return ["cjk"] if p.get("cjk") else []
    if t == "Autolink":
        return [f"email={low(p['email'])}"]
    if t == "ContainerDirective":
        return [*span("opening"), *span("closing")]
    simple = {"HardBreak": "kind", "Emphasis": "marker", "Strong": "marker", "Strikethrough": "tildes"}
    return [f"{simple[t]}={p[simple[t]]}"] if t in simple else [*span("label"), *span("meta")]


def snapshot(root: Node, blocks: Blocks) -> str:
    out, source = [], blocks.source
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        head = quoted(source, node.start, node.end) if node.type in SHOWN else f"[{node.start}..{node.end}]"
        out.append("  " * depth + " ".join([f"{node.type} {head}", *facts(node, source)]))
        for key in ("label", "title", "alt", "lines", "pieces"):
            for i, (a, b, pad) in enumerate(node.segments.get(key, ())):
                out.append("  " * (depth + 1) + f"{key}[{i}] {quoted(source, a, b)}" + (f" pad={pad}" if pad else ""))
        todo += [(k, depth + 1) for k in reversed(node.kids)]
    if blocks.blanks:
        out.append("blanks: " + " ".join(f"[{a}..{b}]" for a, b in blocks.blanks))
    return "\n".join(out) + "\n"
