"""Documents to relational tables, by one Arrow kernel a table. Documents are independent, so nothing shuffles.

Texts that are null parse as empty. A text over ``max_doc_bytes`` gives a root alone and a diagnostic. Filters
do not pass through a Python kernel, so ``where`` takes the one to apply before parsing; columns other than
the two named never reach Python.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Collection

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import parse
from ..kernel.constructs import Constructs
from ..kernel.grammar import decode
from ..kernel.render import html as to_html
from ..kernel.render import signature as to_signature
from ..kernel.snapshot import snapshot as to_snapshot
from ..kernel.tree import Node
from ..plans.schema import BLANKS, DIAGNOSTICS, NODES

MAX_DOC_BYTES = 1 << 30
ROWS = 4_000
STRUCTURAL = {"ListItem", "TableRow", "TableCell"}
INLINE = {
    "Text", "SoftBreak", "HardBreak", "Emphasis", "Strong", "Strikethrough", "CodeSpan", "Link", "Image", "Autolink",
    "AutolinkLiteral", "HtmlInline", "FootnoteReference", "MathSpan", "WikiLink",
}

#: Inlines whose text is in pieces, and the bytes at both ends of the others that are no text.
PIECED = {"CodeSpan", "HtmlInline", "Liquid", "MathSpan"}
EDGES = {"Autolink": 1, "AutolinkLiteral": 0, "WikiLink": 2}
CELLS = "doc_id long, table_id int, row int, col int, align string, content string"

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("padding", pa.int32())])
_NODE = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int32()) for c in ("node_id", "parent_id", "subtree_end", "depth", "ord")), ("family", pa.string()), ("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("kind", pa.string()), ("marker", pa.string()), ("padding", pa.int32())]
    + [(c, pa.bool_()) for c in ("tight", "spread", "checked", "email", "angle", "cjk", "trailing_newline")]
    + [("align", pa.list_(pa.string())), ("spans", pa.map_(pa.string(), _SPAN)), ("segments", pa.map_(pa.string(), pa.list_(_SEGMENT))), ("lazy", pa.list_(_SPAN))]
)


def without_cycles(run):
    """``run``, a generator over batches, without the search for cycles: trees hold none, and are freed when they are let go."""

    def quiet(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return quiet


def _walk(root: Node):
    """(node, parent, depth, ord, inline) of every node in pre-order, a frame a level held; then (number,) once all below that node was given."""
    count, inline = 1, root.type in INLINE
    yield root, None, 0, 0, inline
    frames = [(0, iter(enumerate(root.kids)), inline)]
    while frames:
        k, kids, inline = frames[-1]
        for place, node in kids:
            own = inline or node.type in INLINE
            yield node, k, len(frames), place, own
            if node.kids:
                frames.append((count, iter(enumerate(node.kids)), own))
                count += 1
                break
            count += 1
        else:
            frames.pop()
            yield (k,)


def _ends(root: Node) -> array:
    """Where the subtree of every node ends, by its number in pre-order."""
    ends = array("i")
    for one in _walk(root):
        if len(one) == 1:
            ends[one[0]] = len(ends)
        else:
            ends.append(len(ends) + 1)
    return ends


def rows(doc_id, root: Node, types: frozenset[str] | None = None):
    """The rows of a tree, in pre-order, one at a time: a document's rows need not be held together. ``types``: those of these types alone."""
    ends, k = _ends(root), -1
    for one in _walk(root):
        if len(one) == 1:
            continue
        node, parent, depth, place, inline = one
        k += 1
        if types is not None and node.type not in types:
            continue
        p = node.props
        family = "inline" if inline else "struct" if node.type in STRUCTURAL else "block"
        marker = p.get("fence") or p.get("marker") or (str(p["tildes"]) if "tildes" in p else None)
        kind = p.get("kind") or (str(p["html"]) if "html" in p else None) or (("ordered" if p["ordered"] else "bullet") if "ordered" in p else None)
        spans = [(key, {"start": a, "end": b}) for key, (a, b) in node.spans.items()]
        segments = [(key, [{"start": a, "end": b, "padding": c} for a, b, c in s]) for key, s in node.segments.items() if key != "text"]
        yield [
            doc_id, k, parent, ends[k], depth, place, family, node.type, node.start, node.end, p.get("level"), kind, marker, p.get("padding"),
            p.get("tight"), p.get("spread"), p.get("checked"), p.get("email"), p.get("angle"), p.get("cjk"), p.get("newline"),
            p.get("align"), spans, segments, [{"start": a, "end": b} for a, b in node.lazy],
        ]


def flat(doc_id, root: Node) -> list[list]:
    return list(rows(doc_id, root))


def _source(docs: DataFrame, id_col: str, text_col: str, where: Column | None, *more: Column) -> DataFrame:
    """Only what the kernel needs, with the filter below it."""
    chosen = docs if where is None else docs.where(where)
    return chosen.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("source"), *more)


def parse_markdown(docs: DataFrame, constructs: Constructs | Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", inlines: bool | Collection[str] = True, types: Collection[str] | None = None, where: Column | None = None, max_doc_bytes: int = MAX_DOC_BYTES) -> DataFrame:
    """The nodes of every document; ``inlines=False`` stops after the block phase, and names of blocks parse the insides of these alone.

    ``types``: give nodes of these types alone, with the ids that they have among all; no others leave Python.

    ``constructs`` may be a STRUCT column, as ``lexical.options`` makes it, with the switches of each document.
    """
    per_row = isinstance(constructs, Column)
    own, fixed = ([constructs.alias("options")], None) if per_row else ([], constructs)
    inside = inlines if isinstance(inlines, bool) else frozenset(inlines)
    chosen = None if types is None else frozenset(types)

    @without_cycles
    def run(batches):
        sets: dict[tuple, Constructs | None] = {(): fixed}
        for batch in batches:
            held: list[list] = []
            switches = [tuple(x.items()) if x else () for x in batch.column(2).to_pylist()] if per_row else [()] * batch.num_rows
            for doc_id, source, switch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), switches, strict=True):
                if switch not in sets:  # each distinct set once a task
                    sets[switch] = Constructs(**{k: v for k, v in switch if v is not None})
                root = parse(source, sets[switch], inside)[0] if len(source) <= max_doc_bytes else Node("Root", 0, len(source))
                for row in rows(doc_id, root, chosen):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield _batch(held)
                        held = []
                root = row = None  # let go before the next tree is made
            if held:
                yield _batch(held)

    return _source(docs, id_col, text_col, where, *own).mapInArrow(run, NODES)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _content(source: bytes, leaf: Node) -> str:
    """The decoded text of an inline, as ``views.plain_text`` has it; that of one without a text of its own is empty."""
    kind = leaf.type
    if kind == "Text":
        return decode(source[leaf.start : leaf.end].decode())
    if kind in PIECED:
        parts = [" " * pad + source[a:b].decode() for a, b, pad in leaf.segments.get("pieces", ())]
        if kind == "MathSpan" and parts:
            parts[0] = parts[0].lstrip("$")
            parts[-1] = parts[-1].rstrip("$")
        return "\n".join(parts)
    if kind == "SoftBreak":
        return "\n"
    edge = EDGES.get(kind)
    return "" if edge is None else source[leaf.start + edge : leaf.end - edge].decode()


def parse_cells(docs: DataFrame, constructs: Constructs | None = None, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, max_doc_bytes: int = MAX_DOC_BYTES) -> DataFrame:
    """The cells of every table as ``views.table_cells`` has them, from the parse itself: no node leaves Python, and nothing is joined."""

    @without_cycles
    def run(batches):
        for batch in batches:
            held: list[list] = []
            for doc_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(source) > max_doc_bytes:
                    continue
                k, table, row, align, cell, level = -1, 0, 0, (), None, 0
                for one in _walk(parse(source, constructs)[0]):
                    if len(one) == 1:
                        continue
                    node, _, depth, place, _ = one
                    k += 1
                    if cell is not None and depth > level:
                        cell[5] += _content(source, node)
                        continue
                    cell = None
                    if node.type == "Table":
                        table, align = k, node.props.get("align") or ()
                    elif node.type == "TableRow":
                        row = place
                    elif node.type == "TableCell":
                        cell = [doc_id, table, row, place, align[place] if place < len(align) else None, ""]
                        level = depth
                        held.append(cell)
                if len(held) >= ROWS:
                    yield _cells(held)
                    held = []
            if held:
                yield _cells(held)

    return _source(docs, id_col, text_col, where).mapInArrow(run, CELLS)


def _cells(rows: list[list]) -> pa.RecordBatch:
    *keys, align, content = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.record_batch([*(pa.array(c, k) for c, k in zip(keys, kinds, strict=True)), pa.array(align, pa.string()), pa.array([c.strip(" ") for c in content], pa.string())], ["doc_id", "table_id", "row", "col", "align", "content"])


def blank_lines(docs: DataFrame, constructs: Constructs | None = None, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """All blank lines, and whether each can loosen a list."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = parse(source, constructs, False)[1]
                loose = set(blocks.loosening)
                rows += [(doc_id, i, a, b, (a, b) in loose) for i, (a, b) in enumerate(blocks.blanks)]
                blocks = loose = None  # let go before the next document is parsed
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "ord", "start", "end", "loosening"])

    return _source(docs, id_col, text_col, where).mapInArrow(run, BLANKS)


def diagnostics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_doc_bytes: int = MAX_DOC_BYTES) -> DataFrame:
    """Documents that are too long to parse; natively, from their sizes."""
    size = F.octet_length(F.col(text_col)).cast("long")
    long = docs.where(size > max_doc_bytes).select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit("SourceTooLong").alias("kind"), F.lit(0).cast("long").alias("start"), size.alias("end"), F.lit("source text is too long to parse").alias("message")
    )
    return long.selectExpr(*(c.split()[0].join(("`", "`")) for c in DIAGNOSTICS.split(", ")))


def _each(docs: DataFrame, make, name: str, constructs, id_col: str, text_col: str, where, keep: Collection[str] = ()) -> DataFrame:
    @without_cycles
    def run(batches):
        for batch in batches:
            out = [make(source, *parse(source, constructs)) for source in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(out, pa.string())], ["doc_id", *keep, name])

    source = _source(docs, id_col, text_col, where, *(F.col(c) for c in keep))
    kept = "".join(f"`{c}` {t}, " for c, t in source.dtypes[2:])
    return source.mapInArrow(run, f"doc_id long, {kept}{name} string")


def render_html(docs: DataFrame, constructs: Constructs | None = None, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, keep: Collection[str] = ()) -> DataFrame:
    """The HTML of every document; ``keep`` names columns that come along, so that no join has to fetch them."""
    return _each(docs, lambda source, root, _: to_html(source, root), "html", constructs, id_col, text_col, where, keep)


def signatures(docs: DataFrame, constructs: Constructs | None = None, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    return _each(docs, lambda source, root, _: to_signature(source, root), "signature", constructs, id_col, text_col, where)


def snapshots(docs: DataFrame, constructs: Constructs | None = None, *, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """The tree of each document as text."""
    return _each(docs, lambda source, root, blocks: to_snapshot(root, blocks), "tree", constructs, id_col, text_col, where)
