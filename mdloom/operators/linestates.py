"""What is open where a line begins, without Python: an automaton over the lines of a text.

``lexical.line_start`` classifies a lone line; whether a setext underline, a closing fence, the end of raw HTML or a delimiter row
counts depends on the lines before. Here every line becomes a map from the state before it to the state after it, from facts that
native expressions find in the line (and the one above). Lines are grouped in blocks, a block's maps composed into one, the blocks' maps
folded along each document, and the states of the lines filled in from the state that each block begins with: a prefix scan, in
which no task holds more of a document than a block of lines, or a small map for each of its blocks.

States are those at the outermost level: nothing, a paragraph, a table, indented code, raw HTML of type 1 to 7, a code
or math fence of some length, or a container (quote, list item or footnote), whose inside is not followed: it ends at a blank line or where
a block starts beside it. A template tag counts as a block where it is closed on its line; a directive's closing line ends
what is open; a paragraph of link definitions alone counts as a paragraph. Null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..kernel.constructs import Constructs
from ..sources.store import stored

BLOCK = 256
NONE, PARAGRAPH, TABLE, CODE, CONTAINER, HTML = 0, 1, 2, 3, 4, 4  # HTML blocks are HTML + type
BASE = ["none", "paragraph", "table", "code", "container", *(f"html{k}" for k in range(1, 8))]
#: A fence of a marker has the code FENCE + 3 * length + the marker's place.
FENCE, MARKERS = 100, "`~$"
STARTS = [
    "Blockquote", "SetextUnderline", "ThematicBreak", "AtxHeading", "CodeFence", "HtmlBlock", "MathFence", "Liquid", "DirectiveOpener",
    "FootnoteDefinition", "ListItem", "TableDelimiterRow", "DirectiveCloser", "TableRow",
]


def _chain(*cases: tuple[Column, Column | int], otherwise: Column | int) -> Column:
    out = None
    for when, then in cases:
        then = then if isinstance(then, Column) else F.lit(then)
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def _code(run: Column) -> Column:
    """The state of a fence from its marker run."""
    return F.lit(FENCE - 1) + 3 * F.length(run) + F.instr(F.lit(MARKERS), F.substring(run, 1, 1))


def facts(lines: DataFrame, on: Constructs) -> DataFrame:
    """``lines`` (with line and above) with the map of each line over the base states (``to``), the fence that it would close, and
    what it starts outside (``fresh``) and within a paragraph. In steps, so that each test is made once a line."""
    line, above, tail = (F.col(c) for c in ("line", "above", "_tail"))
    lines = lines.withColumns({"_tail": lx.flow_tail(line), "_blank": lx.is_blank(line), "_above": lx.flow_tail(above)})
    lines = lines.withColumns(
        {
            "_fresh": lx.tail_start(tail, F.lit(False), on),
            "_setext": tail.rlike(lx.SETEXT),
            "_delimits": F.when(tail.rlike(lx.DELIMITER), lx.table_delimiter_activates(above, line)).otherwise(False) if on.gfm_table else F.lit(False),
            "_kind": F.when(tail.startswith("<"), lx.html_type(tail, F.lit(False))),
            "_above_tag": F.when(F.col("_above").startswith("<"), lx.html_type(F.col("_above"), F.lit(False)) == 7).otherwise(False) if on.html_flow else F.lit(False),
            "_run": F.regexp_extract(tail, r"\A(`{3,}|~{3,}|\${2,})", 1),
            "_closer": F.regexp_extract(tail, r"\A(`{3,}|~{3,}|\${2,})[ \t]*\z", 1),
        }
    )
    fresh, kind, blank = F.col("_fresh"), F.col("_kind"), F.col("_blank")
    # within a paragraph: underlines come first, lone tags and some items do not count, and delimiter rows come before what needs no paragraph
    late = fresh.isNull() | fresh.isin("DirectiveCloser", "TableRow") | ((fresh == "HtmlBlock") & (kind == 7))
    within = (
        F.when(F.col("_setext") & ~F.coalesce(fresh == "Blockquote", F.lit(False)), "SetextUnderline")
        .when((fresh == "ListItem") & ~lx.item_interrupts(line), None)
        .when(late & F.col("_delimits"), "TableDelimiterRow")
        .when((fresh == "HtmlBlock") & (kind == 7), None)
        .otherwise(fresh)
    )
    lines = lines.withColumns({"_within": within, "_ended": F.coalesce(lx.html_ends(tail, kind), F.lit(False)), "_deep": lx.is_deep(line)})
    deep, ended = F.col("_deep"), F.col("_ended")
    tag = F.when(tail.startswith("{%"), tail.contains("%}")).otherwise(tail.contains("}}"))

    def enter(start: Column, text: int) -> Column:
        """The state after a line that is not blank, or continues nothing."""
        return _chain(
            (start.isNull(), text),
            (start.isin("AtxHeading", "ThematicBreak", "SetextUnderline", "DirectiveOpener", "DirectiveCloser"), NONE),
            (start.isin("CodeFence", "MathFence"), _code(F.col("_run"))),
            (start == "HtmlBlock", F.when(ended, NONE).otherwise(kind + HTML)),
            ((start == "Liquid") & tag, NONE),
            (start.isin("Blockquote", "FootnoteDefinition", "ListItem"), CONTAINER),
            (start == "TableDelimiterRow", F.when(F.col("_above_tag"), HTML + 7).otherwise(TABLE)),
            otherwise=text,
        )

    code = F.lit(CODE if on.code_indented else PARAGRAPH)
    to = [
        _chain((blank, NONE), (deep, code), otherwise=enter(fresh, PARAGRAPH)),
        _chain((blank, NONE), (deep, PARAGRAPH), otherwise=enter(F.col("_within"), PARAGRAPH)),
        _chain((blank, NONE), (deep, code), otherwise=enter(fresh, TABLE)),
        _chain((blank, CODE), (deep, CODE), otherwise=enter(fresh, PARAGRAPH)),
        _chain((blank, NONE), (deep, CONTAINER), otherwise=enter(fresh, CONTAINER)),
        *(F.when(F.coalesce(lx.html_ends(line, F.lit(k)), F.lit(False)), NONE).otherwise(HTML + k) for k in range(1, 6)),
        *(F.when(blank, NONE).otherwise(HTML + k) for k in (6, 7)),
    ]
    names = F.array(*map(F.lit, STARTS))
    number = lambda c: F.array_position(names, F.col(c)).cast("int")
    made = {"to": F.array(*(c.cast("int") for c in to)), "closer": F.coalesce(F.when(F.col("_closer") != "", _code(F.col("_closer"))), F.lit(-1)).cast("int")}
    return lines.withColumns({**made, "fresh": number("_fresh"), "within": number("_within")})


def _step(state: Column, line: Column) -> Column:
    """The state after a line: a fence closes at a closer of its marker that is as long or longer."""
    closes = (line["closer"] >= state) & (F.pmod(line["closer"] - state, F.lit(3)) == 0)
    return F.when(state < FENCE, F.get(line["to"], state)).when(closes, F.lit(NONE)).otherwise(state)


def line_states(docs: DataFrame, constructs: Constructs | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, place, open, starts, closes) for every line: what is open before it, what it starts there, and whether it ends
    a fence or raw HTML. ``open`` is none, paragraph, table, code, container, html1 to html7, fence or math."""
    on = constructs or Constructs.markdown()
    lines = lx.split_lines(F.col("text"))
    runs = F.regexp_extract_all("text", F.lit(r"(?m)^ {0,3}(`{3,}|~{3,}|\${2,})"), F.lit(1))
    fences = F.array_distinct(F.transform(runs, lambda r: _code(r).cast("int")))
    texts = docs.where("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), fences.alias("fences"), F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("above")).alias("lines")
    )  # one row a text: no line travels with its text
    known = texts.select("doc_id", "fences", F.posexplode("lines").alias("place", "x")).select("doc_id", "fences", "place", "x.*").where("line IS NOT NULL")
    found = facts(known, on)
    row = F.struct("place", "to", "closer", "fresh", "within")
    grouped = found.select("doc_id", "fences", F.floor(F.col("place") / block).cast("int").alias("block"), row.alias("line"))
    grouped = stored(grouped.groupBy("doc_id", "block").agg(F.first("fences").alias("fences"), F.array_sort(F.collect_list("line")).alias("lines")), "line-blocks")

    domain = F.concat(F.sequence(F.lit(0), F.lit(len(BASE) - 1)), "fences")
    after = F.transform(domain, lambda s: F.aggregate("lines", s, _step))
    maps = grouped.select("doc_id", "block", domain.alias("domain"), after.alias("after"))
    maps = maps.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.array_sort(F.collect_list(F.struct("block", "after"))).alias("maps"))

    def along(acc: Column, m: Column) -> Column:
        known = F.array_append(acc["starts"], F.struct(m["block"].alias("block"), acc["state"].alias("state")))
        return F.struct(F.get(m["after"], (F.array_position("domain", acc["state"]) - 1).cast("int")).alias("state"), known.alias("starts"))

    empty = F.struct(F.lit(NONE).alias("state"), F.array().cast("array<struct<block: int, state: int>>").alias("starts"))
    starts = maps.select("doc_id", F.inline(F.aggregate("maps", empty, along, lambda acc: acc["starts"])))

    def fill(acc: Column, line: Column) -> Column:
        return F.array_append(acc, _step(F.element_at(acc, -1), line))

    states = F.aggregate("lines", F.array("state"), fill)
    pairs = grouped.join(starts, ["doc_id", "block"]).select("doc_id", F.posexplode(F.arrays_zip("lines", F.slice(states, 1, F.size("lines")).alias("before"), F.slice(states, 2, F.size("lines")).alias("after"))).alias("_", "x"))
    line, before, after = F.col("x.lines"), F.col("x.before"), F.col("x.after")
    verbatim = before > HTML
    name = F.when(before < FENCE, F.get(F.array(*map(F.lit, BASE)), before)).when(F.pmod(before - FENCE, F.lit(3)) == 2, "math").otherwise("fence")
    number = F.when(verbatim | (before == CODE) & (after == CODE), None).when(before == PARAGRAPH, line["within"]).otherwise(line["fresh"])
    row = F.array_position(F.array(*map(F.lit, STARTS)), F.lit("TableRow")).cast("int")
    number = F.when((before == TABLE) & (after == TABLE), row).otherwise(number)
    return pairs.select(
        "doc_id", line["place"].alias("place"), name.alias("open"), F.get(F.array(*map(F.lit, STARTS)), F.nullif(number, F.lit(0)) - 1).alias("starts"), (verbatim & (after == NONE)).alias("closes")
    )
