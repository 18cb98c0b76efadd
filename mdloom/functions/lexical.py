"""The line classifier as native columns: what a lone line starts, without Python."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import grammar as g
from ..kernel.constructs import Constructs

# Patterns of a line's tail, in order of precedence. Groups repeat possessively: nothing is to be taken back, and long lines need no stack.
SETEXT = r"\A(?:=+|-+)[ \t]*\z"
THEMATIC = r"\A(?:(?:-[ \t]*){3,}+|(?:_[ \t]*){3,}+|(?:\*[ \t]*){3,}+)\z"
ATX = r"\A#{1,6}(?:[ \t]|\z)"
FENCE = r"(?s)\A(?:`{3,}[^`]*|~{3,}.*)\z"
MATH = r"\A\${2,}[^$]*\z"
LIQUID = r"\A\{[%{]"
DIRECTIVE = r"\A:{3,}[ \t]*[\p{IsAlphabetic}\p{N}_{\[]"
DIRECTIVE_CLOSE = r"\A:{3,}[ \t]*\z"
FOOTNOTE = r"\A\[\^((?:\\[\[\\\]]|\\(?![\[\\\]])|[^\]\[ \t\n\\])++)\]:"
#: Bytes of a footnote's label.
LABEL_BYTES = 999
ITEM = r"\A(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|\z)"
#: A cell of a table row, up to the pipe that ends it; a backslash guards the character after it.
CELL = r"(?s)\G((?:[^|\\]++|\\.)*+\\?)(?:\||\z)"
DELIMITER = r"\A[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*+\|?[ \t]*\z"
RAW_TAG = rf"(?i)\A<(?:{'|'.join(g.RAW_TAGS)})(?:[ \t>]|\z)"
BLOCK_TAG = rf"(?i)\A(?:<(?:{'|'.join(g.BLOCK_TAGS)})(?:[ \t>]|/>|\z)|</(?:{'|'.join(g.BLOCK_TAGS)})(?:[ \t>]|\z))"
_ATTRIBUTE = r"""[A-Za-z_:][A-Za-z0-9_:.\-]*(?:[ \t]*=[ \t]*(?:"[^"]*"|'[^']*'|[^ \t\n"'=<>`]+))?"""
LONE_TAG = rf"\A(?:<[A-Za-z0-9\-]+(?:[ \t]+{_ATTRIBUTE})*+[ \t]*/?>|</[A-Za-z0-9\-]+[ \t]*>)[ \t]*\z"


def is_blank(line: Column) -> Column:
    """Spaces and tabs alone; no other white space counts."""
    return line.rlike(r"\A[ \t]*\z")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t"))


def indent_columns(line: Column) -> Column:
    """The columns of a line's leading white space, with tab stops at every fourth."""
    lead = F.regexp_extract(line, r"\A[ \t]*", 0)
    step = lambda col, c: F.when(c == "\t", col + 4 - col % 4).otherwise(col + 1)
    letters = F.filter(F.split(lead, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), step)


def strip_columns(line: Column, columns: int | Column) -> Column:
    """STRUCT of ``rest``, the line without up to so many columns of its leading white space, and ``padding``, the columns that a tab
    cut in two leaves over: the line then goes on with that many spaces, and ``rest``."""
    columns = columns if isinstance(columns, Column) else F.lit(columns)
    letters = F.filter(F.split(F.regexp_extract(line, r"\A[ \t]*", 0), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        to = F.when(c == "\t", acc["at"] + 4 - acc["at"] % 4).otherwise(acc["at"] + 1)
        more = acc["at"] < columns
        return F.struct(F.when(more, to).otherwise(acc["at"]).alias("at"), (acc["taken"] + more.cast("int")).alias("taken"))

    cut = lambda acc: F.struct(F.substring(line, acc["taken"] + 1, F.length(line)).alias("rest"), F.greatest(acc["at"] - columns, F.lit(0)).alias("padding"))
    return F.aggregate(letters, start, step, cut)


def is_deep(line: Column) -> Column:
    """Whether a line is four columns in or more: a tab within the first four columns leads there."""
    return line.rlike(r"\A(?: {4}| {0,3}\t)")


def flow_tail(line: Column) -> Column:
    """The line from where a block may start; null if it is four columns in or more."""
    return F.when(~is_deep(line), F.ltrim(line, F.lit(" ")))


def html_type(tail: Column, in_paragraph: Column) -> Column:
    return (
        F.when(tail.startswith("<!--"), 2)
        .when(tail.startswith("<?"), 3)
        .when(tail.startswith("<![CDATA["), 5)
        .when(tail.rlike(r"\A<![A-Za-z]"), 4)
        .when(tail.rlike(RAW_TAG), 1)
        .when(tail.rlike(BLOCK_TAG), 6)
        .when(~in_paragraph & tail.rlike(LONE_TAG), 7)
    )


def html_ends(tail: Column, kind: Column) -> Column:
    """Whether a line ends an HTML block of types 1 to 5."""
    return (
        F.when(kind == 1, tail.rlike(r"(?i)</(?:pre|script|style|textarea)>"))
        .when(kind == 2, tail.contains("-->"))
        .when(kind == 3, tail.contains("?>"))
        .when(kind == 4, tail.contains(">"))
        .when(kind == 5, tail.contains("]]>"))
        .otherwise(False)
    )


def fence_closes(tail: Column, marker: str, size: int) -> Column:
    return tail.rlike(rf"\A\Q{marker}\E{{{size},}}[ \t]*\z")


def footnote_starts(tail: Column) -> Column:
    """Whether a line's tail defines a footnote, whose label has its longest length in bytes."""
    return tail.rlike(FOOTNOTE) & (F.octet_length(F.regexp_extract(tail, FOOTNOTE, 1)) <= LABEL_BYTES)


def line_start(line: Column, in_paragraph: Column, constructs: Constructs | Column | None = None) -> Column:
    """What a line starts, as the block parser sees it: a name, or null for plain text."""
    return tail_start(flow_tail(line), in_paragraph, constructs)


def options(constructs: Constructs | None = None, **switched: Column) -> Column:
    """Constructs as a STRUCT of booleans, so that every row can have its own; ``switched`` names those that come from columns."""
    on = constructs or Constructs.markdown()
    unknown = set(switched) - {f.name for f in fields(on)}
    if unknown:
        raise ValueError(f"no such constructs: {sorted(unknown)}")
    return F.struct(*(switched.get(f.name, F.lit(getattr(on, f.name))).cast("boolean").alias(f.name) for f in fields(on)))


def _only(on: Constructs | Column, name: str | None, test: Column) -> Column | None:
    """``test`` where a construct is on: None if it is off for all rows. A null switch of a row has the default."""
    if name is None:
        return test
    if isinstance(on, Column):
        return test & F.coalesce(on[name], F.lit(getattr(Constructs.markdown(), name)))
    return test if getattr(on, name) else None


def _tests(t: Column, in_paragraph: Column) -> list[tuple[str | None, Column, str | None]]:
    """What a line's tail is tested for, in order of precedence: the construct that switches the test, the test, and what the line starts then."""
    rest = F.when(t.startswith("{%"), F.regexp_extract(t, r"(?s)\A\{%.*?%\}(.*)\z", 1)).otherwise(F.regexp_extract(t, r"(?s)\A\{\{.*?\}\}(.*)\z", 1))
    return [
        (None, t.isNull(), None),
        (None, t.startswith(">"), "Blockquote"),
        (None, in_paragraph & t.rlike(SETEXT), "SetextUnderline"),
        (None, t.rlike(THEMATIC), "ThematicBreak"),
        (None, t.rlike(ATX), "AtxHeading"),
        (None, t.rlike(FENCE), "CodeFence"),
        ("html_flow", t.startswith("<") & html_type(t, in_paragraph).isNotNull(), "HtmlBlock"),
        ("math_flow", t.rlike(MATH), "MathFence"),
        ("liquid", t.rlike(LIQUID) & is_blank(rest), "Liquid"),
        ("liquid", t.rlike(LIQUID), None),
        ("container_directive", t.rlike(DIRECTIVE), "DirectiveOpener"),
        ("gfm_footnote", footnote_starts(t), "FootnoteDefinition"),
        (None, t.rlike(ITEM), "ListItem"),
        ("gfm_table", in_paragraph & t.rlike(DELIMITER), "TableDelimiterRow"),
        ("container_directive", t.rlike(DIRECTIVE_CLOSE), "DirectiveCloser"),
        ("gfm_table", t.startswith("|"), "TableRow"),
    ]


def _first(tests: list[tuple[str | None, Column, str | None]], on: Constructs | Column) -> Column:
    out = F
    for construct, test, name in tests:
        only = _only(on, construct, test)
        if only is not None:
            out = out.when(only, F.lit(name).cast("string"))
    return out


def tail_start(t: Column, in_paragraph: Column, constructs: Constructs | Column | None = None) -> Column:
    """What a line's tail, as ``flow_tail`` gives it, starts. A column that has it makes it once for all the tests here.

    ``constructs`` may be a STRUCT column as ``options`` makes it: one plan then serves rows with different switches.
    """
    return _first(_tests(t, in_paragraph), Constructs.markdown() if constructs is None else constructs)


def tail_tests(tail: Column, in_paragraph: Column) -> Column:
    """The tests of a line's tail as the bits of a number: what it starts under any switches, for ``tests_start``."""
    bits = (F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test, _) in enumerate(_tests(tail, in_paragraph)))
    return reduce(lambda a, b: a + b, bits)


def tests_start(tests: Column, constructs: Constructs | Column | None = None) -> Column:
    """What a line with these ``tail_tests`` starts."""
    known = _tests(F.lit(""), F.lit(False))
    return _first([(construct, tests.bitwiseAND(F.lit(1 << k)) != 0, name) for k, (construct, _, name) in enumerate(known)], Constructs.markdown() if constructs is None else constructs)


def item_interrupts(line: Column) -> Column:
    """Whether a list marker may interrupt a paragraph: not empty, and a bullet or number one."""
    t = flow_tail(line)
    return t.rlike(r"\A(?:[-*+]|0{0,8}1[.)])[ \t]+[^ \t]")


def is_container(line: Column) -> Column:
    """Whether a line opens a container even inside a paragraph: a quote, a footnote definition, or an item that interrupts."""
    t = flow_tail(line)
    return F.coalesce(t.startswith(">") | footnote_starts(t) | (item_interrupts(line) & ~t.rlike(THEMATIC)), F.lit(False))


def run_length(text: Column, marker: str) -> Column:
    """How often a character stands at the start of a text."""
    return F.length(F.regexp_extract(text, rf"\A\Q{marker}\E*", 0))


def escapes_next(text: Column) -> Column:
    """Whether a text starts with a backslash before ASCII punctuation."""
    return text.rlike(r"\A\\[!-/:-@\[-`{-~]")


def ordered_number(marker: Column) -> Column:
    return F.regexp_extract(marker, r"\A([0-9]+)[.)]*\z", 1).try_cast("bigint")


def table_cells(line: Column) -> Column:
    """The cells of a table row, trimmed; outer pipes are decoration and a backslash guards a pipe."""
    row = F.btrim(line, F.lit(" \t"))
    inner = F.when(row.startswith("|"), F.substring(row, 2, F.length(row))).otherwise(row)
    found = F.transform(F.regexp_extract_all(inner, F.lit(CELL), F.lit(1)), lambda c: F.btrim(c, F.lit(" \t")))
    return F.slice(found, F.lit(1), F.size(found) - 1)  # one more at the end: what is after the last pipe, or nothing


def _pipes(row: Column) -> Column:
    return F.length(row) - F.length(F.replace(row, F.lit("|"), F.lit("")))


def table_width(line: Column) -> Column:
    """How many cells a table row has, by its pipes alone."""
    row = F.regexp_replace(F.btrim(line, F.lit(" \t")), r"(?s)\\.", "-")  # nothing that is guarded counts
    return _pipes(row) + 1 - row.startswith("|").cast("int") - ((row == "") | row.endswith("|")).cast("int")


def table_alignments(line: Column) -> Column:
    """The alignments of a delimiter row, or null."""
    cells = table_cells(F.regexp_replace(line, r"\A[ \t]*", ""))
    one = lambda c: F.when(c.rlike(r"\A:-+:\z"), "Center").when(c.startswith(":"), "Left").when(c.endswith(":"), "Right").otherwise("None")
    fine = line.rlike(r"\A[|\-: \t]+\z") & (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"\A:?-+:?\z"))
    return F.when(fine, F.transform(cells, one))


def table_delimiter_activates(header: Column, delimiter: Column) -> Column:
    """Whether a delimiter row makes a table of the line above it."""
    return ~is_deep(header) & ~is_deep(delimiter) & F.coalesce(delimiter.rlike(DELIMITER) & (table_width(delimiter) == table_width(header)), F.lit(False))


def code_info(info: Column) -> Column:
    """A fence's language and meta."""
    text = trimmed(info)
    lang = F.regexp_extract(text, r"(?s)\A[^ \t]*", 0)
    meta = F.regexp_extract(text, r"(?s)\A[^ \t]+[ \t]+(.*)\z", 1)
    return F.struct(F.nullif(lang, F.lit("")).alias("lang"), F.nullif(meta, F.lit("")).alias("meta"))


def split_lines(text: Column) -> Column:
    """A text's lines without their endings; an ending at the end opens no further line."""
    lines = F.split(text, r"\r\n|\n|\r")
    return F.when(text == "", F.array().cast("array<string>")).when(text.rlike(r"[\r\n]\z"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
