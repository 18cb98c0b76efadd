"""What holds of every parse, as queries that return the rows that break it; and the summary of a test suite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def broken_spans(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, node_id, rule: bounds and character boundaries, containment, order, line endings in segments, empty text.

    Texts meet nodes once, for all rules that read them, and nodes meet their parents and siblings in one more pass.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    size = F.octet_length("raw")
    starts = lambda at: (at == size) | ~F.hex(F.substring("raw", (at + 1).cast("int"), 1)).rlike("^[89AB]")
    a, b = F.col("start"), F.col("end")
    listed = F.flatten(F.map_values("segments"))
    each = lambda bad, name: F.transform(F.filter("listed", bad), lambda s: F.lit(name))
    rules = F.concat(
        F.array_compact(F.array(F.when(~((a >= 0) & (a <= b) & (b <= size) & starts(a) & starts(b)), "bounds"))),
        each(lambda s: t.span_slice(F.col("raw"), s["start"], s["end"]).rlike(r"[\r\n]"), "ending"),
        each(lambda s: (s["start"] < a) | (s["end"] > b), "segment"),
    )
    read = nodes.select("doc_id", "node_id", "start", "end", listed.alias("listed")).join(src, "doc_id").select("doc_id", "node_id", F.explode(rules).alias("rule"))
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("start").alias("pa"), F.col("end").alias("pb"))
    before = F.lag("end").over(Window.partitionBy("doc_id", "parent_id").orderBy("ord"))
    placed = nodes.select("doc_id", "node_id", "parent_id", "ord", "type", "start", "end").join(parents.hint("merge"), ["doc_id", "parent_id"], "left").withColumn("before", before)
    named = F.array(F.when((a < F.col("pa")) | (b > F.col("pb")), "inside"), F.when(a < F.col("before"), "order"), F.when((F.col("type") == "Text") & (a == b), "empty"))
    return read.unionByName(placed.select("doc_id", "node_id", F.explode(F.array_compact(named)).alias("rule")))


def broken_blanks(blanks: DataFrame, docs: DataFrame) -> DataFrame:
    """Blank lines out of order or not blank."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("source"))
    rows = blanks.withColumn("before", F.lag("end").over(order)).join(src, "doc_id")
    bad = (F.col("start") < F.col("before")) | ~t.span_slice(F.col("source"), F.col("start"), F.col("end")).rlike(r"\A[ \t]*\z")
    return rows.where(bad).select("doc_id", "ord")


def suite_summary(results: DataFrame) -> DataFrame:
    """Per section of (section, example, passed): counts, and the examples that failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("example"))))
    return results.groupBy("section").agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("int")).alias("passed"), failed.alias("failed"))


# Shapes of text, as Java patterns. What counts as indent, blank, marker and opener there is the grammar's.
_INDENT = r"(?: {0,3}\t| {4})"
_SOLID = r"[^ \t\r\n]"
_BLANK = r"[ \t]*\r?\n"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_MARKER = r"(?:[-+*]|[0-9]{1,9}[.)])"
_OPENER = rf"[ \t]{{0,3}}(?:>|{_MARKER}[ \t])"
_PREFIX = rf"^(?:[ \t>]|{_MARKER}[ \t]|\[\^[^\]\n]*\]:[ \t]*)*+"
_ITEM = rf"{_MARKER}(?:[ \t]|\r?\n|\z)"
_TAG = r"[ \t]{0,3}</?[A-Za-z][A-Za-z0-9-]*(?:[ \t][^<>\n]*)?>[ \t]*\r?\n"
_NAMED = r"[\p{L}\p{N}_{\[]"
#: How many openers may stand before a marker on its line: a bound for the stack of the pattern, not of the text.
_OPENERS = 50

TEXT_SHAPES = {
    "fence_meta_space": rf"(?md){_PREFIX}(?:`{{3,}}[^`\n]*|~{{3,}}[^\n]*|\${{2,}}[^$\n]*){_SOLID}[ \t]+\r?$",
    "code_after_container": rf"(?md)^[ \t]{{0,3}}(?:>.*|{_MARKER}[ \t]*)\r?\n(?:{_TAG}|{_BLANK})?{_INDENT}[ \t]*{_SOLID}.*\r?\n{_INDENT}[ \t]*{_SOLID}",
    "astral_punctuation": rf"[*_~]{_ASTRAL}|{_ASTRAL}[*_~]",
    "list_after_code": rf"(?:\A|\n{_BLANK}|\n{_INDENT}[^\n]*\n){_INDENT}[ \t]*{_SOLID}[^\n]*\n(?:{_BLANK})*+(?:{_OPENER}){{0,{_OPENERS}}}[ \t]{{0,3}}{_ITEM}",
    "list_after_opened_container": rf"[^\n]\r?\n(?:{_OPENER}){{1,{_OPENERS}}}[ \t]{{0,3}}{_ITEM}",
    "directive_tab_or_astral": rf"(?md){_PREFIX}:{{3,}}[ \t]*(?:\t[ \t]*$|{_ASTRAL})",
    "loose_directive": rf"(?md){_PREFIX}:{{3,}}(?![\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_-]*[\p{{L}}\p{{N}}])?[ \t]*$)[ \t]*{_NAMED}",
    "directive_drops_footnotes": r"(?md)^[^\n]*\[\^[^\n]*\r?\n[ \t]{0,3}:{3,}",
}
_DEEP_BLANK, _CODE = rf"(?md)^{_INDENT}[ \t]*\r?$", rf"(?md)^{_INDENT}{_SOLID}"
_LIQUID = ((r"\A[ \t]{0,3}\{%", r"(?d)%\}[ \t]*\r?\z"), (r"\A[ \t]{0,3}\{\{", r"(?d)\}\}[ \t]*\r?\z"))
_CONTAINER = r"\A[ \t]{0,3}(?:>|[-+*][ \t]+\S|0{0,8}1[.)][ \t]+\S|\[\^[^\]\s]+\]:)"
_BLOCKISH = r"\A[ \t]{0,3}(?:[-+*#<>`~$]|[0-9]{1,9}[.)])"


def _failed_tag(lines: Column, opener: str, closer: str) -> Column:
    """Whether a template tag opens a line, finds no line that ends in its closer before one that opens a container, and a blockish line follows.

    Lines are gone through from the last to the first, with what the nearest ones below have.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("closer"), F.lit(None).cast("int").alias("container"), F.lit(False).alias("blockish"), F.lit(False).alias("failed"))

    def step(acc: Column, line: Column) -> Column:
        own = line.rlike(opener)
        closes = F.regexp_replace(line, opener, "").rlike(closer)
        near = F.when(closes, acc["at"]).otherwise(acc["closer"])
        lost = near.isNull() | F.coalesce(~closes & (acc["container"] >= near), F.lit(False))  # places count from the end
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(line.rlike(closer), acc["at"]).otherwise(acc["closer"]).alias("closer"),
            F.when(line.rlike(_CONTAINER), acc["at"]).otherwise(acc["container"]).alias("container"),
            (acc["blockish"] | line.rlike(_BLOCKISH)).alias("blockish"),
            (acc["failed"] | (own & lost & acc["blockish"])).alias("failed"),
        )

    return F.aggregate(F.reverse(lines), start, step, lambda acc: acc["failed"])


def _between(lines: Column, first: str, middle: str, last: str) -> Column:
    """Whether a line has a shape after the first line of one shape and before the last line of another."""
    place = lambda those: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(those), i)), lambda i: i.isNotNull())
    begin, end = F.array_min(place(first)), F.array_max(place(last))
    return F.exists(place(middle), lambda i: (i > begin) & (i < end))


def known_quirks(docs: DataFrame) -> DataFrame:
    """Shapes of input on which Markdown parsers are known to differ, one boolean column each; null texts have none."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("lines", F.split("text", "\n"))
    lines, text = F.col("lines"), F.col("text")
    shapes = {name: text.rlike(p) for name, p in TEXT_SHAPES.items()}
    shapes["deep_blank_in_code"] = text.rlike(_DEEP_BLANK) & text.rlike(_CODE)
    shapes["failed_liquid"] = _failed_tag(lines, *_LIQUID[0]) | _failed_tag(lines, *_LIQUID[1])
    blank = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))  # what ends in a line ending
    shapes["directive_in_item"] = _between(blank, rf"\A[ \t]{{0,3}}{_MARKER}[ \t]", r"\A[ \t]+:{3,}[^ \t\r\n:]", r"\A[ \t]*\r?\z")
    shapes["definition_in_directive"] = _between(lines, r"\[", rf"\A[ \t]{{0,3}}:{{3,}}[ \t]*{_NAMED}", r"\A[ \t>]*\[[^\]\n]*\]:")
    return rows.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(name) for name, c in sorted(shapes.items())))
