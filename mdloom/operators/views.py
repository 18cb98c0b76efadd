"""Relational views over the node table: plain joins, windows and higher-order functions by doc_id.

doc_id is the key of a document: where ids repeat or are null, ``guard.keyed`` gives documents keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .ranges import interval_join, named_texts, span_texts


#: Inlines whose text counts; with SoftBreak, all that ``plain_text`` reads besides the nodes it is asked for.
LEAVES = ("Text", "CodeSpan", "Autolink", "AutolinkLiteral", "HtmlInline", "MathSpan", "WikiLink", "Liquid")
TEXTS = (*LEAVES, "SoftBreak")


def _pick(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def span(name: str) -> Column:
    """The named span of a node, as segments; null where it has none."""
    s = F.element_at("spans", name)
    return F.when(s.isNotNull(), F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("padding"))))


def segments(name: str) -> Column:
    return F.element_at("segments", name)


def own(cut: int = 0) -> Column:
    """The node's own span, less some bytes at both ends, as segments."""
    return F.array(F.struct((F.col("start") + cut).alias("start"), (F.col("end") - cut).alias("end"), F.lit(0).alias("padding")))


def with_texts(nodes: DataFrame, docs: DataFrame, *columns: str, **texts: Column) -> DataFrame:
    """doc_id, node_id, these columns, and a text a name, of the segments it names."""
    given = nodes.select("doc_id", "node_id", *columns, *(s.alias(f"{n}_at") for n, s in texts.items()))
    return named_texts(given, docs, {n: F.col(f"{n}_at") for n in texts}).drop(*(f"{n}_at" for n in texts))


def plain_text(nodes: DataFrame, docs: DataFrame, *types: str) -> DataFrame:
    """(doc_id, node_id, content): the decoded text of the inlines below nodes of these types.

    Ancestry is a range of node ids: each text goes to the nodes above it by an interval join, and is put together in order.
    Texts fetch their slices alone, not their whole document.
    """
    heads = _pick(nodes, *types).select("doc_id", F.col("node_id").alias("head"), (F.col("node_id") + 1).alias("below"), F.col("subtree_end").alias("until"))
    kind = F.col("type")
    edge = F.when(kind == "Autolink", 1).when(kind == "WikiLink", 2).otherwise(0)
    own = F.array(F.struct((F.col("start") + edge).alias("start"), (F.col("end") - edge).alias("end"), F.lit(0).alias("padding")))
    spans = F.when(kind.isin("CodeSpan", "HtmlInline", "Liquid", "MathSpan"), F.element_at("segments", "pieces")).otherwise(own)
    leaf = _pick(nodes, *LEAVES)
    parts = leaf.select("doc_id", "node_id", "type", F.size(spans).alias("parts"), F.posexplode(spans).alias("part", "s")).select("doc_id", "node_id", "type", "part", "parts", "s.*")
    raw = F.concat(F.repeat(F.lit(" "), F.col("padding")), "slice")
    math = F.when(F.col("part") == 0, F.ltrim(raw, F.lit("$"))).otherwise(raw)
    math = F.when(F.col("part") == F.col("parts") - 1, F.rtrim(math, F.lit("$"))).otherwise(math)
    cooked = F.when(kind == "MathSpan", math).when(kind == "Text", t.decode(raw)).otherwise(raw)
    piece = F.concat(F.when(F.col("part") > 0, "\n").otherwise(""), cooked)
    texts = span_texts(parts, docs).select("doc_id", "node_id", "part", piece.alias("piece"))
    breaks = _pick(nodes, "SoftBreak").select("doc_id", "node_id", F.lit(0).alias("part"), F.lit("\n").alias("piece"))
    below = interval_join(texts.unionByName(breaks), heads, ["doc_id"], "node_id", "below", "until").select("doc_id", "head", "node_id", "part", "piece")
    own = heads.select("doc_id", "head", F.col("head").alias("node_id"), F.lit(0).alias("part"), F.lit("").alias("piece"))  # for those without text
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "part", "piece"))), lambda x: x["piece"]), "")
    return below.unionByName(own).groupBy("doc_id", "head").agg(content.alias("content")).select("doc_id", F.col("head").alias("node_id"), "content")


def headings(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, node_id, level, kind, start, content."""
    heads = _pick(nodes, "Heading").select("doc_id", "node_id", "level", "kind", "start")
    return heads.join(plain_text(nodes, docs, "Heading").hint("merge"), ["doc_id", "node_id"])


def outline(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Headings with the path of the headings above them: the last of each lower level, in document order."""
    order = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    out = headings(nodes, docs)
    for level in range(1, 7):
        at = F.when(F.col("level") <= level, F.struct("level", "content"))
        out = out.withColumn(f"h{level}", F.last(at, ignorenulls=True).over(order))
    levels = [F.when((F.col(f"h{k}")["level"] == k) & (F.col("level") >= k), F.col(f"h{k}")["content"]) for k in range(1, 7)]
    return out.select("doc_id", "node_id", "level", "content", F.array_join(F.array_compact(F.array(*levels)), " / ").alias("path"))


def sections(nodes: DataFrame) -> DataFrame:
    """Each top-level block with the nearest heading before it (an as-of match within the document)."""
    order = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    blocks = nodes.where((F.col("depth") == 1) & (F.col("family") == "block"))
    return blocks.withColumn("heading_id", F.last(F.when(F.col("type") == "Heading", F.col("node_id")), ignorenulls=True).over(order)).select("doc_id", "node_id", "type", "heading_id")


def code_blocks(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    rows = with_texts(_pick(nodes, "CodeBlock"), docs, "kind", "marker", lang=span("lang"), meta=span("meta"), code=segments("lines"))
    return rows.select("doc_id", "node_id", "kind", F.col("marker").alias("fence"), t.decode(F.col("lang")).alias("lang"), t.decode(F.col("meta")).alias("meta"), "code")


def verbatim(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """HTML, math and template blocks and spans, with their text."""
    tail = F.when(F.col("trailing_newline"), "\n").otherwise("")
    rows = with_texts(_pick(nodes, "HtmlBlock", "MathBlock", "Liquid", "HtmlInline", "MathSpan", "CodeSpan"), docs, "type", "kind", "trailing_newline", content=F.coalesce(segments("lines"), segments("pieces")))
    return rows.select("doc_id", "node_id", "type", "kind", F.concat("content", tail).alias("content"))


def list_items(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Items with their list's kind and tightness, marker, number and checkbox."""
    lists = _pick(nodes, "List").select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind"), F.col("tight"))
    items = with_texts(_pick(nodes, "ListItem").drop("marker"), docs, "parent_id", "ord", "spread", "padding", "checked", marker=span("marker"))
    return items.join(lists.hint("merge"), ["doc_id", "parent_id"]).select(
        "doc_id", "node_id", F.col("parent_id").alias("list_id"), "ord", "kind", "tight", "spread", "padding", "checked", "marker", F.regexp_extract("marker", r"\A([0-9]+)", 1).try_cast("bigint").alias("number")
    )


def table_cells(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Cells with their table, row (0 is the header), column, alignment and text."""
    tables = _pick(nodes, "Table").select("doc_id", F.col("node_id").alias("table_id"), "align")
    rows = _pick(nodes, "TableRow").select("doc_id", F.col("node_id").alias("row_id"), F.col("parent_id").alias("table_id"), F.col("ord").alias("row"))
    cells = _pick(nodes, "TableCell").select("doc_id", "node_id", F.col("parent_id").alias("row_id"), F.col("ord").alias("col"))
    # a node table is many times larger in memory than on disk, so Spark would take too much of it for small enough to broadcast
    full = cells.join(rows.hint("merge"), ["doc_id", "row_id"]).join(tables.hint("merge"), ["doc_id", "table_id"]).join(plain_text(nodes, docs, "TableCell").hint("merge"), ["doc_id", "node_id"])
    return full.select("doc_id", "table_id", "row", "col", F.get("align", F.col("col")).alias("align"), F.trim("content").alias("content"))


def directives(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    return with_texts(_pick(nodes, "ContainerDirective"), docs, opening=span("opening"), closing=span("closing"))


def wiki_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    return with_texts(_pick(nodes, "WikiLink"), docs, target=own(2))


def autolinks(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    rows = with_texts(_pick(nodes, "Autolink", "AutolinkLiteral"), docs, "type", "email", raw=own())
    kind = F.when(F.col("type") == "AutolinkLiteral", t.literal_kind(F.col("raw"))).when(F.col("email"), "Email").otherwise("Uri")
    return rows.select("doc_id", "node_id", "type", kind.alias("kind"), F.regexp_replace("raw", r"\A<|>\z", "").alias("address"))


def tightness_check(nodes: DataFrame, blanks: DataFrame) -> DataFrame:
    """Lists whose flag disagrees with a loosening blank line between two items or inside a spread item; none is right."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    gaps = _pick(nodes, "ListItem").select("doc_id", "parent_id", "end", F.lead("start").over(order).alias("next"), "spread")
    loose = blanks.where("loosening").select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    hit = gaps.join(loose, (F.col("doc_id") == F.col("d")) & (F.col("a") >= F.col("end")) & (F.col("a") < F.col("next")) & (F.col("b") <= F.col("next")), "left_semi")
    wide = hit.select("doc_id", "parent_id").union(gaps.where("spread").select("doc_id", "parent_id")).distinct().withColumn("loose", F.lit(True))
    lists = _pick(nodes, "List").select("doc_id", F.col("node_id").alias("parent_id"), "tight")
    return lists.join(wide.hint("merge"), ["doc_id", "parent_id"], "left").where(F.col("tight") == F.coalesce("loose", F.lit(False))).select("doc_id", F.col("parent_id").alias("list_id"))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """The node table as indented lines; those of a document are together, in order, and documents are in none."""
    return nodes.repartition("doc_id").sortWithinPartitions("doc_id", "node_id").select("doc_id", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), "type", F.lit(" ["), F.col("start"), F.lit(".."), F.col("end"), F.lit("]")).alias("line"))
