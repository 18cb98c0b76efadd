"""References and definitions: the one join in Markdown. The first definition of a label wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .views import _pick, own, segments, span, with_texts


def definitions(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, node_id, label_key, url, title, def_ord (1 for the one that counts)."""
    rows = with_texts(_pick(nodes, "Definition"), docs, label=segments("label"), dest=span("dest"), title=segments("title")).select(
        "doc_id", "node_id", t.normalize_label(F.col("label")).alias("label_key"), t.destination(F.col("dest")).alias("url"), t.title(F.col("title")).alias("title")
    )
    return rows.withColumn("def_ord", F.row_number().over(Window.partitionBy("doc_id", "label_key").orderBy("node_id")))


def footnotes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    rows = with_texts(_pick(nodes, "FootnoteDefinition"), docs, label=span("label")).select("doc_id", "node_id", t.normalize_label(F.col("label")).alias("label_key"))
    return rows.withColumn("def_ord", F.row_number().over(Window.partitionBy("doc_id", "label_key").orderBy("node_id")))


def references(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference links and images, and footnote calls, with the key they look up."""
    rows = nodes.where((F.col("type").isin("Link", "Image") & (F.col("kind") != "inline")) | (F.col("type") == "FootnoteReference"))
    label = F.when(F.col("type") == "FootnoteReference", span("label")).otherwise(segments("label"))
    return with_texts(rows, docs, "type", "kind", label=label).select("doc_id", "node_id", "type", "kind", t.normalize_label(F.col("label")).alias("label_key"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Every link and image with its target, inline or looked up."""
    rows = with_texts(_pick(nodes, "Link", "Image"), docs, "type", "kind", label=segments("label"), dest=span("dest"), title=segments("title")).select(
        "doc_id", "node_id", "type", "kind", t.normalize_label(F.col("label")).alias("label_key"), t.destination(F.col("dest")).alias("own_url"), t.title(F.col("title")).alias("own_title")
    )
    first = definitions(nodes, docs).where("def_ord = 1").select("doc_id", "label_key", "url", "title")
    out = rows.join(first.hint("merge"), ["doc_id", "label_key"], "left")
    inline = F.col("kind") == "inline"
    return out.select("doc_id", "node_id", "type", "kind", "label_key", F.when(inline, F.col("own_url")).otherwise(F.col("url")).alias("url"), F.when(inline, F.col("own_title")).otherwise(F.col("title")).alias("title"))


def unused_definitions(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Definitions that no link or image looks up."""
    used = references(nodes, docs).where("type <> 'FootnoteReference'").select("doc_id", "label_key").distinct()
    return definitions(nodes, docs).where("def_ord = 1").join(used.hint("merge"), ["doc_id", "label_key"], "left_anti").select("doc_id", "label_key")


def unused_footnotes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    used = references(nodes, docs).where("type = 'FootnoteReference'").select("doc_id", "label_key").distinct()
    return footnotes(nodes, docs).where("def_ord = 1").join(used.hint("merge"), ["doc_id", "label_key"], "left_anti").select("doc_id", "label_key")


def dangling_labels(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Bracketed text of the form [text][label] that stayed text because no definition has the label."""
    texts = with_texts(_pick(nodes, "Text"), docs, raw=own())
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("raw", F.lit(r"\]\[([^\[\]]+)\]"), F.lit(1))).alias("label"))
    known = definitions(nodes, docs).select("doc_id", "label_key").distinct()
    return found.select("doc_id", t.normalize_label(F.col("label")).alias("label_key")).distinct().join(known.hint("merge"), ["doc_id", "label_key"], "left_anti")
