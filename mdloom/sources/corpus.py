"""Where documents come from: files, test suites, random token soups, and Markdown rendered from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..functions.soup import soup
from .datasource import register

TOKENS = ["*", "**", "_", "~~", "`", "``", "$$", "[", "]", "(", ")", "![", "](", "[^1]", "]:", "<", ">", "<a>", "<!--", "-->", "- ", "1. ", "2) ", "> ", "# ", "---", "\n", "\n\n", "\t", "    ", " ", "a", "foo", "é", "漢", "|", "|-|", "\\", "{{", "}}", ":::a", "[[", "]]", "www.a.b", "u@e.com", "&amp;", "[x] "]
#: Further tokens of texts that stress a parser: underlines, single dollars, tags, raw text elements, line endings, markers of deep or odd lines.
WIDE = [*TOKENS, "=", "===", "$", "$x$", "{%", "%}", "{% t %}", "{{ v }}", "<script>", "</script>", "<pre x>", "</pre>", "<textarea>\n", "<span x=1>", "</span>", "\r\n", "  \r\n", "  \n", "\\\n", "```\n", "***", "[x]: /u", "[^1]: n", "\"t\"", "http://x.y/p(q)", "😀", "\u3000", "::::", ":::note\n", "{.c}", "    a\n", "      \n", "\t\n", "+", "2)", "_", "__"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: doc_id (a hash of its path), path, text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_stream(reader: DataStreamReader, path: str) -> DataFrame:
    return reader.schema("value string").option("wholetext", True).format("text").load(path).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def read_suite_json(spark: SparkSession, path: str) -> DataFrame:
    """A CommonMark suite: example, section, markdown, html."""
    return spark.read.json(path, multiLine=True).select(F.col("example").cast("int").alias("example"), "section", "markdown", "html")


def read_suite_text(spark: SparkSession, path: str) -> DataFrame:
    """A suite in specification text: examples between long fences, an arrow for a tab, numbered over the whole file."""
    register(spark)
    return spark.read.format("markdown_suite").load(path).select("example", "section", "markdown", "html")


def token_soup(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """(doc_id, text): random runs of 2 to 40 tokens, the same for the same seed, without Python."""
    return spark.range(count).select(F.col("id").alias("doc_id"), soup(F.lit(seed * 1_000_003) + F.col("id"), TOKENS).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt over several tasks a core, for work in Python that outweighs their bytes.

    A table of a few MB is one row group, and one task, however many documents are rendered from it.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def guarded(column):
    """A value that stays one table cell of plain text."""
    return F.regexp_replace(F.regexp_replace(column, r"([\\`*_\[\]<>|&~$])", r"\\$1"), r"[\r\n]+", " ")


def _body(rows: DataFrame, key: str, line, order: str, name: str = "body") -> DataFrame:
    """Lines of a document in order, grouped by its key."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias(name))


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet an order: a heading and a table of its lines."""
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    line = F.format_string("| %d | %s | %d | %.2f |", F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity").cast("long"), F.col("l_extendedprice"))
    body = _body(rows, "l_orderkey", line, "o")
    head = F.concat(F.lit("# Order "), F.col("l_orderkey"), F.lit("\n\n| line | flag | quantity | price |\n| ---: | :-: | --: | ---: |\n"))
    return body.select(F.col("l_orderkey").alias("doc_id"), F.concat(head, "body", F.lit("\n")).alias("text"))


def nation_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region: nested lists of its nations."""
    nations = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("- "), F.col("n_name"), F.lit("\n  - key "), F.col("n_nationkey"))
    body = _body(nations, "n_regionkey", line, "n_name")
    full = table(spark, sf_dir, "region").join(body, F.col("r_regionkey") == F.col("n_regionkey"))
    return full.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("## "), "r_name", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))


def customer_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checklist a nation: customers in credit are checked."""
    box = F.when(F.col("c_acctbal") > 0, "[x]").otherwise("[ ]")
    body = _body(table(spark, sf_dir, "customer"), "c_nationkey", F.concat(F.lit("* "), box, F.lit(" "), "c_name"), "c_custkey")
    return body.select(F.col("c_nationkey").cast("long").alias("doc_id"), "body").withColumnRenamed("body", "text")


def part_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue a size: reference links to parts, with a definition for every part whose key three does not divide."""
    parts = table(spark, sf_dir, "part")
    line = F.concat(F.lit("[x "), F.col("p_partkey"), F.lit("][Part-"), F.col("p_partkey"), F.lit("]"))
    links = _body(parts, "p_size", line, "p_partkey", "links")
    target = F.concat(F.lit("[part-"), F.col("p_partkey"), F.lit("]: /parts/"), F.col("p_partkey"), F.lit(' "'), F.col("p_brand"), F.lit('"'))
    defined = _body(parts.where("p_partkey % 3 <> 0"), "p_size", target, "p_partkey", "defs")
    full = links.join(defined, "p_size", "left")
    return full.select(F.col("p_size").cast("long").alias("doc_id"), F.concat("links", F.lit("\n\n"), F.coalesce("defs", F.lit(""))).alias("text"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log an event: its properties in a fence whose language is the event's type."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), "event_id")
    return e.select(F.col("event_id").alias("doc_id"), F.concat(F.lit("~~~ "), "event_type", F.lit(" user="), F.col("user_id"), F.lit("\n"), F.coalesce("props", F.lit("")), F.lit("\n~~~\n")).alias("text"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation a document: each turn quoted as deep as it is late, four levels at most."""
    turns = table(spark, sf_dir, "conversations")
    level = (F.col("turn") % 4 + 1).cast("int")
    line = F.concat(F.repeat(F.lit("> "), level), F.lit("turn "), F.col("turn"), F.lit("\n"))
    return _body(turns, "conv_id", line, "turn", "text").withColumnRenamed("conv_id", "doc_id")
