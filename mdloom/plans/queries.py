"""Queries over the driver's tables: Markdown rendered from them, parsed, and compared with plain SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import text as t
from ..kernel.constructs import Constructs
from ..operators import invariants, resolve, views
from ..operators.parse import INLINE, blank_lines, diagnostics, parse_cells, parse_markdown, render_html, signatures, snapshots
from ..sources import corpus
from ..sources.store import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _parsed(docs: DataFrame, *types: str, inlines: bool | tuple[str, ...] = True) -> DataFrame:
    """The nodes of documents (of these types, or all), parsed once for all the views of a query."""
    return stored(parse_markdown(docs, inlines=inlines, types=types or None), "nodes")


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- entry points, source scan, spans


@query("SELECT l_returnflag, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS sum_qty FROM lineitem GROUP BY l_returnflag")
def md_order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order sheets as Markdown tables, parsed, and their cells summed."""
    cells = parse_cells(corpus.order_sheets(spark, sf_dir)).where("row > 0 AND col IN (1, 2)")
    rows = cells.groupBy("doc_id", "table_id", "row").agg(F.max(F.when(F.col("col") == 1, F.col("content"))).alias("l_returnflag"), F.max(F.when(F.col("col") == 2, F.col("content").try_cast("bigint"))).alias("q"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n_lines"), F.sum("q").alias("sum_qty"))


@query(r"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, sum(length(line)) AS n_chars FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r')) AS line FROM documents WHERE text <> '') GROUP BY doc_id")
def md_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _prose(spark, sf_dir)
    lines = docs.select("doc_id", F.explode(lx.split_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("decimal(38,0)").alias("n_chars"))


@query("SELECT doc_id, left(text, 12) AS head, CAST(strlen(left(text, 12)) AS BIGINT) AS n_bytes, md5(substr(text, 13)) AS rest, strlen(text) = 0 AS is_empty FROM documents")
def md_span_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte spans of characters: the head of each text, and what is after it, cut by bytes."""
    docs = _prose(spark, sf_dir)
    n = F.octet_length(F.substring("text", 1, 12)).cast("long")
    return docs.select("doc_id", t.span_slice(F.col("text"), F.lit(0), n).alias("head"), n.alias("n_bytes"), F.md5(t.span_slice(F.col("text"), n, F.octet_length("text")).cast("binary")).alias("rest"), t.span_empty(F.lit(0), F.octet_length("text")).alias("is_empty"))


@query()
def md_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(corpus.part_catalogues(spark, sf_dir))


@query()
def md_tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tree_lines(parse_markdown(corpus.nation_outlines(spark, sf_dir)))


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS kind, 0::BIGINT AS start, 0::BIGINT AS \"end\", '' AS message WHERE false")
def md_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(_prose(spark, sf_dir))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS \"end\", 'SourceTooLong' AS kind FROM documents WHERE strlen(text) > 4000")
def md_diagnostics_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(_prose(spark, sf_dir), max_doc_bytes=4000).select("doc_id", "end", "kind")


# ---- blocks


@query("SELECT r_name AS region, CAST(count(*) AS BIGINT) AS nations, max(n_nationkey) AS top_key, count(*) * 2 AS items FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def md_nation_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and nested lists."""
    docs = corpus.nation_outlines(spark, sf_dir)
    nodes = _parsed(docs)
    heads = views.headings(nodes, docs).select("doc_id", F.col("content").alias("region"))
    items = nodes.where("type = 'ListItem'").select("doc_id", "node_id", "depth")
    texts = views.plain_text(nodes, docs, "Paragraph")
    paras = nodes.where("type = 'Paragraph'").select("doc_id", "node_id", F.col("parent_id").alias("item")).join(texts, ["doc_id", "node_id"])
    full = items.join(paras.select("doc_id", F.col("item").alias("node_id"), "content"), ["doc_id", "node_id"])
    key = F.when(F.col("depth") == 4, F.regexp_extract("content", r"key (\d+)", 1).try_cast("int"))
    return full.groupBy("doc_id").agg(F.sum((F.col("depth") == 2).cast("long")).alias("nations"), F.max(key).alias("top_key"), F.count("*").alias("items")).join(heads, "doc_id").select("region", "nations", "top_key", "items")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS checked, true AS tight FROM customer GROUP BY c_nationkey")
def md_customer_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.customer_checklists(spark, sf_dir)
    items = views.list_items(_parsed(docs, "List", "ListItem", inlines=False), docs)
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("checked").cast("long")).alias("checked"), F.bool_and("tight").alias("tight"))


@query("SELECT event_type AS lang, count(*) AS n, CAST(sum(length(coalesce(props, ''))) AS BIGINT) AS chars FROM events GROUP BY event_type")
def md_event_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.event_logs(spark, sf_dir)
    code = views.code_blocks(parse_markdown(docs, inlines=False, types=["CodeBlock"]), docs)
    return code.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("chars"))


@query("SELECT event_id AS doc_id, 'user=' || user_id AS meta FROM events")
def md_fence_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.event_logs(spark, sf_dir)
    return views.code_blocks(parse_markdown(docs, inlines=False, types=["CodeBlock"]), docs).select("doc_id", "meta")


@query("SELECT conv_id AS doc_id, count(*) AS turns, max(turn % 4 + 1) AS deepest FROM conversations GROUP BY conv_id")
def md_quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.quoted_threads(spark, sf_dir)
    paras = parse_markdown(docs).where("type = 'Paragraph'").select("doc_id", (F.col("depth") - 1).cast("long").alias("level"))
    return paras.groupBy("doc_id").agg(F.count("*").alias("turns"), F.max("level").alias("deepest"))


@query("SELECT conv_id AS doc_id, count(*) - 1 AS blanks FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def md_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_lines(corpus.quoted_threads(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("blanks"))


@query("SELECT l_orderkey AS doc_id, count(*) + 1 AS n_rows, 'Right,Center,Right,Right' AS aligned FROM lineitem GROUP BY l_orderkey")
def md_table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_markdown(corpus.order_sheets(spark, sf_dir), inlines=False, types=["Table", "TableRow"])
    row, aligned = F.col("type") == "TableRow", F.when(F.col("type") == "Table", F.array_join("align", ","))
    tables = nodes.groupBy("doc_id").agg(F.count_if(row).alias("n_rows"), F.collect_list(aligned).alias("tables"))
    return tables.where("n_rows > 0").select("doc_id", "n_rows", F.explode("tables").alias("aligned"))


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS list_id WHERE false")
def md_list_tightness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.customer_checklists(spark, sf_dir).unionByName(corpus.token_soup(spark, 500).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    return views.tightness_check(_parsed(docs, inlines=False), blank_lines(docs))


@query("SELECT l_orderkey AS doc_id, 'Order ' || l_orderkey AS path, 'Table' AS type FROM lineitem GROUP BY l_orderkey")
def md_section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the path of its nearest heading."""
    docs = corpus.order_sheets(spark, sf_dir)
    nodes = _parsed(docs, "Heading", "Table", *views.TEXTS, inlines=("Heading",))
    paths = views.outline(nodes, docs).select("doc_id", F.col("node_id").alias("heading_id"), "path")
    return views.sections(nodes).where("type = 'Table'").join(paths.hint("merge"), ["doc_id", "heading_id"]).select("doc_id", "path", "type")


@query()
def md_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.token_soup(spark, 1000)
    return views.verbatim(parse_markdown(docs), docs)


@query()
def md_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.token_soup(spark, 1000)
    return views.directives(parse_markdown(docs), docs)


# ---- line classifier, natively

#: Markers put before lines of prose, so that every kind of line occurs.
MARKERS = ["", "> ", "# ", "- ", "7) ", "```", "~~~ ", "$$", "::: ", "| ", "<div> ", "    ", "* * *", "<!-- ", "[^n]: ", "####### ", "{% ", ":::", "  + ", "1234567890. "]


def _marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _prose(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("place", "raw"))
    marker = F.get(F.array(*map(F.lit, MARKERS)), ((F.col("doc_id") + F.col("place")) % len(MARKERS)).cast("int"))
    return lines.select("doc_id", "place", F.concat(marker, "raw").alias("line"))


_LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, list_extract([" + ", ".join("'" + m + "'" for m in MARKERS) + f"], CAST((doc_id + i - 1) % {len(MARKERS)} AS INTEGER) + 1) || list_extract(l, i) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents) d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u"
_TAGS = "|".join(lx.g.BLOCK_TAGS)


@query(
    f"""
WITH lines AS ({_LINES}), t AS (SELECT *, regexp_replace(line, '^[ \\t]*', '') AS t, length(line) - length(ltrim(line, ' ')) AS lead FROM lines)
SELECT doc_id, place, CASE
  WHEN lead >= 4 THEN NULL
  WHEN starts_with(t, '>') THEN 'Blockquote'
  WHEN regexp_full_match(t, '(?:-[ \\t]*){{3,}}|(?:_[ \\t]*){{3,}}|(?:\\*[ \\t]*){{3,}}') THEN 'ThematicBreak'
  WHEN regexp_matches(t, '^#{{1,6}}(?:[ \\t]|$)') THEN 'AtxHeading'
  WHEN regexp_full_match(t, '`{{3,}}[^`]*|~{{3,}}.*') THEN 'CodeFence'
  WHEN regexp_matches(t, '^<(?:!--|\\?|![A-Za-z]|!\\[CDATA\\[)') OR regexp_matches(t, '(?i)^</?(?:{_TAGS})(?:[ \\t>]|/>|$)') THEN 'HtmlBlock'
  WHEN regexp_full_match(t, '\\${{2,}}[^$]*') THEN 'MathFence'
  WHEN starts_with(t, '{{%') THEN CASE WHEN NOT contains(t, '%}}') THEN 'Liquid' END
  WHEN starts_with(t, '{{{{') THEN CASE WHEN NOT contains(t, '}}}}') THEN 'Liquid' END
  WHEN regexp_matches(t, '^:{{3,}}[ \\t]*[\\p{{L}}\\p{{N}}_{{\\[]') THEN 'DirectiveOpener'
  WHEN regexp_matches(t, '^\\[\\^[^\\]\\[ ]+\\]:') THEN 'FootnoteDefinition'
  WHEN regexp_matches(t, '^(?:[-*+]|[0-9]{{1,9}}[.)])(?:[ \\t]|$)') THEN 'ListItem'
  WHEN regexp_full_match(t, ':{{3,}}[ \\t]*') THEN 'DirectiveCloser'
  WHEN starts_with(t, '|') THEN 'TableRow' END AS kind
FROM t
"""
)
def lex_line_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _marked_lines(spark, sf_dir)
    return lines.select("doc_id", "place", lx.line_start(F.col("line"), F.lit(False)).alias("kind"))


@query(f"WITH lines AS ({_LINES}) SELECT doc_id, place, regexp_full_match(line, '[ \\t]*') AS blank, trim(line, ' ' || chr(9)) AS trimmed FROM lines")
def lex_blank_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_lines(spark, sf_dir).select("doc_id", "place", lx.is_blank(F.col("line")).alias("blank"), lx.trimmed(F.col("line")).alias("trimmed"))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS number FROM part WHERE p_partkey < 1000000000")
def lex_ordered_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "part").select("p_partkey", lx.ordered_number(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("."))).alias("number"))


@query("SELECT l_orderkey, l_linenumber, CAST(4 AS INTEGER) AS n_cells, l_returnflag AS second, l_linenumber % 3 = 1 AS activates FROM lineitem")
def lex_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row cells and delimiter activation: rows of four cells over delimiter rows of three to five."""
    rows = corpus.table(spark, sf_dir, "lineitem")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    line = F.concat(F.lit("| "), told("l_linenumber"), F.lit(" | "), told("l_returnflag"), F.lit(" | "), told("l_partkey"), F.lit(" | a\\|b |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(":-:|"), (F.col("l_linenumber") % 3 + 3).cast("int")))
    made = rows.select("l_orderkey", "l_linenumber", line.alias("line"), rule.alias("rule"))
    cut = made.select("l_orderkey", "l_linenumber", lx.table_cells(F.col("line")).alias("cells"), lx.table_delimiter_activates(F.col("line"), F.col("rule")).alias("activates"))
    return cut.select("l_orderkey", "l_linenumber", F.size("cells").alias("n_cells"), F.get("cells", F.lit(1)).alias("second"), "activates")


@query("SELECT event_id, event_type AS lang, nullif('u' || user_id, '') AS meta FROM events")
def lex_code_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = lx.code_info(F.concat(F.lit("  "), "event_type", F.lit(" \t u"), "user_id", F.lit("  ")))
    return corpus.table(spark, sf_dir, "events").select("event_id", info["lang"].alias("lang"), info["meta"].alias("meta"))


@query("SELECT p_partkey, p_partkey % 4 IN (1, 2) AS interrupts FROM part")
def lex_item_interrupts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bullet or number one with content interrupts; an empty item and number two do not."""
    line = F.get(F.array(F.lit("2. a"), F.lit("- a"), F.lit("1) a"), F.lit("*  ")), (F.col("p_partkey") % 4).cast("int"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", lx.item_interrupts(line).alias("interrupts"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 2) AS container, CAST(p_partkey % 7 AS INTEGER) AS run, p_partkey % 2 = 0 AS escapes FROM part")
def lex_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, runs of a marker and escapes."""
    k = F.col("p_partkey")
    line = F.get(F.array(*map(F.lit, ("> a", "2. a", "[^a]: b", "# a", "- - -"))), (k % 5).cast("int"))
    run = F.concat(F.repeat(F.lit("~"), (k % 7).cast("int")), F.lit(" ~"))
    escape = F.when(k % 2 == 0, "\\*").otherwise("\\a")
    return corpus.table(spark, sf_dir, "part").select("p_partkey", lx.is_container(line).alias("container"), lx.run_length(run, "~").alias("run"), lx.escapes_next(escape).alias("escapes"))


# ---- inlines, references


@query("SELECT CAST(p_size AS BIGINT) AS doc_id, CAST(sum(CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS resolved, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dangling FROM part GROUP BY p_size")
def md_part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.part_catalogues(spark, sf_dir)
    nodes = _parsed(docs, "Definition", "Link", "Image", "Text")
    found = resolve.links(nodes, docs).where("url IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("resolved"))
    lost = resolve.dangling_labels(nodes, docs).groupBy("doc_id").agg(F.count("*").alias("dangling"))
    full = docs.select("doc_id").join(found, "doc_id", "left").join(lost, "doc_id", "left")
    return full.select("doc_id", F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"), F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"))


@query("SELECT 'part-' || p_partkey AS label_key, '/parts/' || p_partkey AS url, p_brand AS title, 1 AS def_ord FROM part WHERE p_partkey % 3 <> 0")
def md_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.part_catalogues(spark, sf_dir)
    return resolve.definitions(parse_markdown(docs, inlines=False, types=["Definition"]), docs).select("label_key", "url", "title", "def_ord")


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS label_key WHERE false")
def md_unused_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.part_catalogues(spark, sf_dir)
    return resolve.unused_definitions(_parsed(docs, "Definition", "Link", "Image"), docs)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.dealt(corpus.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    text = F.concat(F.lit("*a* **b** ~~c~~ `d` [^N"), "c_custkey", F.lit("] <u@e.com> www.x.y/"), "c_custkey", F.lit(" [[w]] $$m$$ {{ l }}  \nx\\\ny\nz &amp; &#65;\n\n[^n"), "c_custkey", F.lit("]: note\n[^o]: other\n"))
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query("SELECT type, count(*) * k AS n FROM customer, (VALUES ('Emphasis', 1), ('Strong', 1), ('Strikethrough', 1), ('CodeSpan', 1), ('FootnoteReference', 1), ('Autolink', 1), ('AutolinkLiteral', 1), ('WikiLink', 1), ('MathSpan', 1), ('Liquid', 1), ('HardBreak', 2), ('SoftBreak', 1)) v(type, k) GROUP BY type, k")
def md_inline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_markdown(_notes(spark, sf_dir), types=(INLINE - {"Text"}) | {"Liquid"})
    return nodes.where("family = 'inline' AND type <> 'Text' OR type = 'Liquid'").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS doc_id, 'n' || c_custkey AS called, 'o' AS unused FROM customer")
def md_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _notes(spark, sf_dir)
    nodes = _parsed(docs, "FootnoteReference", "FootnoteDefinition", "Link", "Image")
    called = resolve.references(nodes, docs).where("type = 'FootnoteReference'").select("doc_id", F.col("label_key").alias("called"))
    return called.join(resolve.unused_footnotes(nodes, docs).select("doc_id", F.col("label_key").alias("unused")).hint("merge"), "doc_id")


@query("SELECT c_custkey AS doc_id, 'a b c d  u@e.com www.x.y/' || c_custkey || ' w m {{ l }}x' AS content FROM customer")
def md_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text content: breaks and footnote calls have none, entities are decoded."""
    docs = _notes(spark, sf_dir)
    nodes = _parsed(docs, "Paragraph", *views.TEXTS)
    first = nodes.where("type = 'Paragraph' AND parent_id = 0").select("doc_id", "node_id")
    text = views.plain_text(nodes, docs, "Paragraph").join(first.hint("merge"), ["doc_id", "node_id"])
    return text.select("doc_id", F.regexp_replace("content", "(?s)xy.*", "x").alias("content"))


@query("SELECT c_custkey AS doc_id, kind, address FROM customer, LATERAL (VALUES ('Email', 'u@e.com'), ('Www', 'www.x.y/' || c_custkey)) v(kind, address)")
def md_autolinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _notes(spark, sf_dir)
    return views.autolinks(parse_markdown(docs, types=["Autolink", "AutolinkLiteral"]), docs).select("doc_id", "kind", "address")


@query("SELECT c_custkey AS doc_id, 'w' AS target FROM customer")
def md_wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _notes(spark, sf_dir)
    return views.wiki_links(parse_markdown(docs, types=["WikiLink"]), docs).select("doc_id", "target")


@query("SELECT n_nationkey, CAST(0 AS INTEGER) AS opener, CAST(1 AS INTEGER) AS closer, n_nationkey % 2 = 0 AS strong FROM nation")
def md_delimiter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_nationkey") % 2 == 0, 2).otherwise(1)
    run = lambda before, after: F.struct(F.lit("*").alias("marker"), size.alias("length"), F.lit(before).alias("before"), F.lit(after).alias("after"))
    n = corpus.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(t.pairs(F.array(run("", "a"), run("a", "")))).alias("p"))
    return n.select("n_nationkey", "p.opener", "p.closer", "p.strong")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS can_open, n_nationkey % 2 = 1 AS can_close FROM nation")
def md_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("n_nationkey") % 2 == 0
    c = t.classify(F.lit("*"), F.when(even, " ").otherwise("a"), F.when(even, "a").otherwise(" "))
    return corpus.table(spark, sf_dir, "nation").select("n_nationkey", c.alias("c")).select("n_nationkey", "c.can_open", "c.can_close")


# ---- scalar functions


@query("SELECT p_partkey, p_name || ' & < A *' AS decoded, lower(trim(p_name)) AS label_key, '/p%20' || p_partkey || '?a=1&amp;b' AS href FROM part")
def fn_cooked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        t.decode(F.concat("p_name", F.lit(" &amp; &lt; &#65; \\*"))).alias("decoded"),
        t.normalize_label(F.concat(F.lit(" \n"), F.upper("p_name"), F.lit("\t"))).alias("label_key"),
        t.encode_href(F.concat(F.lit("/p "), "p_partkey", F.lit("?a=1&b"))).alias("href"),
    )


@query("SELECT p_partkey, p_brand || ' A' AS title, '/u v' AS destination, '<b' || chr(10) || 'c>' AS html FROM part")
def fn_titles_and_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    return p.select("p_partkey", t.title(F.concat(F.lit('"'), "p_brand", F.lit(' &#65;"'))).alias("title"), t.destination(F.lit("</u v>")).alias("destination"), t.html_inline(F.lit("<b\n   c>")).alias("html"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def fn_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", t.escape_html(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CAST(false AS BOOLEAN) AS plain, true AS cjk FROM documents")
def fn_has_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("doc_id", t.has_cjk(F.lit("é a")).alias("plain"), t.has_cjk(F.concat(F.substring("text", 1, 1), F.lit("漢"))).alias("cjk"))


@query("SELECT n_nationkey, '<input checked=\"\" disabled=\"\" type=\"checkbox\" />' || n_name AS html FROM nation")
def fn_canonical_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('<input type="checkbox" disabled="" checked="" />'), "n_name")
    return corpus.table(spark, sf_dir, "nation").select("n_nationkey", t.canonical_inputs(raw).alias("html"))


# ---- sinks


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, '<ul>' || chr(10) || string_agg('<li><input type=\"checkbox\" disabled=\"\"' || CASE WHEN c_acctbal > 0 THEN ' checked=\"\"' ELSE '' END || ' /> ' || c_name || '</li>' || chr(10), '' ORDER BY c_custkey) || '</ul>' || chr(10) AS html FROM customer GROUP BY c_nationkey")
def md_html_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_html(corpus.customer_checklists(spark, sf_dir))


@query("SELECT event_id AS doc_id, '<pre><code class=\"language-' || event_type || '\">' || replace(replace(replace(replace(coalesce(props, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || chr(10) || '</code></pre>' || chr(10) AS html FROM events")
def md_html_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_html(corpus.event_logs(spark, sf_dir))


@query("SELECT event_id AS doc_id, '[code{\"' || event_type || '\"}{\"user=' || user_id || '\"}{' || to_json(coalesce(props, '')) || '},]' AS signature FROM events")
def md_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(corpus.event_logs(spark, sf_dir))


@query("SELECT count(*) AS docs, count(DISTINCT text) AS kinds FROM documents")
def md_structural_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by signature; under the CommonMark preset a text with no markup is its own structure."""
    docs = _prose(spark, sf_dir).withColumn("text", F.concat(F.lit("~~~\n"), "text", F.lit("\n~~~")))
    return signatures(docs, Constructs.commonmark()).agg(F.count("*").alias("docs"), F.count_distinct("signature").alias("kinds"))


# ---- verification


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS node_id, '' AS rule WHERE false")
def check_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No broken span in prose or in random token soup."""
    docs = _prose(spark, sf_dir).unionByName(corpus.token_soup(spark, 3000).withColumn("doc_id", F.col("doc_id") + 10**12))
    return invariants.broken_spans(_parsed(docs), docs)


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS ord WHERE false")
def check_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _prose(spark, sf_dir).unionByName(corpus.token_soup(spark, 3000).withColumn("doc_id", F.col("doc_id") + 10**12))
    return invariants.broken_blanks(blank_lines(docs), docs)


@query("SELECT CAST(event_type AS VARCHAR) AS section, count(*) AS total, CAST(sum(CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_failed FROM events GROUP BY event_type")
def check_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("section"), F.col("event_id").alias("example"), (F.col("event_id") % 50 != 0).alias("passed"))
    return invariants.suite_summary(e).select("section", "total", "passed", F.size("failed").alias("n_failed"))


@query()
def check_token_soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_soup(spark, 5000)
