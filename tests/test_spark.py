"""The relational side: native classifier against the kernel, views, resolution, streams, and every registered query."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mdloom.functions import lexical as lx
from mdloom.functions import text as t
from mdloom.kernel.blocks import Blocks, Cursor
from mdloom.kernel.constructs import Constructs
from mdloom.operators import invariants, resolve, views
from mdloom.operators.parse import blank_lines, parse_markdown, render_html, signatures
from mdloom.plans.catalogue import QUERIES, SQL
from mdloom.plans.schema import NODES
from mdloom.sources import corpus
from mdloom.streaming.parse import parse_stream

NAMES = {"quote": "Blockquote", "setext": "SetextUnderline", "break": "ThematicBreak", "atx": "AtxHeading", "html": "HtmlBlock", "directive": "DirectiveOpener", "footnote": "FootnoteDefinition", "item": "ListItem", "delimiter": "TableDelimiterRow"}
SF = "/root/testdata/sf0.001"


def expected(line, para):
    c = Cursor(line.encode(), 0).flow()
    if not c:
        return None
    tail = c.tail()
    start = Blocks(b"", Constructs()).probe(tail, para)
    if start:
        if start[0] == "fence":
            return "MathFence" if start[1] == b"$" else "CodeFence"
        if start[0] == "liquid":
            end = tail.find({b"{%": b"%}", b"{{": b"}}"}[tail[:2]], 2)
            return None if end >= 0 and tail[end + 2 :].strip(b" \t") else "Liquid"
        return NAMES[start[0]]
    if tail.startswith(b":::") and not tail.strip(b" \t").strip(b":"):
        return "DirectiveCloser"
    return "TableRow" if tail.startswith(b"|") else None


def test_native_line_start_equals_the_kernel(spark):
    rng, tokens = random.Random(7), [x for x in corpus.TOKENS if "\n" not in x] + ["===", "::: ", "~~~", "<pre>", "<div ", "</a>", "[^n]:", ":-:", "12) ", "%}"]
    lines = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))) for _ in range(4000)]
    df = spark.createDataFrame([(x, p) for x in lines for p in (False, True)], "line string, para boolean")
    for r in df.select("line", "para", lx.line_start(F.col("line"), F.col("para")).alias("kind")).collect():
        assert r.kind == expected(r.line, r.para), (r.line, r.para)


def test_predicates(spark):
    row = spark.range(1).select(
        lx.split_lines(F.lit("a\r\nb\rc\n")).alias("lines"),
        lx.indent_columns(F.lit(" \tx")).alias("columns"),
        lx.is_blank(F.lit(" \u00a0")).alias("blank"),
        lx.fence_closes(F.lit("```` "), "`", 3).alias("closes"),
        lx.html_ends(F.lit("x --> y"), F.lit(2)).alias("ends"),
        lx.table_cells(F.lit("a \\| b | c |")).alias("cells"),
        lx.table_alignments(F.lit("|:-|-:|:-:|-")).alias("align"),
        lx.ordered_number(F.lit("007.")).alias("number"),
        t.span_slice(F.lit("é漢a"), F.lit(2), F.lit(5)).alias("slice"),
        t.segments_join(F.lit("ab\ncd"), F.expr("array(struct(0 as start, 2 as end, 0 as padding), struct(3 as start, 5 as end, 2 as padding))")).alias("joined"),
    ).first()
    assert tuple(row) == (["a", "b", "c"], 4, False, True, True, ["a \\| b", "c"], ["Left", "Right", "Center", "None"], 7, "漢", "ab\n  cd")


def test_nodes_blanks_and_options(spark):
    docs = spark.createDataFrame([(1, "# a\n\n- b\n"), (2, None), (3, "")], "doc_id long, text string")
    nodes = parse_markdown(docs)
    assert nodes.schema == spark.createDataFrame([], NODES).schema
    assert [(r.type, r.parent_id, r.subtree_end) for r in nodes.where("doc_id = 1").orderBy("node_id").collect()] == [
        ("Root", None, 7), ("Heading", 0, 3), ("Text", 1, 3), ("List", 0, 7), ("ListItem", 3, 7), ("Paragraph", 4, 7), ("Text", 5, 7)
    ]
    assert nodes.where("doc_id > 1").count() == 2 and blank_lines(docs).count() == 1
    assert parse_markdown(docs, inlines=False).where("type = 'Text'").count() == 0
    assert parse_markdown(docs, where=F.col("doc_id") == 1).select("doc_id").distinct().count() == 1
    assert parse_markdown(docs, max_doc_bytes=3).where("doc_id = 1").count() == 1
    assert parse_markdown(docs.limit(0)).count() == 0


def test_views_and_resolution(spark):
    text = "# A\n\n[x][k] [y][none] ![i *j*](</u v> \"t\")\n\n## B\n\n3. one\n4. two\n\n[k]: /first\n[K]: /second\n[z]: /unused\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    nodes = parse_markdown(docs).cache()
    assert [(r.level, r.path) for r in views.outline(nodes, docs).orderBy("node_id").collect()] == [(1, "A"), (2, "A / B")]
    assert [(r.type, r.url, r.title) for r in resolve.links(nodes, docs).orderBy("node_id").collect()] == [("Link", "/first", None), ("Image", "/u v", "t")]
    assert [r.label_key for r in resolve.unused_definitions(nodes, docs).collect()] == ["z"]
    assert [r.label_key for r in resolve.dangling_labels(nodes, docs).collect()] == ["none"]
    assert [(r.number, r.marker, r.tight) for r in views.list_items(nodes, docs).orderBy("node_id").collect()] == [(3, "3.", True), (4, "4.", True)]
    assert [r.content for r in views.plain_text(nodes, docs, "Image").collect()] == ["i j"]
    assert invariants.broken_spans(nodes, docs).count() == 0


def test_broken_spans_are_found(spark):
    docs = spark.createDataFrame([(1, "é *a*")], "doc_id long, text string")
    nodes = parse_markdown(docs)
    bad = nodes.withColumn("start", F.when(F.col("type") == "Emphasis", 1).otherwise(F.col("start")))
    assert {r.rule for r in invariants.broken_spans(bad, docs).collect()} >= {"bounds", "order"}


def test_stream_parses_like_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# t{i}\n\n- a\n") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = parse_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == parse_markdown(docs).count()


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\ny")
    assert [r.text for r in corpus.read_files(spark, str(tmp_path / "*.md")).collect()] == ["x\ny"]
    (tmp_path / "suite.json").write_text('[{"example": 1, "section": "S", "markdown": "a", "html": "<p>a</p>\\n"}]')
    assert [tuple(r) for r in corpus.read_suite_json(spark, str(tmp_path / "suite.json")).collect()] == [(1, "S", "a", "<p>a</p>\n")]
    fence = "`" * 32
    (tmp_path / "suite.txt").write_text(f"# T (extension)\n\n{fence} example\na→b\n.\n<p>c</p>\n{fence}\n")
    assert [tuple(r) for r in corpus.read_suite_text(spark, str(tmp_path / "suite.txt")).collect()] == [(1, "T (extension)", "a\tb\n", "<p>c</p>\n")]
    one, two = (sorted(map(tuple, corpus.token_soup(spark, 50, 3).collect())) for _ in range(2))
    assert one == two and len(set(one)) == 50


def test_render_and_signature_columns(spark):
    docs = spark.createDataFrame([(1, "*a*")], "doc_id long, text string")
    assert render_html(docs).first().html == "<p><em>a</em></p>\n" and signatures(docs).first().signature == '[p(em(t{"a"})),]'


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in SQL:
        return
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "part", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda v: int(v) if not isinstance(v, (bool, str, type(None))) and v == int(v) else v
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
