"""States of lines against the block parser on texts without containers, long lines, and the cap on footnote labels."""

import random

import pytest
from pyspark.sql import functions as F

from mdloom.functions import lexical as lx
from mdloom.kernel.blocks import Blocks, Cursor
from mdloom.kernel.constructs import Constructs
from mdloom.operators.linestates import line_states

PIECES = ["", "", "a", "b c", "===", "---", "----- ", "# h", "```", "````", "``` x", "~~~", "~~~~ y", "```` ", "    deep", "   b", "\tt", "<div>", "</div>", "<pre>", "x </pre>", "<!-- c", "-->", "<?p", "?>", "<!X", "y >",
          "<![CDATA[", "]]>", "<a>", "</a> ", "| a | b |", "| - | - |", "|-|", ":-:", "a | b", "-|-", "$$", "$$$", "$$ m", "* * *", "{{ v }}", "{% t %} z", "<script>", "</script>", "  ```", "    ```", "<b x=1 y>", " | q"]
KINDS = {"html": "html", "indented": "code", "table": "table", "paragraph": "paragraph"}


def expected(text):
    """What the block parser has open before each line."""
    raw, blocks, out, at = text.encode(), Blocks(text.encode(), Constructs()), [], 0
    parse_line = blocks.line

    def spy(cur):
        leaf = blocks.leaf
        if leaf is None:
            out.append("none")
        elif leaf.kind == "fence":
            out.append("math" if leaf.extra[0] == b"$" else "fence")
        else:
            out.append(KINDS[leaf.kind] + (str(leaf.extra) if leaf.kind == "html" else ""))
        parse_line(cur)

    blocks.line = spy
    blocks.parse()
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_states_equal_the_block_parser(spark, block):
    rng = random.Random(block)
    ends = ["\n", "\n", "\n", "\r\n", "\r"]
    texts = ["".join(rng.choice(PIECES) + rng.choice(ends) for _ in range(rng.randint(0, 30))) + rng.choice(["", "last"]) for _ in range(600)]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(9999, None, None)], "doc_id long, text string, lines string").repartition(4)
    got = {}
    for r in line_states(docs, block=block).collect():
        got.setdefault(r.doc_id, {})[r.place] = r.open
    assert 9999 not in got
    for i, text in enumerate(texts):
        assert [got.get(i, {}).get(k) for k in range(len(got.get(i, {})))] == expected(text), text


def test_constructs_switch_states(spark):
    docs = spark.createDataFrame([(1, "$$\na\n<div>\nb\n\n| a |\n| - |\n| c |")], "doc_id long, text string")
    got = [r.open for r in line_states(docs, Constructs.commonmark()).orderBy("place").collect()]
    assert got == ["none", "paragraph", "paragraph", "html6", "html6", "none", "paragraph", "paragraph"]


def test_one_long_text_and_none(spark):
    text = "```\n" + "x\n# y\n" * 100_000 + "```\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r.open, r.starts): r["count"] for r in line_states(docs).groupBy("open", "starts").count().collect()}
    assert got == {("none", "CodeFence"): 1, ("fence", None): 200_001, ("none", None): 1}
    assert line_states(docs.limit(0)).count() == 0


def test_footnote_labels_have_a_longest_length(spark):
    rows = [("[^" + "a" * n + "]: x", n <= 999) for n in (1, 998, 999, 1000, 1100)] + [("[^" + "é" * n + "]: x", n <= 499) for n in (499, 500)]
    rows += [("[^" + "\\]" * n + "]: x", n <= 499) for n in (499, 500)]
    df = spark.createDataFrame(rows, "line string, fine boolean")
    for r in df.select("line", "fine", lx.line_start(F.col("line"), F.lit(False)).alias("kind"), lx.is_container(F.col("line")).alias("container")).collect():
        assert (r.kind == "FootnoteDefinition", r.container) == (r.fine, r.fine), r.line[:20]


def test_long_lines(spark):
    n = 300_000
    rows = [("- " * n, "ThematicBreak"), ("[^" + "a" * n + "]:", None), ("|-" * n, "TableRow"), ("<a" + " b=c" * n + ">", "HtmlBlock"), ("`" * n, "CodeFence"), ("<a" + " b='" * n, None), ("|" + "\\|" * n, "TableRow")]
    df = spark.createDataFrame(rows, "line string, kind string")
    for r in df.select("kind", lx.line_start(F.col("line"), F.lit(False)).alias("got"), F.size(lx.table_cells(F.col("line")))).collect():
        assert r.got == r.kind


def test_columns_are_stripped_like_the_cursor(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice(" \t") for _ in range(rng.randint(0, 6))) + rng.choice(["", "x y", "é\t"]), rng.randint(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "line string, n int")
    for r in df.select("line", "n", lx.strip_columns(F.col("line"), F.col("n")).alias("x")).collect():
        cur = Cursor(r.line.encode(), 0)
        cur.skip(r.n)
        assert (r.x.rest, r.x.padding) == (cur.tail().decode(), cur.pad), (r.line, r.n)
    assert df.select(lx.strip_columns(F.lit("\t\tx"), 6).alias("x")).first().x == ("x", 2)
