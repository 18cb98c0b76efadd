"""What a row costs: values are worked out once, and results are those of the plain way."""

import gc
import random
import tracemalloc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from mdloom.functions import lexical as lx
from mdloom.functions import soup
from mdloom.kernel import parse as parse_text
from mdloom.operators.parse import rows
from mdloom.plans.queries import QUERIES
from mdloom.plans.relational import check_suite_run, lex_switches
from mdloom.sources.datasource import SuiteReader

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _cells(line: str) -> list[str]:
    """Cells by going through a row's characters."""
    row = line.strip(" \t").removeprefix("|")
    cells, i = [""], 0
    while i < len(row):
        if row[i] == "|":
            cells.append("")
        else:
            step = 2 if row[i] == "\\" else 1
            cells[-1] += row[i : i + step]
            i += step - 1
        i += 1
    cells = [c.strip(" \t") for c in cells]
    return cells if cells[-1] else cells[:-1]


def test_cells_and_widths_of_odd_rows(spark):
    rng = random.Random(7)
    lines = ["", "|", "||", "\u0001|a", "a\u0002b|c", "\\", "|\\", "a\\|", "| a\\| |", "a\\\\|b"] + ["".join(rng.choice("|\\ a\t\u0001\u0002é") for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", lx.table_cells(F.col("line")).alias("cells"), lx.table_width(F.col("line")).alias("width")).collect():
        assert r.cells == _cells(r.line), r
        assert r.width == len(r.cells), r


def test_delimiters_count_as_their_alignments(spark):
    rng = random.Random(8)
    lines = ["|", "-", "-|", "|-", "|-|", "||", "- -", ":-:|:|-"] + ["".join(rng.choice("|-:- ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(x, "|".join("a" * rng.randrange(1, 4))) for x in lines], "rule string, head string")
    plain = F.coalesce(F.size(lx.table_alignments(F.col("rule"))) == F.size(lx.table_cells(F.col("head"))), F.lit(False)) & ~lx.is_deep(F.col("rule"))
    assert df.where(plain != lx.table_delimiter_activates(F.col("head"), F.col("rule"))).count() == 0
    assert df.where(plain).count() > 5


def test_table_rows_are_cut_once(spark):
    """the cells of a row, for all columns that read them."""
    plan = _plan(QUERIES["lex_table_rows"](spark, SF))
    assert plan.count("regexp_extract_all(") + plan.count("split(") <= 2  # as far as the last cell but one


def test_a_draw_is_worked_out_once(spark):
    """the expression of a draw does not double with every step."""
    df = spark.range(5).select(soup.below(F.col("id"), F.col("id") + 1, 93).alias("x"))
    assert len(_plan(df)) < 5000


def test_switches_share_the_tests_of_a_line(spark):
    """lines are tested once, not once a switch and class."""
    assert _plan(lex_switches(spark, SF)).count("RLIKE") < 40


def test_tests_of_a_line_give_what_it_starts(spark):
    lines = ["", "> a", "---", "# a", "```", "<div>", "<!-- a", "$$", "{% a %}", "{% a %} b", "{{ a", ":::a", ":::", "[^a]: b", "- a", "| a |", "    a", "\ta", "a"]
    df = spark.createDataFrame([(x, p) for x in lines for p in (True, False)], "line string, p boolean")
    for on in (None, lx.options(), lx.Constructs.commonmark()):
        two = df.select("line", lx.line_start(F.col("line"), F.col("p"), on).alias("a"), lx.tests_start(lx.tail_tests(lx.flow_tail(F.col("line")), F.col("p")), on).alias("b"))
        assert two.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_a_task_lets_go_of_a_tree_before_the_next(monkeypatch):
    """trees and rows of one checklist at a time, not of two."""
    from mdloom.kernel.blocks import Blocks
    from mdloom.operators import parse

    alive = weakref.WeakSet()

    class Watched(Blocks):
        def __init__(self, *a):
            gc.collect()
            most.append(len(alive))
            super().__init__(*a)
            alive.add(self)

    most = []
    text = "".join(f"* [x] item {i}\n" for i in range(50)).encode()
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([text] * 3, pa.binary())], ["doc_id", "source"])
    monkeypatch.setattr("mdloom.kernel.Blocks", Watched)
    run = []
    monkeypatch.setattr(parse, "_source", lambda *a: type("S", (), {"mapInArrow": lambda self, f, _: run.append(f)})())
    parse.blank_lines(None)
    list(run[0]([batch]))
    assert most == [0, 0, 0]


def test_rows_of_trees_without_a_list_of_all_nodes():
    source = "".join(f"* [x] item {i}\n" for i in range(20_000)).encode()
    root = parse_text(source, None, False)[0]
    tracemalloc.start()
    n = sum(1 for _ in rows(1, root, frozenset(["ListItem"])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000
    assert most < 1 << 20, most


def test_a_suite_is_read_and_rendered_in_one_pass(spark):
    """what examples expect comes along through the rendering; no second read, no join."""
    plan = _plan(check_suite_run(spark, SF))
    assert plan.count("RelationV2") == 1 and "Join" not in plan
    assert SuiteReader({"path": "."}).most >= 1000  # a task for a few examples costs more than they do
