import random

from pyspark.sql import functions as F

from mdloom.operators import views
from mdloom.operators.parse import parse_cells, parse_markdown
from mdloom.plans import queries
from mdloom.sources import corpus
from mdloom.sources.store import stored


def test_cells_of_the_parse_are_those_of_the_view(spark):
    rng = random.Random(6)
    tokens = [t for t in corpus.WIDE if "\n" not in t and "\r" not in t]
    cell = lambda: " ".join(rng.choice(tokens) for _ in range(rng.randint(0, 5))).replace("|", "")
    row = lambda n: "| " + " | ".join(cell() for _ in range(n)) + " |"
    data = [(0, None), (1, "# no table"), (2, "| a \\| b | `c \\| d` |\n|-|:-:|\n| &amp; \\* |\n| *x **y*** | ![i](u) [[w]] <http://x.y> | z |\n\ntext\n\n> | q |\n> |--:|\n> | $m$ www.a.b |")]
    for k in range(3, 120):
        n = rng.randint(1, 4)
        data.append((k, "\n".join([*(["> text\n"] if k % 3 else []), row(n), "|" + "|".join(rng.choice(["-", ":-", ":-:", "-:"]) for _ in range(n)) + "|", *(row(rng.randint(1, 5)) for _ in range(3))])))
    docs = stored(spark.createDataFrame(data, "doc_id long, text string"), "docs")
    want = views.table_cells(stored(parse_markdown(docs), "nodes"), docs)
    got = parse_cells(docs)
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in want.columns)).collect())) for df in (got, want))
    assert not set(a) ^ set(b) and a == b and len(a) > 500
    assert parse_cells(docs, max_doc_bytes=10).count() == 0


def test_order_tables_join_nothing(spark):
    plan = queries.md_order_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
