from mdloom.operators import views
from mdloom.operators.parse import parse_markdown
from mdloom.sources.store import stored


def test_cells_of_tables_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"| a | b |\n| - | - |\n| {i} | x |\n") for i in range(30)], "doc_id long, text string")
    cells = views.table_cells(stored(parse_markdown(docs), "nodes"), docs)
    assert "BroadcastHashJoin" not in cells._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.content) for r in cells.where("row = 1 AND col = 0").collect()} == {(i, str(i)) for i in range(30)}
