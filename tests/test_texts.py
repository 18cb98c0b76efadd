"""Texts of nodes by pieces of their documents, rows of a parse in turn, and rows of small files over many tasks."""

import shutil

from pyspark.sql import functions as F

from mdloom.kernel import parse
from mdloom.operators import parse as P
from mdloom.operators import invariants, ranges, resolve, views
from mdloom.plans import queries


def test_definitions_meet_pieces_of_their_document(spark):
    lines = [f"[é{i}]: </u/{i}> '{'ü' * 40}\n  {i}'" for i in range(400)]
    docs = spark.createDataFrame([(1, "\n".join(lines) + "\n\n[x][é7] [y][nö]\n"), (2, "[a]: /b\n"), (3, None)], "doc_id long, text string")
    nodes = P.parse_markdown(docs)
    found = resolve.definitions(nodes, docs)
    rows = {(r.doc_id, r.label_key): (r.url, r.title, r.def_ord) for r in found.collect()}
    assert rows == {**{(1, f"é{i}"): (f"/u/{i}", "ü" * 40 + f"\n{i}", 1) for i in range(400)}, (2, "a"): ("/b", None, 1)}
    assert [(r.doc_id, r.label_key) for r in resolve.dangling_labels(nodes, docs).collect()] == [(1, "nö")]


def test_named_texts_cut_characters_and_segments_anywhere(spark):
    text = "aé漢😀\nb" * 5
    raw = text.encode()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    seg = "array<struct<start: long, end: long, padding: int>>"
    given = [(1, 0, "x", [(0, len(raw), 0)], None), (1, 1, "y", [(0, 3, 0), (10, 12, 2)], []), (1, 2, "z", None, [(3, 3, 1)]), (2, 0, "gone", None, None)]
    rows = spark.createDataFrame(given, f"doc_id long, node_id int, k string, p {seg}, q {seg}")
    out = ranges.named_texts(rows, docs, {"a": F.col("p"), "b": F.col("q")}, piece=4).collect()
    two = raw[:3].decode() + "\n  " + raw[10:12].decode()
    assert sorted((r.node_id, r.k, r.a, r.b) for r in out) == [(0, "x", text, None), (1, "y", two, ""), (2, "z", None, " ")]


def test_rows_of_a_document_come_in_turn_and_by_type():
    root = parse(b"# a *b*\n\n- c\n- d\n")[0]
    every = P.flat(7, root)
    assert next(P.rows(7, root)) == every[0]
    assert list(P.rows(7, root, frozenset({"Text", "ListItem"}))) == [r for r in every if r[7] in ("Text", "ListItem")]
    assert [r[7] for r in P.flat(7, parse(b"# a *b*\n\nc\n", None, frozenset({"Heading"}))[0])] == ["Root", "Heading", "Text", "Emphasis", "Text", "Paragraph"]


def test_documents_of_a_small_table_are_dealt_over_tasks(spark, tmp_path):
    shutil.copy("/root/testdata/sf0.001/customer.parquet", tmp_path)
    notes = queries._notes(spark, str(tmp_path))
    assert notes.rdd.getNumPartitions() > 4
    assert views.autolinks(P.parse_markdown(notes, types=["Autolink"]), notes).where("address = 'u@e.com'").count() == notes.count()


def test_spans_meet_their_texts_once(spark):
    text = "a *b*\n\n~~~\nc\nd\n~~~\n"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "é")], "doc_id long, text string")
    nodes = P.parse_markdown(docs)
    assert invariants.broken_spans(nodes, docs).count() == 0
    first = (F.col("doc_id") == 2) & (F.col("type") == "CodeBlock")
    moved = F.transform_values("segments", lambda k, v: F.transform(v, lambda s: s.withField("end", s["end"] + 1)))
    bad = nodes.withColumn("segments", F.when(first, moved).otherwise(F.col("segments"))).withColumn("start", F.when((F.col("doc_id") == 3) & (F.col("type") == "Text"), 1).otherwise(F.col("start")).cast("long"))
    found = invariants.broken_spans(bad, docs)
    assert sorted((r.doc_id, r.rule) for r in found.collect()) == [(2, "ending"), (2, "ending"), (3, "bounds")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS raw#") == 1
