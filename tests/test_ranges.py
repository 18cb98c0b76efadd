"""Interval joins and texts of spans against plain versions, their plans, and one document with 100,000 cells."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mdloom.operators import views
from mdloom.operators.parse import parse_markdown
from mdloom.operators.ranges import cover, interval_join, span_texts


def test_covers_are_exact_and_small(spark):
    rng = random.Random(1)
    pairs = [(a, b) for a in range(-9, 17) for b in range(a, 17)] + [tuple(sorted((rng.randint(0, 10**6), rng.randint(0, 10**6)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b"), 21).alias("c")).collect()
    for r in got:
        ranges = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r.c)
        assert sum(hi - lo for lo, hi in ranges) == r.b - r.a and len(ranges) <= 2 * max(1, (r.b - r.a).bit_length())
        assert all(x[1] == y[0] for x, y in zip(ranges, ranges[1:])) and (not ranges or (ranges[0][0], ranges[-1][1]) == (r.a, r.b))


@pytest.mark.parametrize("longest", [None, 1000])
def test_interval_join(spark, longest):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randint(-20, 200)) for _ in range(300)] + [("a", None), (None, 5), ("c", 7)]
    spans = [(rng.choice("ab"), i, s, s + rng.choice([0, 1, 2, 3, 40, 150])) for i, s in enumerate(rng.randint(-20, 190) for _ in range(200))]
    spans += [("a", 900, None, 4), ("a", 901, 4, None), (None, 902, 0, 9), ("a", 903, 9, 2)]
    got = interval_join(spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(spans, "k string, i int, lo int, hi int"), ["k"], "at", "lo", "hi", longest)
    want = Counter((k, at, i) for k, at in points for q, i, lo, hi in spans if None not in (k, at, lo, hi) and k == q and lo <= at < hi)
    assert Counter((r.k, r.at, r.i) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    condition = plan[plan.index("Join Inner") :].split("\n")[0]
    assert "<" not in condition and ">" not in condition
    none = interval_join(spark.createDataFrame(points, "k string, at int"), spark.createDataFrame([], "k string, i int, lo int, hi int"), ["k"], "at", "lo", "hi")
    assert none.count() == 0


@pytest.mark.parametrize("piece", [4, 7, 4096])
def test_texts_of_spans(spark, piece):
    rng = random.Random(3)
    texts = {1: "é漢a" * 30, 2: "", 3: None, 4: "x" * 50, None: "null id"}
    spans = []
    for i in range(200):
        d = rng.choice([1, 4])
        raw = texts[d].encode()
        a, b = sorted((rng.randint(0, len(raw)), rng.randint(0, len(raw))))
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        spans.append((d, i, a, max(a, b)))
    spans += [(2, 900, 0, 0), (3, 901, 0, 0), (77, 902, 0, 1)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.i: r.slice for r in span_texts(spark.createDataFrame(spans, "doc_id long, i int, start long, end long"), docs, piece=piece).collect()}
    assert got == {i: texts[d].encode()[a:b].decode() for d, i, a, b in spans if texts.get(d) is not None}


def test_plain_text_of_nested_nodes(spark):
    text = "> a *b **c*** `d\n> e` $$\n> x$$ <b\n> c> &amp; <http://u.v> [[w]]\n>\n> - {{ l }}\n> - [k](/u)\n"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    nodes = parse_markdown(docs)
    got = {r.node_id: r.content for r in views.plain_text(nodes, docs, "Root", "Paragraph", "Strong", "Emphasis").where("doc_id = 1").collect()}
    kinds = {r.node_id: r.type for r in nodes.where("doc_id = 1").collect()}
    by = {}
    for i, content in got.items():
        by.setdefault(kinds[i], []).append(content)
    assert by["Strong"] == ["c"] and by["Emphasis"] == ["b c"]
    first = "a b c d\ne \nx <b\nc> & http://u.v w"
    assert sorted(by["Paragraph"]) == sorted([first, "k"])
    assert by["Root"] == [first + "{{ l }}k"]


def test_a_document_of_100_000_cells(spark):
    text = "| a | b | c | d |\n| - | - | - | - |\n" + "".join(f"| {i} | x | *y* | z |\n" for i in range(25_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from mdloom.sources.store import stored

    nodes = stored(parse_markdown(docs), "nodes")
    began = time.time()
    cells = views.table_cells(nodes, docs).groupBy("col").agg(F.count("*").alias("n"), F.countDistinct("content").alias("kinds")).collect()
    assert {(r.col, r.n, r.kinds) for r in cells} == {(0, 25_001, 25_001), (1, 25_001, 2), (2, 25_001, 2), (3, 25_001, 2)}
    assert time.time() - began < 60
