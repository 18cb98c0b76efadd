"""Differences, totals, tokens, sketches, variants and options by row, each against a plain version."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mdloom.functions import lexical as lx
from mdloom.functions import soup, variants
from mdloom.kernel.constructs import Constructs
from mdloom.operators import compare, sketches, totals
from mdloom.operators.parse import parse_markdown
from mdloom.sources import corpus


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, a string, b int")


def rows_of(rng, n):
    return [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for _ in range(n)]


def test_multiset_difference(spark):
    rng = random.Random(1)
    one, two = rows_of(rng, 60), rows_of(rng, 70)
    got = Counter({(r.k, r.a, r.b, r.change): r.n for r in compare.multiset_difference(table(spark, one), table(spark, two)).collect()})
    want = Counter({(*row, "removed"): n for row, n in (Counter(one) - Counter(two)).items()}) + Counter({(*row, "added"): n for row, n in (Counter(two) - Counter(one)).items()})
    assert got == want
    assert compare.multiset_difference(table(spark, []), table(spark, [])).count() == 0


def test_changes_name_the_fields(spark):
    before = [(1, "x", 1), (1, "x", 1), (2, "y", None), (None, "z", 3), (4, "same", 4), (5, "p", 1)]
    after = [(1, "x", 1), (2, "y", 5), (None, "z", 4), (9, "n", 1), (4, "same", 4), (5, None, 2)]
    got = {(r.k, r.change, tuple(r.fields)) for r in compare.changes(table(spark, before), table(spark, after), ["k"]).collect()}
    assert got == {(1, "removed", ()), (2, "changed", ("b",)), (None, "changed", ("b",)), (9, "added", ()), (5, "changed", ("a", "b"))}
    assert compare.changes(table(spark, before), table(spark, before), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["cube", "rollup", [["a"], ["k", "a"], []]])
def test_totals(spark, how):
    rows = rows_of(random.Random(2), 50)
    got = Counter({(r.k, r.a, r.level): (r.n, r.s) for r in totals.totals(table(spark, rows), ["k", "a"], {"n": F.count("*"), "s": F.sum("b")}, how).collect()})
    sets = {"cube": [("k", "a"), ("k",), ("a",), ()], "rollup": [("k", "a"), ("k",), ()]}.get(how) if isinstance(how, str) else how
    want = {}
    for s in sets:
        level = 2 * ("k" not in s) + ("a" not in s)
        for k, a, b in rows:
            n, total = want.get((k if "k" in s else None, a if "a" in s else None, level), (0, None))
            want[k if "k" in s else None, a if "a" in s else None, level] = (n + 1, total if b is None else (total or 0) + b)
    assert got == want


def mulberry32(seed):
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        x ^= (x + ((x ^ x >> 7) * (x | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (x ^ x >> 14) & 0xFFFFFFFF


def test_tokens_are_those_of_the_generator(spark):
    seeds = [0, 1, 2**32 - 1, 2**40 + 7, -3, *range(100, 160)]
    df = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", *(soup.draw(F.col("s"), n).alias(f"d{n}") for n in (1, 2, 5000)), soup.soup(F.col("s"), corpus.WIDE).alias("text"))
    for r in df.collect():
        draws = list(itertools.islice(mulberry32(r.s), 5000))
        assert (r.d1, r.d2, r.d5000) == (draws[0], draws[1], draws[4999])
        size = 2 + (draws[0] * 39 >> 32)
        assert r.text == "".join(corpus.WIDE[d * len(corpus.WIDE) >> 32] for d in draws[1 : size + 1])


def test_sketches_of_parts_answer_for_their_union(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xyz"), f"v{int(rng.paretovariate(0.3)) % 9000}", rng.randint(0, 10**6)) for _ in range(20_000)] + [("a", "x", None, None)]
    df = spark.createDataFrame(rows, "p string, q string, item string, size long")
    parts = sketches.sketched(df, ["p", "q"], "item", "size")
    for part, chosen in ((["p"], lambda r, x: r[0] == x.p), ([], lambda r, x: True)):
        for x in sketches.estimates(sketches.merged(parts, part), part).collect():
            own = [r for r in rows if chosen(r, x)]
            exact = len({r[2] for r in own} - {None})
            assert x.n == len(own) and abs(x.distinct - exact) <= 5 * sketches.DISTINCT_ERROR * exact
            sizes = sorted(r[3] for r in own if r[3] is not None)
            for got, rank in ((x.q50, 0.5), (x.q90, 0.9)):
                assert abs(sum(s <= got for s in sizes) / len(sizes) - rank) <= 3 * sketches.RANK_ERROR


def test_variants(spark):
    rows = [(1, '{"k":1,"u":{"i":[1,{"z":null}],"e":{}}}'), (2, "no json"), (3, None), (4, "7"), (5, "null"), (6, '{"a":{"b":{"c":{"d":{"e":1}}}}}')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", variants.parsed(F.col("j")).alias("v"))
    got = {(r.id, r.path, r.content) for r in variants.leaves(df, "v", ["id"]).collect()}
    assert {(1, "$.k", "1"), (1, "$.u.i[0]", "1"), (1, "$.u.i[1].z", None), (4, "$", "7"), (6, "$.a.b.c.d", '{"e":1}')} <= got and not {2, 3} & {g[0] for g in got}
    v = F.col("v")
    one = df.select("id", variants.at(v, "$.u.i[0]", "int").alias("a"), variants.at(v, "$.u.i", "int").alias("b"), variants.at(v, "$.no.thing").alias("c")).orderBy("id").collect()
    assert [(r.a, r.b, r.c) for r in one] == [(1, None, None)] + [(None,) * 3] * 5
    nodes = parse_markdown(spark.createDataFrame([(1, "## a")], "doc_id long, text string")).where("type = 'Heading'")
    made = nodes.select(variants.attributes(F.struct("*"), "level", "kind", "marker").alias("v")).select(variants.at(F.col("v"), "$.level", "int"), variants.at(F.col("v"), "$.kind"), variants.at(F.col("v"), "$.marker"))
    assert tuple(made.first()) == (2, "atx", None)


def test_each_row_has_its_own_options(spark):
    lines = [("$$ a", "math_flow", "MathFence"), ("<div>", "html_flow", "HtmlBlock"), ("{{ a }}", "liquid", "Liquid"), ("::: a", "container_directive", "DirectiveOpener"), ("[^a]: b", "gfm_footnote", "FootnoteDefinition"), ("| a", "gfm_table", "TableRow"), ("# a", "autolink", "AtxHeading")]
    df = spark.createDataFrame([(x, name, kind, on) for x, name, kind in lines for on in (True, False, None)], "line string, name string, kind string, choice boolean")
    names = {n for _, n, _ in lines}
    own = lx.options(**{n: F.when(F.col("name") == n, F.col("choice")).otherwise(True) for n in names})
    for r in df.select("*", lx.line_start(F.col("line"), F.lit(False), own).alias("got")).collect():
        assert r.got == (None if r.choice is False and r.kind != "AtxHeading" else r.kind), r
    with pytest.raises(ValueError):
        lx.options(no_such=F.lit(True))
    docs = spark.createDataFrame([(1, "$$\na\n$$", True), (2, "$$\na\n$$", False), (3, "$$\na\n$$", None)], "doc_id long, text string, math boolean")
    nodes = parse_markdown(docs, lx.options(Constructs.commonmark(), math_flow=F.col("math"))).where("depth = 1").collect()
    assert {(r.doc_id, r.type) for r in nodes} == {(1, "MathBlock"), (2, "Paragraph"), (3, "MathBlock")}
