"""Rows that fail, kill their process, hang or take too much memory leave the others, and the job, alone."""

import os
import signal
import time

import pytest
from pyspark.sql import functions as F

from mdloom.operators import resolve, views
from mdloom.operators.guard import attempts, guarded, keyed, node_rows, parse_guarded, with_source_id
from mdloom.operators.parse import parse_markdown


def work(doc_id, source):
    if source == b"raise":
        raise ValueError("planted é" * 200)
    if source == b"exit":
        raise SystemExit(3)
    if source == b"die":
        os.kill(os.getpid(), signal.SIGKILL)
    if source == b"leave":
        os._exit(7)
    if source == b"hang":
        time.sleep(60)
    if source == b"memory":
        return [(doc_id, len(bytearray(1 << 31)))]
    return [(doc_id, len(source))] * 2


BAD = {3: "raise", 4: "die", 90: "leave", 91: "hang", 92: "memory", 199: "die", 150: "exit"}
WHY = {"raise": "exception", "exit": "exception", "die": "crash", "leave": "crash", "hang": "timeout", "memory": "memory"}


@pytest.mark.parametrize("bad", [BAD, {i: "die" for i in range(200)}, {}, {0: "die"}])
def test_every_row_is_answered_once(bad):
    rows = [(i, bad.get(i, "x" * i).encode()) for i in range(200)]
    answered = {}
    for row, out, why in attempts(rows, work, seconds=0.7, memory_mb=512):
        assert row[0] not in answered
        answered[row[0]] = (out, why)
    assert set(answered) == set(range(200))
    for i, (out, why) in answered.items():
        if i in bad:
            assert out is None and why[0] == WHY[bad[i]]
        else:
            assert out == [(i, i)] * 2 and why is None


def test_the_job_lives(spark):
    rows = [(i, BAD.get(i, "x" * i), "clash") for i in range(300)] + [(None, None, None), (None, "raise", None), (5, "x" * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dead string").repartition(3)
    out = guarded(docs, work, "doc_id bigint, n bigint", seconds=0.7, memory_mb=512)
    dead = sorted(((r.doc_id, r.reason, r.error, len(r.message) <= 500, r.n_bytes) for r in out.dead.collect()), key=str)
    kinds = {"raise": "ValueError", "exit": "SystemExit", "memory": "MemoryError", "hang": "TimeoutError"}
    want = [(i, WHY[t], kinds.get(t, "ChildProcessError"), True, len(t)) for i, t in [*BAD.items(), (None, "raise")]]
    assert dead == sorted(want, key=str)
    good = [(i, i) for i in range(300) if i not in BAD] * 2 + [(None, 0), (5, 5)] * 2
    assert sorted(map(tuple, out.results.collect()), key=str) == sorted(good, key=str)
    nothing = guarded(docs.limit(0), work, "doc_id bigint, n bigint")
    assert nothing.results.count() == 0 and nothing.dead.count() == 0


def test_guarded_nodes_equal_the_plain_ones(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["# a\n\n*b*", "", None, "| a |\n| - |\n| é |", "- [x] y"] * 5)], "doc_id long, text string")
    out = parse_guarded(docs)
    maps = [F.map_entries(c).alias(c) for c in ("spans", "segments")]
    rest = [c for c in out.results.columns if c not in ("spans", "segments")]
    assert sorted(map(str, out.results.select(*rest, *maps).collect())) == sorted(map(str, parse_markdown(docs).select(*rest, *maps).collect()))
    assert out.dead.count() == 0
    assert len(node_rows(1, b"a" * 50, max_doc_bytes=10)) == 1


def test_rows_with_one_id_or_none_do_not_mix(spark):
    rows = [(1, "[a]\n\n[a]: /one"), (1, "[a]\n\n[a]: /two"), (None, "[b]\n\n[b]: /three"), (None, "# [c]"), (1, "[a]\n\n[a]: /one")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    nodes = parse_guarded(docs).results
    links = with_source_id(resolve.links(nodes, docs), docs)
    assert sorted(((r.source_id, r.url) for r in links.collect()), key=str) == sorted([(1, "/one"), (1, "/two"), (None, "/three"), (1, "/one")], key=str)
    heads = with_source_id(views.headings(nodes, docs), docs).collect()
    assert [(r.source_id, r.content) for r in heads] == [(None, "[c]")]
