"""Streams with late, repeated and replaced rows against tables, and a restart from the checkpoint."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mdloom.functions import lexical as lx
from mdloom.streaming import state
from mdloom.streaming.parse import counts_by_window

T0 = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """A folder that files are put into one after another, read as a stream, a file a batch."""

    class Folder:
        path, n = f"{tmp_path}/in", 0

        def put(self, rows, schema):
            self.schema = schema
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    return Folder()


def minutes(*at):
    return [T0 + timedelta(minutes=m) for m in at]


def test_sessions_take_late_rows_in_and_drop_those_behind_the_watermark(spark, folder):
    schema = "user_id long, ts timestamp"
    folder.put([(1, t) for t in minutes(0, 10, 60)] + [(2, T0)], schema)
    folder.put([(1, t) for t in minutes(35)], schema)  # late, within the watermark: joins two sessions
    folder.put([(1, t) for t in minutes(600)], schema)
    folder.put([(1, t) for t in minutes(601)], schema)  # rows are held against the watermark of the batch before theirs
    folder.put([(2, t) for t in minutes(5)], schema)  # behind it by now
    out = state.run_to_end(state.sessions(folder.stream(), ["user_id"], "ts", "30 minutes", "1 hour"), "s")
    got = Counter((r.user_id, r.started, r.ended, r.n) for r in out.collect())
    t = minutes(0, 30, 90)
    assert got == Counter([(1, t[0], t[2], 4), (2, t[0], t[1], 1)])  # the last session may still grow


def test_sessions_of_a_stream_equal_those_of_a_table(spark, folder):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), T0 + timedelta(minutes=rng.randint(0, 3000))) for _ in range(300)]
    for part in (rows[:100], rows[100:200], rows[200:]):
        folder.put(part, "user_id long, ts timestamp")
    stream = state.run_to_end(state.sessions(folder.stream(), ["user_id"], "ts", "30 minutes", "10000 minutes"), "s", "complete")
    batch = state.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp"), ["user_id"], "ts", "30 minutes")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_repeats_go_and_a_restart_counts_nothing_twice(spark, folder, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    check = f"{tmp_path}/checkpoint"
    folder.put([(1, "a", T0), (2, "b", T0), (1, "a", T0 + timedelta(minutes=1))], schema)
    one = state.run_to_end(state.without_repeats(folder.stream(), ["doc_id", "text"], "ts"), "r", folder=check)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter([(1, "a"), (2, "b")])
    folder.put([(2, "b", T0 + timedelta(minutes=9)), (2, "c", T0)], schema)
    two = state.run_to_end(state.without_repeats(folder.stream(), ["doc_id", "text"], "ts"), "r", folder=check)
    assert Counter((r.doc_id, r.text) for r in two.collect()) == Counter([(1, "a"), (2, "b"), (2, "c")])


def test_label_counts_follow_the_newest_versions(spark, folder, tmp_path):
    schema = "doc_id long, version long, text string, deleted boolean"
    rng, check = random.Random(2), f"{tmp_path}/checkpoint"
    texts = ["# a\n- b\n- c", "> q\n\ntext", "", None, "~~~\nx\n~~~", "# a\n# b"]
    rows = [(rng.randint(0, 9), rng.randint(1, 8), rng.choice(texts), rng.random() < 0.15) for _ in range(120)]
    rows = list({(d, v): (d, v, t, x) for d, v, t, x in rows}.values())
    for part in (rows[:40], rows[40:] + rows[:5]):  # older versions after newer ones, and rows that come again
        folder.put(part, schema)
        stream = state.label_changes(folder.stream())
        deltas = state.run_to_end(stream, "labels", folder=check, **state.PROVIDER).collect()
    total = Counter()
    for r in deltas:
        total[r.label] += r.delta
    newest = {d: (v, t, x) for d, v, t, x in sorted(rows, key=lambda r: r[:2])}
    docs = spark.createDataFrame([(d, "" if x else t, x) for d, (v, t, x) in newest.items()], "doc_id long, text string, deleted boolean")
    kinds = docs.where("not deleted").select(F.explode(lx.split_lines(F.coalesce("text", F.lit("")))).alias("line"))
    want = kinds.groupBy(F.coalesce(lx.line_start(F.col("line"), F.lit(False)), F.lit("Text")).alias("label")).count()
    assert {k: n for k, n in total.items() if n} == {r.label: r["count"] for r in want.collect()}


def test_counts_by_window(spark, folder):
    folder.put([(T0, "# a\nb"), (T0 + timedelta(minutes=61), "- c")], "ts timestamp, text string")
    out = state.run_to_end(counts_by_window(folder.stream(), "ts"), "w", "complete")
    assert {(r.window.start, r.kind, r.n) for r in out.collect()} == {(T0, "AtxHeading", 1), (T0, None, 1), (T0 + timedelta(hours=1), "ListItem", 1)}
