"""The sources: planning by size and by examples, conditions taken over, streams, and suites in both formats."""

import json
import os

from pyspark.sql import functions as F

from mdloom.sources.datasource import Examples, FilesReader, SuiteReader, register


def put(folder, name, text, at=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    if at:
        os.utime(path, (at, at))
    return path


def test_files_are_read_by_partitions_of_size(spark, tmp_path):
    register(spark)
    for i in range(9):
        put(tmp_path, f"d{i % 2}/{i}.md", "é" * (10 * i))
    put(tmp_path, "_skipped.md", "x"), put(tmp_path, "other.rs", "x"), put(tmp_path, "bad.md", "")
    (tmp_path / "bad.md").write_bytes(b"a\xffb")
    df = spark.read.format("markdown_files").option("partitionBytes", 100).load(str(tmp_path))
    rows = {r.name: r for r in df.collect()}
    assert set(rows) == {f"{i}.md" for i in range(9)} | {"bad.md"} and rows["bad.md"].text == "a�b"
    assert all(rows[f"{i}.md"].text == "é" * (10 * i) and rows[f"{i}.md"].bytes == 20 * i for i in range(9))
    assert df.rdd.getNumPartitions() >= 5
    one = spark.read.format("markdown_files").load(str(tmp_path / "d1" / "3.md"))
    assert [r.name for r in one.collect()] == ["3.md"]


def test_conditions_are_taken_over(spark, tmp_path):
    register(spark)
    for i in range(5):
        put(tmp_path, f"{i}.md", "x" * i)
    df = spark.read.format("markdown_files").load(str(tmp_path)).where((F.col("bytes") >= 2) & F.col("name").isin("2.md", "3.md", "1.md") & (F.length("text") > 2))
    assert [r.name for r in df.collect()] == ["3.md"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    own = plan[plan.index("Filter") :].split("\n")[0]
    assert "text" in own and "bytes" not in own and "name" not in own

    from pyspark.sql.datasource import GreaterThan, StringStartsWith

    reader = FilesReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([GreaterThan(("bytes",), 2), StringStartsWith(("text",), "x")]))
    assert len(left) == 1 and [f[1] for p in reader.partitions() for f in p.files] == [3, 4]


def test_a_stream_takes_each_file_once_and_changed_ones_again(spark, tmp_path):
    register(spark)
    folder, check, out = tmp_path / "in", f"{tmp_path}/check", f"{tmp_path}/out"
    put(folder, "a.md", "one", 1000), put(folder, "b.md", "two", 1000)

    def run():
        stream = spark.readStream.format("markdown_files").load(str(folder)).select("name", "text")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    assert run() == [("a.md", "one"), ("b.md", "two")]
    put(folder, "b.md", "new", 2000), put(folder, "c.md", "three", 1500)
    assert run() == [("a.md", "one"), ("b.md", "new"), ("b.md", "two"), ("c.md", "three")]
    assert len(run()) == 4


def test_suites_are_split_by_examples(spark, tmp_path):
    register(spark)
    fence = "`" * 32
    text = "".join(f"# S{i // 7}\n\nprose `x`\n\n{fence} example\n→a{i}\n.\n\n.\n<p>{i}</p>\n{fence}\n\n" for i in range(25)) + f"{fence} example\n.\n{fence}\n"
    put(tmp_path, "spec.txt", text)
    reader = SuiteReader({"path": str(tmp_path), "partitionexamples": "4"})
    assert len(reader.partitions()) == 7 and all(isinstance(p, Examples) for p in reader.partitions())
    rows = spark.read.format("markdown_suite").option("partitionExamples", 4).load(str(tmp_path)).orderBy("example").collect()
    assert [(r.example, r.section, r.markdown, r.html) for r in rows[:25]] == [(i + 1, f"S{i // 7}", f"\ta{i}\n", f"\n.\n<p>{i}</p>\n") for i in range(25)]
    assert (rows[25].example, rows[25].markdown, rows[25].html) == (26, "", "")
    put(tmp_path / "j", "suite.json", json.dumps([{"example": 4, "section": "T", "markdown": "a\n", "html": "b"}]))
    assert [tuple(r)[1:] for r in spark.read.format("markdown_suite").load(str(tmp_path / "j")).collect()] == [(4, "T", "a\n", "b")]
