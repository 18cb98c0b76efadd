"""The pipeline's stages on a small corpus."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    prose = "Plain words of entry {} stand here in some order, and no other entry has number {} in them. "
    rows = [(i, "".join(prose.format(i * 7 + k, i * 11 + k) for k in range(6)), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, "$$$ ### !!! " * 9 + str(i), "en", "s", 0) for i in range(40)]
    rows.append((200, rows[3][1].replace("some", "any", 1), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows[:80]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        assert seen.columns == docs.columns, name
    kept = {r.doc_id for r in seen.collect()}
    assert kept == set(range(40))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept


def test_line_stage_takes_passages_from_the_second_on_and_keeps_short_lines(spark):
    passage, ordinary = " ".join(f"word{i}" for i in range(60)), "See also:"
    near, other = passage.replace("word7 ", "word8 "), "a line of just thirty-two letters"[:32]
    rows = [(i, f"own {i} text\n{x}\n{ordinary}") for i, x in enumerate([passage, passage, near, other, other])]
    rows += [(10 + i, f"{i}{i}{i} begins\nBoiler") for i in range(10)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    want = {0: rows[0][1], 1: f"own 1 text\n{ordinary}", 2: rows[2][1], 3: rows[3][1], 4: f"own 4 text\n{ordinary}", 10: rows[5][1]}
    want |= {10 + i: f"{i}{i}{i} begins" for i in range(1, 10)}
    assert {d: r.text for d, r in left.items()} == want
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_stages_pass_awkward_rows_and_columns_of_any_name(spark, tmp_path):
    prose = "Plain words of entry {} stand here in some order, and no other entry has number {} in them. "
    texts = [(i, "".join(prose.format(i * 7 + k, i * 11 + k) for k in range(6))) for i in range(30)]
    texts += [(None, texts[0][1]), (None, None), (50, None), (51, ""), (3, texts[3][1]), (3, texts[3][1]), (52, texts[4][1] + "\n" + texts[5][1])]
    names = ["spans", "n_removed", "n_dropped", "n_lines", "flags", "score", "component_id", "x", "quality", "_id", "_kept", "key"]
    docs = spark.createDataFrame([(d, t, *(f"{n} {d}" for n in names)) for d, t in texts], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, seen.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        out = stage(spark, seen, str(tmp_path))
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in out.collect()} <= {d for d, _ in texts}
            break
        out.write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        rows = seen.collect()
        assert seen.columns == docs.columns, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name
        assert {r.doc_id for r in rows} >= {1, 2} | set(range(6, 30)), name  # a copy of 0 has no id, and comes first
