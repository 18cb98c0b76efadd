"""What a Python worker holds while it encodes."""

import tracemalloc

import pyarrow as pa
import pytest

from mdloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_encoding_holds_a_small_part_of_a_batch_at_once():
    texts = pa.array([" ".join(f"word{(i * 7919 + j * 104729) % 5000} and" for j in range(200)) for i in range(2500)])  # some 6 MB
    encode = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode(texts.slice(0, 10))
    tracemalloc.start()
    ids, offsets = encode(texts)
    most = tracemalloc.get_traced_memory()[1] - ids.nbytes - offsets.nbytes
    tracemalloc.stop()
    assert most < 64 << 20, most


def test_batches_are_small_on_both_sides_of_python(spark):
    from mdloom.llm.common import modest

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        modest(spark)
        docs = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('x', 5000) AS text")  # 30 MB in one task
        size = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
        assert max(r.n for r in docs.mapInArrow(size, "n long").collect()) < 5 << 20
    finally:
        spark.conf.set(key, was)


def test_small_batches_are_put_together_where_copies_meet():
    from mdloom.llm.jaccard import gathered

    batches = [pa.record_batch([pa.array(range(k, k + 10)), pa.array(["x" * 90] * 10)], ["node", "text"]) for k in range(0, 100, 10)]
    whole = list(gathered(iter([*batches, batches[0].slice(0, 0)]), 5000))
    assert [n for b in whole for n in b.column(0).to_pylist()] == list(range(100))
    assert len(whole) == 3 and max(b.nbytes for b in whole) <= 5000
    assert list(gathered(iter([]), 5000)) == []
