"""What travels to verify a pair, and what large sets' sketches keep from it."""

import random

from mdloom.llm import jaccard


def _text(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(words))


def _known(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    return jaccard.sets(docs, docs.selectExpr("node AS doc"))


def test_sets_travel_in_fewer_bytes_than_their_hashes(spark):
    known = _known(spark, [_text(k, 3000) for k in range(3)])
    assert known.selectExpr("max(length(packed)) < 8 * min(n) AS less").first().less


def test_fine_sketches_part_large_sets_and_keep_links(spark):
    base = _text(0, 3000).split()
    near, far = base[:], _text(1, 3000)
    near[100:200] = [f"x{k}" for k in range(100)]
    short = " ".join(base[:2500])  # of another length, so one sketch is folded
    known = _known(spark, [" ".join(base), " ".join(near), far, short, "a b c d e f g", "a b c d e f g h"])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (2, 3), (4, 5), (0, 4)], "a long, b long")
    passed = {(r.a, r.b) for r in jaccard.likely(pairs, known).collect()}
    assert {(0, 1), (0, 2), (0, 3)} <= passed  # the short sketch is full, and parts nothing
    fine = jaccard.finer(pairs, known)
    assert {(r.a, r.b) for r in fine.collect()} == {(0, 1), (0, 3), (4, 5), (0, 4)}
    assert {(r.a, r.b) for r in jaccard.verified(pairs, known).collect()} == {(0, 1), (0, 3)}


def test_folded_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    import numpy as np

    draw = np.random.default_rng(5)
    for n, more in ((1025, 200), (2040, 300), (4000, 900), (9000, 4000)):
        x = draw.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.r_[x[: n - 1 - more // 9], draw.integers(0, 1 << 63, more).astype(np.uint64)]
        assert jaccard.apart(jaccard.fine_sketch(x), jaccard.fine_sketch(y)) <= len(np.setxor1d(x, y))
    assert jaccard.fine_sketch(x[:1024]) is None
