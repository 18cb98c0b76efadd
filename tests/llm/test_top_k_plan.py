import random

from mdloom.llm import top_k


def test_blocks_are_narrow_and_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    vectors = top_k.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    packed, _ = top_k._packed(vectors, 100, "narrow", True)
    assert {(r.width, len(r.values) // r.n) for r in packed.collect()} == {(1, 8)}
    found = top_k.search(vectors, vectors.where("vec_id % 20 = 0"), 5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    ints = {r.vec_id: r.v for r in vectors.collect()}
    want = {q: sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5] for q in ints if q % 20 == 0}
    got = {(r.query_id, r.rank): (-r.score, r.vec_id) for r in found.collect()}
    assert got == {(q, k + 1): x for q, best in want.items() for k, x in enumerate(best)}
