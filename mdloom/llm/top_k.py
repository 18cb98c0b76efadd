"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks; a block keeps, for every dimension, its rows sorted by that component. For a
query, the lists are read in step from the end that its component's sign asks for; every row met is scored
in full, and reading stops once the bound (the product with the values now reached) is below the k-th best
score, so that no unread row can beat or tie it. The k-th score carries over from block to block. Queries come
in blocks too, and each pair of a query block and a group of vector blocks is one task's work.

Defined cases: null vectors and those with a null or non-finite component take no part, as query or
candidate; of vectors of unequal lengths the shorter is filled with zeros; rows with the query's own vec_id
are no candidates, repeated ones included; other repeated rows each take a rank; null vec_ids are candidates
but never queries; ties go to the smaller vec_id, nulls last; vectors with a component whose integer does not fit a long take no
part; products and sums are exact whatever their size, and a score beyond a long ranks as what it is and comes back
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, tidy

K = 20
SCALE = 64
BLOCK = 4096
QUERIES = 4096
FIRST_DEPTH = 8
#: Blocks keep their components in the narrowest of these that holds them all, else in 64 bits.
NARROW = (np.int8, np.int16, np.int32)
#: Bits of a limb: scores leave Python as three longs, the highest first.
LIMB = 63
MASK = (1 << LIMB) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * float(SCALE)) < float(2**63)))
    return vectors.where(F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")).alias("v")
    )


def _packed(vectors: DataFrame, size: int, name: str, lists: bool) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, numbered from 0, as a stored table; the number of blocks."""
    count = -(-vectors.count() // size)

    def run(batches):
        from pyspark import TaskContext

        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += [np.asarray(r.values, np.int64) for r in batch.column(1)]
        if ids:
            m = np.zeros((len(rows), max(map(len, rows))), np.int64)
            for k, r in enumerate(rows):
                m[k, : len(r)] = r
            m = m.astype(next((t for t in NARROW if not m.size or np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max), np.int64))
            order = np.argsort(m, axis=0, kind="stable").astype(np.int32).T if lists else np.zeros((0, 0), np.int32)
            out = [[TaskContext.get().partitionId()], [len(ids)], [np.array([i or 0 for i in ids], np.int64).tobytes()], [np.array([i is None for i in ids]).tobytes()], [m.dtype.itemsize], [m.tobytes()], [order.tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["block", "n", "ids", "nulls", "width", "values", "lists"])

    return stored(vectors.repartition(max(1, count)).mapInArrow(tidy(run), "block long, n int, ids binary, nulls binary, width int, values binary, lists binary"), name), count


def _upto(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))


Best = list[tuple[int, bool, int]]


def threshold_search(values: np.ndarray, lists: np.ndarray, ids: np.ndarray, nulls: np.ndarray, query: np.ndarray, own: int, k: int, best: Best) -> Best:
    """``best`` (score, whether the id is null, id), best first, joined with this block's rows: exact, with as few rows scored as the bound allows.

    Values and query are of a kind in which all sums are exact: doubles below 2 ** 53, longs, or Python's integers.
    """
    n, used = len(values), np.flatnonzero(query)
    down = (query[used] > 0).astype(bool)
    seen, depth = np.zeros(n, bool), 0
    while depth < n:
        to = min(n, max(FIRST_DEPTH, depth * 2))
        if len(best) == k and depth:
            at = np.where(down, n - depth, depth - 1)
            if (values[lists[used, at], used] * query[used]).sum() < best[-1][0]:
                break
        if len(used) * to >= 4 * n or not len(used):
            to = n
            met = np.flatnonzero(~seen)
        else:
            near = np.concatenate([lists[used[down], n - to : n - depth].ravel(), lists[used[~down], depth:to].ravel()])
            fresh = np.zeros(n, bool)
            fresh[near] = True
            met = np.flatnonzero(fresh & ~seen)
        seen[met] = True
        # the product with a whole block costs less than the copy of a large part of it
        score = (values @ query)[met] if 4 * len(met) >= n else values.take(met, 0) @ query
        mine = nulls[met] | (ids[met] != own)
        score, met = score[mine], met[mine]
        if len(best) == k:
            hope = (score >= best[-1][0]).astype(bool)
            score, met = score[hope], met[hope]
        if len(score):
            if len(score) > k:
                cut = np.partition(score, -k)[-k] if score.dtype != object else sorted(score)[-k]
                keep = (score >= cut).astype(bool)
                score, met = score[keep], met[keep]
            pool = best + list(zip(score.tolist(), nulls[met].tolist(), ids[met].tolist(), strict=True))
            best = sorted(pool, key=lambda x: (-x[0], x[1], x[2]))[:k]
        depth = to
    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every query; both are ``usable`` frames."""
    index, blocks = _packed(vectors, BLOCK, "sorted-lists", True)
    asked, query_blocks = _packed(queries, QUERIES, "queries", False)
    groups = max(1, min(blocks, 64))
    left = index.select(F.pmod("block", F.lit(groups)).alias("g"), "n", "ids", "nulls", "width", "values", "lists", F.explode(_upto(query_blocks)).alias("q"))
    right = asked.select(F.col("block").alias("q"), F.explode(_upto(groups)).alias("g"), F.col("n").alias("m"), F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("values").alias("queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, query_ids, nulls = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["nulls"], bool)
                v, q = (np.frombuffer(r[x], f"i{r[w]}").astype(np.int64).reshape(r[m], -1) for x, w, m in (("values", "width", "n"), ("queries", "query_width", "m")))
                lists = np.frombuffer(r["lists"], np.int32).reshape(-1, r["n"])
                d = min(v.shape[1], q.shape[1])
                v, q, lists = v[:, :d], q[:, :d], lists[:d]
                most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (v, q)]
                bound = most[0] * most[1] * max(d, 1)
                if bound < 1 << 53 or bound >= 1 << 63:
                    v, q = (x.astype(float if bound < 1 << 53 else object) for x in (v, q))
                for i in range(len(query_ids)):
                    state[i] = threshold_search(v, lists, ids, nulls, q[i], int(query_ids[i]), k, state.get(i, []))
        rows = [(int(query_ids[i]), None if null else who, score >> 2 * LIMB, score >> LIMB & MASK, score & MASK) for i, best in state.items() for x, null, who in best for score in [int(x)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["query_id", "vec_id", "high", "middle", "low"])

    # both sides are blocks: of the size that Spark sees on disk they are many times in memory, so neither is ever sent whole to the driver
    best = left.hint("merge").join(right, ["q", "g"]).groupBy("q", "g").applyInArrow(run, "query_id long, vec_id long, high long, middle long, low long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), F.asc_nulls_last("vec_id")))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    small, below = (F.col("high") == 0) & (F.col("middle") == 0), (F.col("high") == -1) & (F.col("middle") == F.lit(MASK))
    score = F.when(small, F.col("low")).when(below, F.col("low") - F.lit(MASK) - 1)
    return top.select("query_id", "rank", "vec_id", score.alias("score"))


def op6_threshold_algorithm_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e, true), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
