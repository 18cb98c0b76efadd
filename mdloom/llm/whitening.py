"""Whitening of embeddings by TSQR and one-sided Jacobi rotations.

Vectors become whole numbers, whose count and sums are exact. Centred rows (their numerators n*x - S are exact, too, so that
no digits cancel) are compressed in every partition to the triangular factor R of a block at a time; a tree of merges stacks a few
factors and factors them again, down to one R with the singular values and right vectors of all rows. Plane rotations then
orthogonalise R's columns pair by pair, as many disjoint pairs at a time as there are; the rotations, accumulated, are
the components, and the column lengths the standard deviations, small ones as accurate as large ones. No covariance matrix
is formed. The whitened rows' own covariance is merged up the same tree as (n, mean, scatter), and compared with the identity.

What a task or the driver holds grows with the dimension squared, not with the rows.

Defined cases: vectors that are null, hold a null or non-finite entry, or an entry whose whole number does not fit a long take no part, and
neither do those of another length than most vectors have (of lengths as frequent, the longest); components without variance (of one vector, of
equal vectors, of more dimensions than vectors) are left out, with all rows if none is left; a deviation beyond a long is null; null and
repeated vec_ids are rows as any other; an empty table gives no rows; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Rows in a block that is factored at a time, and factors that are merged at a time.
BLOCK, FAN_IN = 4096, 16
#: Rotations end once no pair of columns has a larger cosine; a column this small against the largest has no variance.
COSINE, NOTHING = 1e-15, 1e-13
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole numbers of the vectors that take part."""
    most = float(2**63 - 2**21)
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * float(SCALE)) < most))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long") + SHIFT)
    usable = vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), x.alias("x"))
    length = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    return usable.where(F.size("x") == (length.d if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            yield piece, _matrix(piece.column(column))


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and their exact sum in each dimension."""

    def run(batches):
        count, total = 0, None
        for _, m in _blocks(batches, 0):
            safe = len(m) * int(max(m.max(initial=0), -int(m.min(initial=0)))) < 2**62
            part = np.array([int(s) for s in (m if safe else m.astype(object)).sum(axis=0)], object)
            count, total = count + len(m), part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total]), pa.array([count] * len(total), pa.int64())], ["i", "s", "n"])

    found = x.select("x").mapInArrow(tidy(run), "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    return (found[0].n if found else 0), [int(r.s) for r in sorted(found)]


def numerators(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: longs where they fit, Python integers where not."""
    reach = int(max(m.max(initial=0), -int(m.min(initial=0)))) * n + max(map(abs, sums), default=0)
    return m * n - np.array(sums, np.int64) if reach < 2**62 else m.astype(object) * n - np.array(sums, object)


def deviations(num: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; None beyond a long."""
    most = int(np.abs(num).max(initial=0))
    if most * most * num.shape[1] < 2**63:
        return np.einsum("ij,ij->i", num, num).tolist()
    return [s if s < 2**63 else None for s in (num.astype(object) ** 2).sum(axis=1).tolist()]


def tree(leaves: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One payload of all of ``leaves`` (at, part), ``FAN_IN`` of them merged at a time. The leaves are numbered by partition."""
    level, left = leaves, leaves.rdd.getNumPartitions()

    def run(batch: pa.Table) -> pa.Table:
        ordered = batch.sort_by("at")
        return pa.table({"at": pa.array([ordered["at"][0].as_py() // FAN_IN], pa.int64()), "part": pa.array([merge(ordered["part"].to_pylist())], pa.binary())})

    while left > 1:
        level = level.groupBy(F.floor(F.col("at") / FAN_IN).alias("_group")).applyInArrow(run, "at long, part binary")
        left = -(-left // FAN_IN)
    rows = level.collect()  # one at most
    return rows[0].part if rows else None


def _leaf(part: bytes) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part], pa.binary())], ["at", "part"])


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _bytes(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, np.float64).tobytes()


def triangle(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: blocks are factored below what the partition has so far, partitions by a tree."""
    d = len(sums)

    def run(batches):
        r = np.zeros((0, d))
        for _, m in _blocks(batches, 0):
            r = _factor(np.vstack([r, (numerators(m, n, sums) / n).astype(np.float64)]))
        if len(r):
            yield _leaf(_bytes(r))

    part = tree(x.select("x").mapInArrow(tidy(run), "at long, part binary"), lambda those: _bytes(_factor(np.vstack([np.frombuffer(t).reshape(-1, d) for t in those]))))
    return np.frombuffer(part).reshape(-1, d) if part else np.zeros((0, d))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values), largest first, by rotations of pairs of columns.

    Columns meet in a round-robin tournament, in which all pairs of a round are disjoint and turn at once.
    """
    d = r.shape[1]
    a, v = np.array(r, np.float64), np.eye(d)
    seats = np.arange(d + d % 2)  # a column more sits out where d is odd
    while True:
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            i, j = seats[:half], seats[half:][::-1]
            there = (i < d) & (j < d)
            i, j = np.minimum(i, j)[there], np.maximum(i, j)[there]
            p, q = a[:, i], a[:, j]
            alpha, beta, gamma = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            go = np.abs(gamma) > COSINE * np.sqrt(alpha * beta)
            if go.any():
                turned = True
                i, j, alpha, beta, gamma = i[go], j[go], alpha[go], beta[go], gamma[go]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                for m in (a, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return v[:, order], sigma[order]


class Whitening:
    """A fitted transformation: n, sums, components as columns, and their standard deviations and shares of the variance."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        v, sigma = jacobi(r) if r.size else (np.zeros((len(sums), 0)), np.zeros(0))
        total = float((sigma * sigma).sum())
        k = min(components, int((sigma > NOTHING * sigma.max(initial=0)).sum()))
        self.vectors, self.deviation = v[:, :k], sigma[:k] / np.sqrt(max(n, 1))
        self.explained = sigma[:k] ** 2 / total if k else np.zeros(0)

    def rows(self, num: np.ndarray) -> np.ndarray:
        """Whitened rows of the numerators of centred rows."""
        return (num / self.n).astype(np.float64) @ (self.vectors / self.deviation)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    return _fit(whole_numbers(vectors), components)


def _fit(x: DataFrame, components: int) -> Whitening:
    n, sums = totals(x)
    return Whitening(n, sums, triangle(x, n, sums) if n else np.zeros((0, 0)), components)


def _merged(those: list[bytes], k: int) -> bytes:
    """Counts, means and scatters joined pair by pair: what differs between the means is added, and nothing is subtracted."""
    n, mean, scatter = 0.0, np.zeros(k), np.zeros((k, k))
    for t in those:
        row = np.frombuffer(t)
        m, other, s = row[0], row[1 : k + 1], row[k + 1 :].reshape(k, k)
        step = other - mean
        scatter = scatter + s + np.outer(step, step) * (n * m / (n + m))
        mean, n = mean + step * (m / (n + m)), n + m
    return _bytes(np.concatenate([[n], mean, scatter.ravel()]))


def identity_error(x: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by size, of the covariance of ``x``'s whitened rows less the identity, from those rows themselves."""
    k = model.vectors.shape[1]
    if not k:
        return None

    def run(batches):
        part = []
        for _, m in _blocks(batches, 0):
            w = model.rows(numerators(m, model.n, model.sums))
            mean = w.mean(axis=0)
            part = [_merged([*part, _bytes(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]))], k)]
        if part:
            yield _leaf(part[0])

    found = np.frombuffer(tree(x.select("x").mapInArrow(tidy(run), "at long, part binary"), lambda those: _merged(those, k)))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None = None, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = whole_numbers(vectors)
    model = model or _fit(x, components)
    error = identity_error(x, model)
    k = model.vectors.shape[1]

    def run(batches):
        for piece, m in _blocks(batches, 1):
            if not k:
                continue
            num = numerators(m, model.n, model.sums)
            rows = len(m)
            repeat = np.repeat(np.arange(rows), k)
            columns = [
                piece.column(0).take(pa.array(repeat)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)),
                pa.array(deviations(num), pa.int64()).take(pa.array(repeat)),
                pa.array(model.rows(num).ravel()),
                pa.array(np.tile(model.explained, rows)),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return x.mapInArrow(tidy(run), OUT).withColumn("identity_error", F.lit(error).cast("double"))


def op11_jacobi_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
