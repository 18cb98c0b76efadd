"""Best-fit packing by minimum bin slack.

Only the counts of piece lengths decide a packing, and there are at most ``capacity`` lengths, so the driver
packs the histogram: the largest length left opens a bin, a bitset subset-sum over the lengths still
available finds the fullest combination with it, and that pattern is taken as often as its lengths allow.
Pieces then learn their place from their rank among pieces of the same length. Ranks come from counts per
(length, bucket of a row hash), so that a length shared by a third of all rows is ranked in many tasks.

Defined cases: null and empty texts hold the end id alone and are packed like any other; a document longer
than a sequence is cut into full pieces, the last one shorter; repeated rows are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stored, table, tidy

CAPACITY = 4096
END = 1
RANKED_TOGETHER = 100_000


def fullest(capacity: int, available: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The (length, copies) that fill ``capacity`` most, by subset-sum bitsets; ``available`` in the order to prefer."""
    sums, steps, full = 1, [], (1 << (capacity + 1)) - 1
    for length, count in available:
        if length > capacity:
            continue
        copies, taken = min(count, capacity // length), 1
        while copies:  # powers of two of the copies, so that a few shifts cover all of their numbers
            k = min(taken, copies)
            steps.append((length, k, sums))
            sums |= (sums << (length * k)) & full
            copies, taken = copies - k, taken * 2
            if sums >> capacity:
                break
        if sums >> capacity:
            break
    at, out = sums.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= length * k
    return sorted(out.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) such that every counted piece lies in one bin."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    out = []
    while order:
        head = order[0]
        left[head] -= 1
        room = capacity - head
        rest = [(room, 1)] if left.get(room, 0) > 0 else fullest(room, [(n, left[n]) for n in order if n <= room and left[n]]) if room else []
        left[head] += 1
        pattern = dict(rest)
        pattern[head] = pattern.get(head, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        out.append((times, sorted(pattern.items(), reverse=True)))
        for n, k in pattern.items():
            left[n] -= times * k
        if not all(left[n] for n in pattern):
            order = [n for n in order if left[n]]
    return out


def places(packed: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: for each run of ranks, its key, first sequence, copies and offset."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for times, pattern in packed:
        offset = 0
        for n, k in pattern:
            rows.append((n << 44 | rank.get(n, 0), first, k, offset))
            rank[n] = rank.get(n, 0) + times * k
            offset += n * k
        first += times
    rows.sort()
    return dict(zip(("key", "first", "copies", "offset"), np.array(rows, np.int64).reshape(-1, 4).T.copy(), strict=True))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text, encoded and cut."""

    def run(batches):
        encode, tail = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                home, number, start, length, crc = [], [], [], [], []
                flat, offsets = encode(part.column(1))
                for i in range(part.num_rows):
                    ids = flat[offsets[i] : offsets[i + 1]].tobytes() + tail
                    for n, at in enumerate(range(0, len(ids), capacity * 4)):
                        own = ids[at : at + capacity * 4]
                        home.append(i)
                        number.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                columns = [part.column(0).take(pa.array(home, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table with a ``length``) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    buckets = max(16, sum(counts.values()) // RANKED_TOGETHER)
    where = spark.sparkContext.broadcast(places(patterns(counts, capacity), capacity))  # of bounded size, as the lengths are
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*cut.columns), F.lit(buckets)))
    cells = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("nth", nth).join(cells, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth") - 1).drop("bucket", "nth", "base")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches):
        to = where.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            key = length << 44 | rank
            i = np.searchsorted(to["key"], key, "right") - 1
            nth = key - to["key"][i]
            sequence = to["first"][i] + nth // to["copies"][i]
            offset = to["offset"][i] + nth % to["copies"][i] * length
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(names).dtypes)
    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity, end), "pieces"), capacity)


def op8_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
