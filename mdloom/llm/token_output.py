"""Token ids in files: canonical length-limited Huffman blocks.

Ids are counted over the whole corpus, package-merge gives code lengths of at most ``LIMIT`` bits, and codes
are canonical, so lengths alone define them. Documents are range-partitioned by doc_id; each part writes rows
of a Parquet table, one row a block: the documents it holds, its bits, and the number of bits between
checkpoints every ``STEP`` ids. A row beside them holds the code lengths, so the files are read by their path alone. Blocks decode independently, and so do the stretches between checkpoints:
decoding advances all of them together, one table look-up an id.

Defined cases: null and empty texts hold the end id alone; rows that share a doc_id (null sorts first) are
ordered by a hash of their ids and then as they come; repeated rows are each written; an empty table writes
no blocks and reads back no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import discard, parts, scratch, stored, table, tidy

LIMIT = 16
STEP = 64
BLOCK = 1 << 16
END = 2
TOGETHER = 32

VERSION = 1
CODE = "version int, bit_limit int, step int, lengths binary"
BLOCKS = "part int, block int, doc_ids array<long>, doc_tokens array<int>, first long, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    for _ in range(limit - 1):
        levels.append(row)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row = np.sort(np.concatenate([leaves, pairs]), kind="stable")
    levels.append(row)
    take, length = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for k in range(limit - 1, -1, -1):
        if k:
            below = levels[k - 1]
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
            # stable merge with leaves first among equals
            leaf_at = np.searchsorted(pairs, leaves, "left") + np.arange(len(leaves))
            own = int(np.searchsorted(leaf_at, take, "left"))
        else:
            own = take
        length[:own] += 1
        take = 2 * (take - own)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol, counting up."""
    code, at, last = np.zeros(len(lengths), np.int64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        at <<= n - last
        last = n
        code[own] = at + np.arange(len(own))
        at += len(own)
    return code


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every ``limit`` leading bits."""
    symbol, length, code = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64), canonical(lengths)
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        if len(own):
            width = 1 << (limit - n)
            at = (code[own][:, None] * width + np.arange(width)).ravel()
            symbol[at], length[at] = np.repeat(own, width), n
    return symbol, length


def write_bits(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints): the codes one after another, and the number of bits of every STEP ids."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    total = int(end[-1]) if len(ids) else 0
    word = code[ids] << (24 - n - (start & 7))
    at, size = start >> 3, (total + 7) // 8 + 3
    out = np.zeros(size, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(at + k, (word >> shift) & 255, minlength=size)[:size].astype(np.int64)
    marks = np.append(start[::STEP], total)
    return out[: (total + 7) // 8].astype(np.uint8).tobytes(), np.diff(marks).astype("<u2").tobytes()


def read_bits(blocks: list[tuple[bytes, bytes, int]], lookup: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """The ids of each (bits, checkpoints, number of ids), all stretches of all blocks in step."""
    data = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    at, left, byte = [], [], 0
    for bits, marks, n in blocks:
        sizes = np.frombuffer(marks, "<u2").astype(np.int64)
        at.append(byte * 8 + np.cumsum(sizes) - sizes)
        left.append(np.minimum(STEP, n - np.arange(len(sizes)) * STEP))
        byte += len(bits)
    position, left = np.concatenate(at), np.concatenate(left)
    symbol, length = lookup
    out = np.zeros((len(position), STEP), np.uint32)
    for k in range(STEP):
        head = window[position >> 3] >> (32 - limit - (position & 7)).astype(np.uint32) & ((1 << limit) - 1)
        out[:, k] = symbol[head]
        position = position + np.where(left > k, length[head], 0)
    result, row = [], 0
    for _, marks, n in blocks:
        rows = len(marks) // 2
        result.append(out[row : row + rows].ravel()[:n])
        row += rows
    return result


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, ids): ids with the end id, as compressed little-endian integers, stored."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                flat, offsets = encode(part.column(1))
                blobs = [_squeeze(np.append(flat[a:b], np.uint32(end))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch([part.column(0), pa.array(blobs, pa.binary())], ["doc_id", "ids"])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary"), "ids")


def _squeeze(ids: np.ndarray) -> bytes:
    """Low and high halves apart, compressed."""
    halves = ids.astype("<u4").view("<u2").reshape(-1, 2).T
    raw = halves[0].tobytes() + (halves[1].tobytes() if halves[1].any() else b"")
    return (len(ids) * 4).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(blob: bytes) -> np.ndarray:
    size, raw = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    halves = np.frombuffer(pa.decompress(blob[16:], raw, "zstd", asbytes=True), "<u2")
    low = halves[: size // 4].astype(np.uint32)
    return low | halves[size // 4 :].astype(np.uint32) << 16 if len(halves) > len(low) else low


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus: as many numbers as the vocabulary has ids."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = np.bincount(_unsqueeze(blob), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write(ids: DataFrame, lengths: np.ndarray, path: str | None = None) -> str:
    """Writes the blocks of ``ids`` in ascending doc_id order, and the code; returns their path."""
    spark = ids.sparkSession
    path = path or scratch(spark, "huffman-files")
    code = canonical(lengths)

    def run(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        owners: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            flat = np.concatenate(held)
            bits, marks = write_bits(flat, lengths, code)
            columns = [[part], [block], [owners], [[len(h) for h in held]], [first], [marks], [bits]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        fields = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("first", pa.int64()), ("checkpoints", pa.binary()), ("bits", pa.binary())])
        for batch in batches:
            for owner, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                owners.append(owner)
                held.append(_unsqueeze(blob))
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush()
                    block, first, owners, held, size = block + 1, first + size, [], [], 0
        if held:
            yield flush()

    tie = F.xxhash64("ids")
    spread = ids.select("doc_id", "ids", tie.alias("tie")).repartitionByRange(parts(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    spread.select("doc_id", "ids").mapInArrow(tidy(run), BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(VERSION, LIMIT, STEP, bytearray(lengths.tobytes()))], CODE).coalesce(1).write.parquet(f"{path}/code")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32."""
    code = spark.read.schema(CODE).parquet(f"{path}/code").first()
    if (code.version, code.bit_limit, code.step) != (VERSION, LIMIT, STEP):
        raise ValueError(f"files of another format: version {code.version}, {code.bit_limit} bits, checkpoints every {code.step}")
    lengths = np.frombuffer(bytes(code.lengths), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches):
        lookup = decode_table(lengths)
        for batch in batches:
            rows = batch.to_pylist()
            for lo in range(0, len(rows), TOGETHER):
                some = rows[lo : lo + TOGETHER]
                flats = read_bits([(r["bits"], r["checkpoints"], sum(r["doc_tokens"])) for r in some], lookup)
                part, owner, start, size, crc = [], [], [], [], []
                for r, flat in zip(some, flats, strict=True):
                    at = 0
                    for doc, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
                        part.append(r["part"])
                        owner.append(doc)
                        start.append(r["first"] + at)
                        size.append(n)
                        crc.append(zlib.crc32(flat[at : at + n].astype("<u4").tobytes()))
                        at += n
                yield pa.record_batch([pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (owner, start, size, crc))], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    totals = blocks.select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base, at = [], 0
    for r in totals.orderBy("part").collect():  # a row for each part that was written
        base.append((r.part, at))
        at += r.n
    before = spark.createDataFrame(base, "part int, before long")
    docs = blocks.mapInArrow(tidy(run), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    ids = encoded(docs, path, end)
    files = write(ids, code_lengths(count_ids(ids)))
    discard(docs.sparkSession, ids)
    return read(docs.sparkSession, files)


def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
