"""Exact dedup with an extendible-hash index on shared files, in DataFrame operations only.

Entries are the distinct texts, found by grouping on (hash, text), which compares whole texts byte by byte
and collapses copies before they are shuffled. A directory addressed by the leading bits of the hash starts
with one bucket; a bucket over its capacity splits, and the directory doubles when a bucket's own depth
passes it. Entries are written by ranges of buckets, one range to each owner task; within a bucket, texts
that share a hash form a chain. Documents then look up their entry by hash and digest.

Defined cases: null text is the empty text; rows that share both text and the largest doc_id are all kept,
as nothing tells them apart; null doc_ids never win unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, scratch, stored, table

DEPTH = 12
CAPACITY = 50_000


def directory(counts: dict[int, int], depth: int = DEPTH, capacity: int = CAPACITY) -> tuple[int, list[int], list[tuple[int, int]]]:
    """(global depth, bucket of each directory cell, (prefix, local depth) of each bucket).

    ``counts``: entries by the ``depth`` leading bits of the hash, so at most 2**depth numbers.
    """
    full = [counts.get(p, 0) for p in range(1 << depth)]
    todo, done = [(0, 0)], []
    while todo:
        prefix, local = todo.pop()
        width = depth - local
        if local < depth and sum(full[prefix << width : (prefix + 1) << width]) > capacity:
            todo += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]  # split; the directory doubles if local was its depth
        else:
            done.append((prefix, local))
    top = max(local for _, local in done)
    cells = [0] * (1 << top)
    for bucket, (prefix, local) in enumerate(done):
        for cell in range(prefix << (top - local), (prefix + 1) << (top - local)):
            cells[cell] = bucket
    return top, cells, done


def build_index(docs: DataFrame, depth: int = DEPTH, capacity: int = CAPACITY) -> DataFrame:
    """The index as a stored table: bucket, hash, chain, text_sha256, keep_id, group_size."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    entries = stored(
        docs.select("doc_id", text.alias("text"))
        .withColumn("hash", F.xxhash64("text"))
        .groupBy("hash", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"),
        "entries",
    )
    lead = F.shiftrightunsigned("hash", 64 - depth).cast("int")
    counts = {r.p: r.n for r in entries.groupBy(lead.alias("p")).agg(F.count("*").alias("n")).collect()}  # 2**depth rows at most
    top, cells, _ = directory(counts, depth, capacity)
    cell = F.shiftrightunsigned("hash", 64 - top).cast("int") if top else F.lit(0)
    bucket = F.element_at(F.array(*map(F.lit, cells)), cell + 1) if top else F.lit(0)
    chain = Window.partitionBy("bucket", "hash").orderBy("text_sha256")
    index = (
        entries.withColumn("bucket", bucket)
        .repartitionByRange(parts(spark), "bucket", "hash")
        .withColumn("chain", F.row_number().over(chain) - 1)
        .select("bucket", "hash", "chain", "text_sha256", "keep_id", "group_size")
    )
    path = scratch(spark, "extendible-index")
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def dedup(docs: DataFrame, depth: int = DEPTH, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    index = build_index(docs, depth, capacity)
    text = F.coalesce("text", F.lit(""))
    probes = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("text_sha256"))
    return probes.join(index, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
