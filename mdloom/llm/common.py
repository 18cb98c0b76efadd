"""What the operators share: tables in, shared working folders, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
#: Nodes with so many edges have them dealt over SALTS tasks.
HUB, SALTS, MOST_HUBS = 1024, 32, 1_000_000


def modest(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES in this session: a batch is held on both sides of the Python boundary."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that the cluster names.

    Only where ``spark.checkpoint.dir`` is unset, as in tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark.sparkContext, "_mdloom_scratch", None) or tempfile.mkdtemp(prefix="mdloom-")
        spark.sparkContext._mdloom_scratch = root
    return f"{root.rstrip('/')}/mdloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it outlives lost executors and has no lineage."""
    spark = df.sparkSession
    modest(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """``run``, giving freed memory back once a task ends: Python workers live on and share an executor's memory."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # C libraries other than GNU's
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def masked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column but doc_id and text under a name that clashes with none of ours."""
    names = [c if c in ("doc_id", "text") else f"_column{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def unmasked(out: DataFrame, docs: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """The columns of ``docs`` under their names again, and ``added``; an input column of an added name gives way."""
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added), *added)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def volume(docs: DataFrame) -> int:
    """Bytes of the texts and ids of ``docs``, counted: the optimiser has no size for a plan that is no plain scan."""
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0


def dealt(spark: SparkSession, size: int) -> int:
    """Partitions for an exchange of about ``size`` bytes: they grow with it, so that none does."""
    return max(parts(spark), size // PARTITION_BYTES)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def portions(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """64-bit hashes of byte ranges, from prefix sums of letters times powers of an odd base."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * BASE)

    def __call__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        if len(self.power) < len(data) + 1:
            step = np.full(len(data) + 1, BASE, np.uint64)
            back = np.full(len(data) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.power, self.inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.power[: len(data)], out=sums[1:])
        return mix((sums[at + size] - sums[at]) * self.inverse[at] + np.asarray(size, np.uint64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(doc, label) for the nodes of (a, b): the smallest node of each connected component, by large-star and small-star.

    Neighbourhoods are only ever reduced to their minimum, and joined to it. Nodes with many edges (``HUB``) meet
    their minimum in ``SALTS`` tasks.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        large = _to_least(now.union(now.select("v", "u")).toDF("u", "v"), True)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = _to_least(large, False)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(small.select("u", "m"))
        after = stored(small.toDF("u", "v").distinct(), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = after
        if found == mark:
            return now.select(F.col("u").alias("doc"), F.col("v").alias("label")).union(now.select(F.col("v").alias("doc"), F.col("v").alias("label")).distinct())
        mark = found


def _to_least(edges: DataFrame, own: bool) -> DataFrame:
    """(u, v, m): each edge with the smallest v of its u, u itself counted with ``own``."""
    least = F.least("u", F.min("v")) if own else F.min("v")
    low = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    hubs = low.where(F.col("n") >= HUB).agg(F.count("*").alias("k")).first().k
    if not hubs or hubs > MOST_HUBS:
        return edges.join(low.select("u", "m"), "u")
    names = stored(low.where(F.col("n") >= HUB).select("u"), "hubs")
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    mark = F.broadcast(names.withColumn("hub", F.lit(True)))  # MOST_HUBS rows at most
    edges = edges.join(mark, "u", "left").withColumn("salt", salt)
    low = low.withColumn("salt", F.explode(F.when(F.col("n") >= HUB, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return edges.join(low, ["u", "salt"]).select("u", "v", "m")
