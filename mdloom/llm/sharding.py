"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; rows and bytes are counted per slot; a versioned map
sends slots to shards. Version 1 deals slots round robin; ``rebalance`` edits it by moving as few slots as
needed until shards hold nearly equal bytes. Only the map changes when shards are rebalanced or added: a
record's virtual slot never does. The map has ``slots`` rows whatever the input's size.

Defined cases: null text counts as empty; a null doc_id hashes like any value, with the text deciding the
slot; repeated rows share a slot and get different places, unless they hold more than twice what a slot has on average: then each
of them hashes with its own number, so that no slot is hot; an empty table gives no rows. A map
that has versions already is edited from its latest one, and keeps them all; it can gain shards, not lose any. Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

SLOTS = 16384
SHARDS = 40
HEADER = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): what placing a document needs, without its text."""
    text = F.coalesce("text", F.lit(""))
    crc: Column = F.crc32(text)
    return docs.select("doc_id", (F.octet_length(text).cast("long") + HEADER).alias("size"), crc.alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")
    )


def spread(placed: DataFrame, load: list[int]) -> DataFrame:
    """``placed`` with the repeated rows of hot slots dealt over all slots by their number ``row``; every other row keeps its slot."""
    slots, most = len(load), 2 * sum(load) // len(load)
    over = [s for s, n in enumerate(load) if n > most]  # half of the slots at most
    if not over:
        return placed
    spark, key = placed.sparkSession, ["doc_id", "text_crc32", "size"]
    hot = F.broadcast(spark.createDataFrame([(s,) for s in over], "vslot int"))
    same = placed.join(hot, "vslot").groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * F.col("size") > most))
    names = F.broadcast(same.select(*(F.col(c).alias(f"_{c}") for c in key)))  # fewer than half as many as slots, as each holds as much as two
    found = placed.join(names, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size")), "left")
    own = F.pmod(F.xxhash64("vslot", "row"), F.lit(slots)).cast("int")
    return found.withColumn("vslot", F.when(F.col("_size").isNull(), F.col("vslot")).otherwise(own)).drop(*(f"_{c}" for c in key))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt round robin."""
    return [s % shards for s in range(slots)]


def rebalance(owner: list[int], load: list[int], shards: int) -> list[int]:
    """The next version of a map: ``owner`` with slots moved until shards hold nearly equal ``load``."""
    owner = list(owner)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        if load[slot]:
            held[shard].append((load[slot], slot))
    for h in held:
        h.sort()
    total = [sum(x for x, _ in h) for h in held]
    goal = -(-sum(total) // shards)
    pool: list[tuple[int, int]] = []
    for shard in range(shards):
        while held[shard] and total[shard] > goal:
            over = total[shard] - goal
            i = min(bisect_left(held[shard], (over, 0)), len(held[shard]) - 1)
            pool.append(held[shard].pop(i))
            total[shard] -= pool[-1][0]
    for size, slot in sorted(pool, reverse=True):
        shard = min(range(shards), key=total.__getitem__)
        insort(held[shard], (size, slot))
        total[shard] += size
    while True:
        high, low = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[high] - total[low]
        move = _best_move(held[high], held[low], gap)
        if not move:
            break
        give, take = move
        held[high].remove(give)
        insort(held[low], give)
        if take:
            held[low].remove(take)
            insort(held[high], take)
        moved = give[0] - (take[0] if take else 0)
        total[high] -= moved
        total[low] += moved
    for shard, h in enumerate(held):
        for _, slot in h:
            owner[slot] = shard
    return owner


def _best_move(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int):
    """The slot to move, or the pair to swap, that brings the two shards nearest to each other."""
    best, found = gap, None
    for take in (None, *low):
        want = gap // 2 + (take[0] if take else 0)
        i = bisect_left(high, (want, 0))
        for give in high[max(0, i - 1) : i + 1]:
            moved = give[0] - (take[0] if take else 0)
            if 0 < moved < gap and abs(gap - 2 * moved) < best:
                best, found = abs(gap - 2 * moved), (give, take)
    return found


def grow(owner: list[int], load: list[int], shards: int) -> list[int]:
    """The next version with one more shard: it takes its share of slots, and no other slot moves."""
    owner = list(owner)
    order = sorted(range(len(owner)), key=lambda s: -load[s])
    total = [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        total[shard] += load[slot]
    goal = sum(total) // (shards + 1)
    for slot in order:
        if total[owner[slot]] - load[slot] >= goal and total[shards] + load[slot] <= goal:
            total[owner[slot]] -= load[slot]
            total[shards] += load[slot]
            owner[slot] = shards
    return owner


class SlotMap:
    """The slot-to-shard map, one row a slot and version, kept as a table in the shared folder."""

    schema = "version int, vslot int, shard int, rows long, bytes long, base long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "slot-map")

    def save(self, version: int, owner: list[int], rows: list[int], load: list[int]) -> None:
        base, out, top = [0] * len(owner), [], [0] * (max(owner, default=0) + 1)
        for slot, shard in enumerate(owner):
            base[slot] = top[shard]
            top[shard] += rows[slot]
            out.append((version, slot, shard, rows[slot], load[slot], base[slot]))
        self.spark.createDataFrame(out, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.spark.read.schema(self.schema).parquet(self.path).agg(F.max("version")).first()[0] or 0

    def owner(self, version: int) -> list[int]:
        """The shard of each slot."""
        return [r.shard for r in self.load(version).orderBy("vslot").collect()]  # `slots` rows

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("version") == version)


def _counted(placed: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Rows and bytes of each slot."""
    rows, load = [0] * slots, [0] * slots
    for r in placed.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect():  # `slots` rows at most
        rows[r.vslot], load[r.vslot] = r["rows"], r["bytes"]
    return rows, load


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard and its place there, balanced by bytes."""
    spark = docs.sparkSession
    # numbered once and written, so that no lost task numbers rows anew
    placed = stored(records(docs, slots).withColumn("row", F.monotonically_increasing_id()), "records")
    rows, load = _counted(placed, slots)
    even = spread(placed, load)
    if even is not placed:
        placed = stored(even, "records")
        rows, load = _counted(placed, slots)
    slot_map = slot_map or SlotMap(spark)
    version = slot_map.latest()
    if version:
        owner = slot_map.owner(version)
        if len(owner) != slots or max(owner) >= shards:
            raise ValueError(f"the map has {len(owner)} slots and {max(owner) + 1} shards, not {slots} and at most {shards}")
    else:
        version, owner = 1, first_map(slots, shards)
        slot_map.save(version, owner, rows, load)
    version += 1
    slot_map.save(version, rebalance(owner, load, shards), rows, load)
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "row")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(slot_map.load(version).select("vslot", "shard", "base")), "vslot")  # `slots` rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), "vslot")
    )


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
