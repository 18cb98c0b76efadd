"""N-gram Jaccard join by parity sketches.

A document's shingles are hashed; hashing them again into blocks and adding each block up by XOR gives a
parity sketch. Documents of similarity 0.8 or more differ in at most a ninth of their summed set sizes, and
every shingle that they do not share changes one block, so sketches cut into more blocks than that must
agree in some (pigeonhole). Sizes fall into bands, each with its number of blocks; a document takes part in
its own band and, if it can be the larger of a pair that starts there, in the band below. Of a document's
blocks only the fullest are sent: enough that two similar documents still share one (prefix filter), while
blocks with few or no shingles, which many documents share by chance, stay home. A document with too few
filled blocks also sends its first shingles, for partners that are alike in this.

Documents that share a block are a group. Within a batch, equal sets collapse to one, and of a block that many
documents of a batch share only the first goes on, while the others stay as rows of their own, so no block
gathers more than a few records a batch. Groups of the same documents collapse, however many blocks they
share. Only keys and ids go through the rounds; a sketch joins once for each distinct pair of documents. Each
group is first compared with one of its documents, and pairs that verified links have put into one component
need no comparison. Groups that still hold several components are compared in full, in tasks of two portions
of a group each, which give only the pairs whose sizes and sketches (Hamming distance) allow the similarity.
Sketches of so many bits say little of large sets, which also have one of a bit a shingle; of two lengths, the
longer is folded. What the sketches let through is verified by its shingle sets, made anew from the texts, which
travel compressed: a set of hashes is larger than its text, and does not compress.

Defined cases: null and empty texts, and texts of white space, have an empty set and link with nothing;
fewer than five words are one shingle; rows that share a doc_id are one document with each of their texts: a link
of any of them is the document's, and each row keeps its own set size; rows with a null doc_id link with nothing
and have a null component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, Hasher, components, dealt, discard, mix, portions, release, stored, table, tidy, utf8, volume

WORDS = 5
SPREAD = 1.4
SPARE = 0.3
SUB_BATCH = 1 << 20
BATCH = 8 << 20
BROADCAST_IDS = 1_000_000
BUCKET_BYTES = 8 << 20
STAR_ROUNDS = 2
#: Members of a group that are compared with as many others in one task.
PORTION = 1024

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
EDGE, INFO, WIDE, GROUP = -1, -2, -3, -4
CROWD = 64
NUMBERS = 16
SKETCH = [f"s{k}" for k in range(NUMBERS)]
LARGE = 4096
FEW = 32
#: Sets of more shingles than this have a fine sketch, of as many bits as shingles or up to twice as many.
COARSE = 64 * NUMBERS


def bands(top: int) -> np.ndarray:
    """The smallest set size of each band, up to one above ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * SPREAD))))
    return np.array(out, np.int64)


def blocks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most differing shingles of a similar pair whose smaller set is in the band, number of blocks) of each band."""
    largest = bounds[1:] - 1
    differ = (largest + largest * 5 // 4) // 9
    return differ, differ + 1 + np.where(differ > 0, np.ceil((differ + 1) * SPARE), 0).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted by both."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~BLANK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    at, last = np.flatnonzero(start), np.flatnonzero(stop)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = hasher(low, at, last - at + 1)
    marks = np.searchsorted(at, offsets)
    count = np.diff(marks)
    doc = np.repeat(np.arange(len(count)), count)
    full = np.flatnonzero(doc[: max(0, len(doc) - WORDS + 1)] == doc[WORDS - 1 :])
    value = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        value = value * BASE + hashes[full + k]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    short = count[few].astype(np.uint64)
    for k in range(WORDS - 1):
        on = count[few] > k
        short[on] = short[on] * BASE + hashes[marks[few[on]] + k]
    owner, value = np.concatenate([doc[full], few]), mix(np.concatenate([value, mix(short)]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]
    return owner[new], value[new]


def block_keys(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key): the blocks that each document sends, for its own band and the band below."""
    bounds = bands(int(size.max(initial=1)))
    differ, number = blocks_of(bounds)
    band = np.searchsorted(bounds, size, "right") - 1
    keys, docs = [], []
    for lower in (0, 1):
        mine = band - lower
        on = (size > 0) & (mine >= 0)
        if lower:
            on &= size * 4 <= (bounds[band] - 1) * 5
        mine = np.maximum(mine, 0)
        use = on[owner]
        own, v = owner[use], value[use]
        if not len(own):
            continue
        p = number[mine[own]].astype(np.uint64)
        block = ((v >> np.uint64(32)) * p >> np.uint64(32)).astype(np.int64)  # rises with the hash
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])])
        parity = np.bitwise_xor.reduceat(mix(v ^ BASE), first)
        filled = np.diff(np.r_[first, len(own)])
        doc = own[first]
        token = mix(parity + mix(block[first].astype(np.uint64) * BASE + mine[doc].astype(np.uint64)) + filled.astype(np.uint64))
        order = np.lexsort((token, -filled, doc))
        doc, token = doc[order], token[order]
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        have = np.diff(np.r_[begin, len(doc)])
        nth = np.arange(len(doc)) - np.repeat(begin, have)
        sent = nth <= differ[mine[doc]]
        keys.append(token[sent])
        docs.append(doc[sent])
        scarce = np.zeros(len(size), bool)
        scarce[doc[begin]] = have <= differ[mine[doc[begin]]]
        use = scarce[own]
        own, v = own[use], v[use]
        if len(own):
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
            sent = nth <= size[own] - (size[own] * 4 + 4) // 5
            keys.append(mix(v[sent] + mix(mine[own[sent]].astype(np.uint64) + np.uint64(1 << 32))))
            docs.append(own[sent])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def short_sketch(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """64 * NUMBERS parity bits of each document, as so many numbers."""
    flat = owner * NUMBERS + (value & np.uint64(NUMBERS - 1)).astype(np.int64)
    out = np.zeros(n * NUMBERS, np.uint64)
    np.bitwise_xor.at(out, flat, np.uint64(1) << (value >> np.uint64(8) & np.uint64(63)))
    return out.reshape(n, NUMBERS)


def fine_sketch(value: np.ndarray) -> bytes | None:
    """Parity bits of a large set, their number the power of two from its size on; none of a small one, whose short sketch says enough."""
    if len(value) <= COARSE:
        return None
    bits = 1 << (len(value) - 1).bit_length()
    odd = np.bincount((value >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two fine sketches differ, the longer folded to the shorter: no more than the shingles in which their sets do."""
    a, b = (np.frombuffer(s, np.uint8) for s in (x, y))
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(s.reshape(-1, size)) for s in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _pack(key: np.ndarray, doc: np.ndarray, crowd: np.ndarray) -> bytes:
    """Low 48 bits of sorted keys, documents, and marks of crowds, as byte planes, compressed if there are many."""
    planes = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() + doc.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + crowd.astype(np.uint8).tobytes()
    return len(key).to_bytes(4, "little") + (planes if len(key) < FEW else pa.compress(planes, "zstd", asbytes=True))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(blob[4:] if n < FEW else pa.decompress(blob[4:], n * 15, "zstd", asbytes=True), np.uint8)
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = planes[: n * 6].reshape(6, n).T
    return key.view("<u8").ravel(), np.ascontiguousarray(planes[n * 6 : n * 14].reshape(8, n).T).view("<i8").ravel(), planes[n * 14 :].astype(bool)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((node, text) of every row, (node, doc_id) where these differ).

    A node is a doc_id; only if some doc_id has several texts, nodes are numbers of (doc_id, text).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = F.sha2(F.coalesce("text", F.lit("")), 256)
    marks = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    if not marks.where("lo <> hi").limit(1).count():
        return docs.select(F.col("doc_id").alias("node"), "text"), None
    kinds = docs.where("doc_id IS NOT NULL").select("doc_id", kind.alias("kind")).distinct()
    names = stored(kinds.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written
    return docs.withColumn("kind", kind).join(names, ["doc_id", "kind"], "left").select("node", "text"), names.select("node", "doc_id")


def gathered(batches, most: int):
    """``batches`` put together while they are of ``most`` bytes at most: what meets in a batch need not be sent."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if len(batch):
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sift(docs: DataFrame, size: int) -> DataFrame:
    """One shuffle of (node, text), ``size`` bytes together: stored rows (kind, a, b, docs).

    INFO: document, set size (one for each input row). EDGE: two documents with equal sets.
    GROUP: a hash of the documents that share a key, and those documents. WIDE: key, document, where they are many.
    """
    spark = docs.sparkSession
    homes = dealt(spark, size)
    n_buckets = max(4 * homes, size // BUCKET_BYTES)

    def split(batches):
        hasher = Hasher()
        for whole in gathered(batches, BATCH):
            for lo, hi in portions(utf8(whole.column(1))[1], BATCH):
                yield from one_batch(whole.slice(lo, hi - lo), hasher)

    def one_batch(batch, hasher):
        ids = batch.column(0)
        there = ~np.asarray(ids.is_null())
        doc_id = np.asarray(ids.fill_null(0))
        data, offsets = utf8(batch.column(1))
        all_docs, all_keys, sizes, sums = [], [], [], []
        for lo, hi in portions(offsets, SUB_BATCH):
            own = offsets[lo : hi + 1]
            owner, value = shingles(data[own[0] : own[-1]], own - own[0], hasher)
            n = hi - lo
            size = np.bincount(owner, minlength=n)
            total = np.zeros((n, 2), np.uint64)
            np.add.at(total[:, 0], owner, value)
            np.bitwise_xor.at(total[:, 1], owner, mix(value + BASE))
            sizes.append(size)
            sums.append(total)
            send = there[lo:hi][owner]
            doc, key = block_keys(owner[send], value[send], size)
            all_docs.append(doc + lo)
            all_keys.append(key)
        size, total = np.concatenate(sizes), np.concatenate(sums)
        yield _row([INFO], [np.where(there, doc_id, 0).tobytes()], [size.astype(np.int64).tobytes()], [there.tobytes()])
        # documents with equal sets: only the first of the batch goes on
        order = np.lexsort((doc_id, total[:, 1], total[:, 0], size))
        order = order[there[order] & (size[order] > 0)]
        head = np.r_[True, (np.diff(size[order]) != 0) | (total[order[1:]] != total[order[:-1]]).any(1)][: len(order)]
        of = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
        copy = of != order
        if copy.any():
            yield _row([EDGE], [doc_id[of[copy]].tobytes()], [doc_id[order[copy]].tobytes()])
        first = np.zeros(len(size), bool)
        first[of] = True
        doc, key = np.concatenate(all_docs), np.concatenate(all_keys)
        keep = first[doc]
        doc, key = doc_id[doc[keep]], key[keep]
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        head = np.r_[True, key[1:] != key[:-1]][: len(key)]
        start = np.flatnonzero(head)
        crowd = np.repeat(np.diff(np.r_[start, len(key)]) > CROWD, np.diff(np.r_[start, len(key)])) if len(key) else head
        if crowd.any():
            yield _row([WIDE], [key[crowd].tobytes()], [doc[crowd].tobytes()])
        # a crowd sends its first document, with a mark
        sends = ~crowd | head
        key, sent, mark = key[sends], doc[sends], crowd[sends]
        cut = np.searchsorted(key, np.arange(1, n_buckets, dtype=np.uint64) * np.uint64((1 << 64) // n_buckets))
        edges = np.r_[0, cut, len(key)]
        full = np.flatnonzero(np.diff(edges))
        yield _row(full.tolist(), [_pack(key[edges[b] : edges[b + 1]], sent[edges[b] : edges[b + 1]], mark[edges[b] : edges[b + 1]]) for b in full], [None] * len(full))

    def _row(bucket, a, b, c=None):
        n = len(bucket)
        return pa.record_batch([pa.array(bucket, pa.int32()), *(pa.array(x if x is not None else [None] * n, pa.binary()) for x in (a, b, c))], ["bucket", "a", "b", "c"])

    def gather(batches):
        def out(kind, a, b, docs=None):
            k = pa.array(np.full(len(a), kind, np.int32))
            return pa.record_batch([k, a if isinstance(a, pa.Array) else pa.array(a), pa.array(b), docs if docs is not None else pa.nulls(len(a), pa.list_(pa.int64()))], ["kind", "a", "b", "docs"])

        def keyed(low, bucket):
            return mix(low + np.asarray(bucket, np.uint64)).view(np.int64)

        def shared(held, bucket):
            both = [_unpack(x) for x in held]
            key, doc, crowd = (np.concatenate(x) for x in zip(*both, strict=True))
            order = np.argsort(key, kind="stable")
            key, doc, crowd = key[order], doc[order], crowd[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            wide = (np.add.reduceat(crowd.astype(np.int64), start) > 0) | (size > LARGE)
            of_wide = np.repeat(wide, size)
            if wide.any():  # documents of crowds have their rows already, but for their first
                yield out(WIDE, keyed(key[of_wide], bucket), doc[of_wide])
            group = ~wide & (size > 1)
            if group.any():
                mine = np.repeat(group, size)
                key, doc = key[mine], doc[mine]
                order = np.lexsort((doc, key))
                doc, size = doc[order], size[group]
                ends = np.r_[0, np.cumsum(size)]
                name = np.add.reduceat(mix(doc.view(np.uint64) + BASE), ends[:-1])
                _, one = np.unique(name, return_index=True)
                docs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(doc)).take(pa.array(one))
                yield out(GROUP, name[one].view(np.int64), size[one].astype(np.int64), docs)

        bucket, held = None, []
        for batch in batches:
            for k, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k >= 0:
                    if k != bucket and held:
                        yield from shared(held, bucket)
                        held = []
                    bucket = k
                    held.append(a)
                elif k == INFO:
                    yield out(INFO, pa.array(np.frombuffer(a, np.int64), mask=~np.frombuffer(c, bool)), np.frombuffer(b, np.int64))
                elif k == WIDE:
                    key = np.frombuffer(a, np.uint64)
                    home = np.minimum(key // np.uint64((1 << 64) // n_buckets), np.uint64(n_buckets - 1))
                    yield out(WIDE, keyed(key & np.uint64((1 << 48) - 1), home), np.frombuffer(b, np.int64))
                else:
                    yield out(k, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
        if held:
            yield from shared(held, bucket)

    rows = docs.select("node", "text").mapInArrow(tidy(split), "bucket int, a binary, b binary, c binary")
    salt = F.when(F.col("bucket") < 0, F.xxhash64("a")).otherwise(F.col("bucket").cast("long"))
    met = rows.withColumn("salt", salt).repartition(homes, "salt").sortWithinPartitions("bucket").drop("salt")
    out = stored(met.mapInArrow(tidy(gather), "kind int, a long, b long, docs array<long>"), "sifted")
    release(spark)
    return out


def small(ids: DataFrame) -> DataFrame:
    """Stored ids, sent whole to every executor only if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, n, sketch, fine, packed): set size, sketches and compressed text of the nodes in ``wanted``, stored."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in portions(offsets, SUB_BATCH):
                own = offsets[lo : hi + 1]
                owner, value = shingles(data[own[0] : own[-1]], own - own[0], hasher)
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                sketch = short_sketch(owner, value, hi - lo).view(np.int64)
                cut, at = ends.tolist(), own.tolist()
                fine = pa.array([fine_sketch(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                packed = pa.array([(b - a).to_bytes(8, "little") + pa.compress(data[a:b], "zstd", asbytes=True) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), *(pa.array(x.copy()) for x in sketch.T), fine, packed], ["doc", "n", *SKETCH, "fine", "packed"])

    texts = docs.withColumnRenamed("node", "doc").join(small(wanted), "doc", "left_semi")
    if docs.groupBy("node").count().where("count > 1").limit(1).count():  # only where nodes repeat do texts have to meet
        texts = texts.dropDuplicates(["doc"])
    numbers = ", ".join(f"{s} long" for s in SKETCH)
    return stored(texts.select("doc", "text").mapInArrow(tidy(run), f"doc long, n long, {numbers}, fine binary, packed binary"), "sets")


def finer(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that the fine sketches of large sets allow, and those of sets without one."""

    def run(batches):
        for batch in batches:
            keep = [x is None or y is None or apart(x, y) * 9 <= n for n, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, fine: known.where("fine IS NOT NULL").select(F.col("doc").alias(end), F.col("n").alias(f"{end}_n"), F.col("fine").alias(fine))
    met = pairs.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    return met.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "x", "y").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            a, packed = np.asarray(batch.column(0)), batch.columns[2:4]
            new = np.r_[True, a[1:] != a[:-1]][: len(a)]
            sizes = np.array([[int.from_bytes(p[k].as_buffer()[:8], "little") for p in packed] for k in range(len(a))], np.int64).reshape(-1, 2)
            keep: list[bool] = []
            for lo, hi in portions(np.r_[0, np.cumsum(sizes[:, 1] + sizes[:, 0] * new)], SUB_BATCH):
                texts, place = [], []
                for k in range(lo, hi):
                    if new[k] or k == lo:  # pairs of one document come together, and its set is made once
                        first = len(texts)
                        texts.append(_text(packed[0][k]))
                    place.append((first, len(texts)))
                    texts.append(_text(packed[1][k]))
                owner, value = shingles(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])], hasher)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i, j in place:
                    x, y = value[ends[i] : ends[i + 1]], value[ends[j] : ends[j + 1]]
                    at = np.searchsorted(x, y)
                    both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                    keep.append(both > 0 and both * 100 >= (len(x) + len(y) - both) * 80)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ends = small(stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ends"))
    texts = known.select("doc", "packed").join(ends, "doc", "left_semi")
    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("y")), "b")
    full = right.join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _text(packed: pa.Scalar) -> bytes:
    raw = packed.as_py()
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that set sizes and the Hamming distance of sketches allow."""
    side = lambda end: known.select(F.col("doc").alias(end), F.col("n").alias(f"{end}_n"), *(F.col(s).alias(f"{end}_{s}") for s in SKETCH))
    far = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"a_{SKETCH[0]}").bitwiseXOR(F.col(f"b_{SKETCH[0]}"))))
    fits = (F.least("a_n", "b_n") * 5 >= F.greatest("a_n", "b_n") * 4) & (far * 9 <= F.col("a_n") + F.col("b_n"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b")


def crosswise(grouped: DataFrame, known: DataFrame, homes: int) -> DataFrame:
    """The likely pairs (a, b) of all groups (key, doc, own, size), between members of different own.

    A group's members are dealt into portions; a task holds two portions of one group and gives only pairs that
    sizes and sketches allow, so a group of any size is split over tasks and its pairs are never listed.
    """

    def run(batches):
        held, at = [], None

        def compare():
            table_ = pa.Table.from_batches(held)
            doc, own, n, portion = (np.asarray(table_.column(c).combine_chunks()) for c in ("doc", "own", "n", "portion"))
            sketch = np.stack([np.asarray(table_.column(s).combine_chunks()) for s in SKETCH], 1).view(np.uint64)
            mixed = portion.min() != portion.max()
            for lo in range(0, len(doc), 64):
                rows = slice(lo, lo + 64)
                fits = (np.minimum(n[rows, None], n) * 5 >= np.maximum(n[rows, None], n) * 4) & (own[rows, None] != own) & (doc[rows, None] < doc)
                if mixed:
                    fits &= portion[rows, None] != portion
                i, j = np.nonzero(fits)
                i += lo
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    far = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
                    near = far * 9 <= n[x] + n[y]
                    if near.any():
                        yield pa.record_batch([pa.array(doc[x[near]]), pa.array(doc[y[near]])], ["a", "b"])

        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("key", "lo", "hi")], 1)
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)] if len(key) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(key[a])
                if now != at and held:
                    yield from compare()
                    held = []
                at = now
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield from compare()

    count = F.ceil(F.col("size") / PORTION).cast("int")
    rows = grouped.withColumn("portion", F.pmod(F.xxhash64("doc", F.lit(7)), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.select("key", F.least("portion", "other").alias("lo"), F.greatest("portion", "other").alias("hi"), "portion", "doc", "own")
    met = rows.join(known.select("doc", "n", *SKETCH), "doc").repartition(homes, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return met.mapInArrow(tidy(run), "a long, b long").distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    docs, names = numbered(docs)
    size = volume(docs)
    sifted = sift(docs, size)
    rows = sifted.where(F.col("kind") == INFO).select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"))
    groups = sifted.where(F.col("kind") == GROUP).groupBy("a").agg(F.any_value("docs").alias("docs"))
    wide = sifted.where(F.col("kind") == WIDE).select(F.col("a").alias("key"), F.col("b").alias("doc")).distinct()
    members = stored(groups.select(F.col("a").alias("key"), F.explode("docs").alias("doc")).unionByName(wide), "members")
    crowd = members.groupBy("key").agg(F.count("*").alias("size"))
    # documents that share most are compared first
    weight = stored(members.join(crowd, "key").groupBy("doc").agg(F.sum("size").alias("weight")), "weights")
    known = sets(docs, weight.select("doc"))
    release(spark)
    links = sifted.where(F.col("kind") == EDGE).select("a", "b")
    if names is not None:  # the texts of one doc_id belong together
        home = names.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.unionByName(names.join(home, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    tested, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        state = weight.withColumn("own", F.col("doc")) if labels is None else weight.join(labels.select("doc", F.col("label").alias("own")), "doc", "left").withColumn("own", F.coalesce("own", "doc"))
        named = members.join(state, "doc")
        order = F.struct("weight", F.xxhash64("doc", F.lit(turn)), "doc") if not turn else F.struct(F.xxhash64("doc", F.lit(turn)), "doc")
        opened = named.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("size"), F.max_by(F.struct("doc", "own"), order).alias("centre"))
        opened = stored(opened.where(f"low < high AND size > {2 if turn else 1}").select("key", "size", "centre"), "open")  # a pair's one comparison is behind it
        if not opened.limit(1).count():
            break
        grouped = named.join(opened, "key")
        if turn < STAR_ROUNDS:
            apart = grouped.where("own <> centre.own")
            found = likely(apart.select(F.least("doc", "centre.doc").alias("a"), F.greatest("doc", "centre.doc").alias("b")).distinct(), known)
        else:
            found = crosswise(grouped.select("key", "doc", "own", "size"), known, dealt(spark, size))
        fresh = stored(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = stored(verified(stored(finer(fresh, known), "finer"), known), "links")
        tested = fresh if tested is None else tested.unionByName(fresh)
        discard(spark, opened)
        release(spark)
        if more.limit(1).count() or labels is None:
            links = links.unionByName(more)
            labels = components(links)
    if labels is None:
        labels = components(links)
    discard(spark, known, members, weight)
    out = rows.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    if names is None:
        return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("label").alias("component_id"))
    of = names.withColumnRenamed("node", "doc").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "label").select("doc", "doc_id", "component_id")
    return out.select("doc", "n_shingles").join(of, "doc", "left").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that have a smaller one in their component."""
    others = stored(link(docs).where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(small(others), "doc_id", "left_anti").select(docs.columns)


def op2_parity_sketch_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w
), one AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
    SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""
