"""Suffix-array dedup by distributed prefix doubling.

Positions are ranked by growing prefixes of their suffixes, and only positions whose rank is not unique go on.
A rank is the 64-bit hash of the prefix, so equal prefixes have equal ranks without a global numbering; each
round sorts (rank, document, position) in packed blocks dealt out by rank.

Round 1 ranks by the first two fifths of the threshold, and only at anchors: the positions of least rank
among all that fit into some window as long as the threshold. Equal windows have equal anchors, so a repeat
of that length always shows up in one. Round 2 ranks the remaining anchors by the rank of a prefix and that
of the next at an offset: halfway to the threshold, to the left and to the right, and then the whole length.
Anchors of equal whole ranks also learn where the first document has them, and stretches of anchors at one
distance from it are settled together. Round 3 ranks every position near what remains, by the whole length.

Within a batch, equal ranks are first settled among themselves and stand for one another afterwards, so a
rank that many documents share sends few records.

Defined cases: null text is empty; texts shorter than the threshold lose nothing; rows with a null doc_id
take no part and keep everything; rows that share a doc_id are judged apart, and neither is smaller; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Hasher, masked, mix, parts, portions, ranges, release, stored, table, tidy, unmasked, utf8

LENGTH = 50
SUB_BATCH = 1 << 18
BROADCAST_BYTES = 48 << 20
RECORDS = 1 << 17

Records = tuple[np.ndarray, np.ndarray, np.ndarray]  # rank, document, position


def anchors(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in data, ranks): those of least rank among all starts within some window of ``length``."""
    gram = length * 2 // 5
    width = length - gram + 1
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n)
    valid = place + gram <= end
    rank = np.full(n + width, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(valid)
    rank[at] = hasher(data, at, gram)
    least = _sliding(rank, width, np.minimum)[:n]
    least[place + length > end] = 0
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)[:n]
    found = np.flatnonzero(valid & (most == rank[:n]))
    return found, rank[found]


def _sliding(x: np.ndarray, width: int, choose) -> np.ndarray:
    """choose(x[i], ..., x[i + width - 1]) for each i, by doubling."""
    have = 1
    while have * 2 <= width:
        x = choose(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return choose(x[: len(x) - rest], x[rest:]) if rest else x


def _pack(rank: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    planes = b"".join(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (rank.view(np.int64), doc, place))
    return len(rank).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * 24, "zstd", asbytes=True), np.uint8).reshape(3, 8, n)
    rank, doc, place = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    return rank.view(np.uint64), doc, place


def _rows(buckets, blobs) -> pa.RecordBatch:
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _sort(records: list[tuple]) -> list[np.ndarray]:
    """Columns of the records, by rank, document, place."""
    columns = [np.concatenate(c) for c in zip(*records, strict=True)]
    order = np.lexsort(columns[2::-1])
    return [c[order] for c in columns]


def _groups(rank: np.ndarray, doc: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of its rank, whether the rank has two documents), for sorted records."""
    head = np.r_[True, rank[1:] != rank[:-1]][: len(rank)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0)) if len(rank) else np.zeros(0, np.int64)
    start = np.flatnonzero(head)
    size = np.diff(np.r_[start, len(rank)])
    last = start + size - 1
    return first, np.repeat(doc[start] // share != doc[last] // share, size) if len(rank) else np.zeros(0, bool)


def exchange(source: DataFrame, records, collect, schema: str, firsts, share: int = 1) -> DataFrame:
    """A round: equal ranks meet, and what they learn goes back to their documents.

    ``records(batch, hasher)`` yields (rank, document, place); a place is a position times 4 plus a kind.
    ``firsts`` says of kinds whether they ask for an earlier document (True) or only for another one (False).
    ``collect(document, place, first document, first place)`` makes the rows of one document; first documents
    are earlier ones where asked for, or any. Documents of one number after division by ``share`` are of one age.
    """
    spark = source.sparkSession
    homes = parts(spark)
    n = 4 * homes
    step = np.uint64((1 << 64) // n)
    asks = np.array(firsts)

    def split(batches):
        hasher = Hasher()
        held, size = [], 0

        def flush():
            rank, doc, place = _sort(held)
            first, several = _groups(rank, doc, share)
            asking = asks[place & 3]
            later = several & (doc // share > doc[first] // share)
            settled = np.where(asking, later, several)
            i = np.flatnonzero(settled)
            if len(i):
                # answered here: marked by a negative bucket
                for b, blob in zip(*_answers(doc[i], place[i], doc[first[i]], place[first[i]], homes), strict=True):
                    yield _rows([-1 - b], [blob])
            go = np.where(asking, ~later, ~several | (first == np.arange(len(first))))
            mark = go & several & ~asking
            rank, doc, place = rank[go], doc[go], np.where(mark, ~place, place)[go]
            edges = np.searchsorted(rank, np.arange(n, dtype=np.uint64) * step)
            edges = np.r_[edges, len(rank)]
            full = np.flatnonzero(np.diff(edges))
            yield _rows(full.tolist(), [_pack(rank[a:b], doc[a:b], place[a:b]) for a, b in zip(edges[full], edges[full + 1], strict=True)])

        for batch in batches:
            for found in records(batch, hasher):
                held.append(found)
                size += len(found[0])
                if size >= RECORDS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        def answer(held):
            rank, doc, place = _sort([_unpack(x) for x in held])
            marked = place < 0
            place = np.where(marked, ~place, place)
            first, several = _groups(rank, doc, share)
            reply = np.where(asks[place & 3], several & (doc // share > doc[first] // share), several & ~marked)
            i = np.flatnonzero(reply)
            told.append((doc[i], place[i], doc[first[i]], place[first[i]]))
            if sum(len(x[0]) for x in told) >= RECORDS:
                yield from tell()

        def tell():
            columns = [np.concatenate(c) for c in zip(*told, strict=True)]
            told.clear()
            if len(columns[0]):
                at, blobs = _answers(*columns, homes)
                yield _rows(at.tolist(), blobs)

        told: list[tuple] = []
        bucket, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k < 0:
                    yield _rows([-1 - k], [blob])
                    continue
                if k != bucket and held:
                    yield from answer(held)
                    held = []
                bucket = k
                held.append(blob)
        if held:
            yield from answer(held)
        if told:
            yield from tell()

    def gather(batches):
        def rows(held):
            columns = [np.concatenate(c) for c in zip(*map(_unanswer, held), strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(columns[0]) != 0]), len(columns[0])].tolist()
            docs, out = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                docs.append(int(columns[0][a]))
                out.append(collect(docs[-1], *(c[a:b] for c in columns[1:])))
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.record_batch([pa.array(docs, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["doc_id", *names])

        bucket, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != bucket and held:
                    yield from rows(held)
                    held = []
                bucket = k
                held.append(blob)
        if held:
            yield from rows(held)

    kind = "bucket int, blob binary"
    key = F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.col("bucket").cast("long"))
    dealt = source.mapInArrow(tidy(split), kind).withColumn("key", key).repartition(parts(spark), "key").sortWithinPartitions("bucket").drop("key")
    replies = dealt.mapInArrow(tidy(meet), kind).repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    out = stored(replies.mapInArrow(tidy(gather), f"doc_id long, {schema}"), "round")
    release(spark)
    return out


def _answers(doc, place, first_doc, first_place, n):
    """(buckets, blobs): what documents learn, packed by document."""
    home = (mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((place, doc, home))
    edges = np.searchsorted(home[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(edges))
    blobs = []
    for b in full:
        i = order[edges[b] : edges[b + 1]]
        columns = (doc[i], np.diff(place[i], prepend=0), first_doc[i], (first_place[i] >> 2) - (place[i] >> 2))
        planes = b"".join(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in columns)
        blobs.append(len(i).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True))
    return full, blobs


def _unanswer(blob: bytes) -> list[np.ndarray]:
    """[document, place, first document, distance to the first place]"""
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], n * 32, "zstd", asbytes=True), np.uint8).reshape(4, 8, n)
    doc, place, first, shift = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    return [doc, np.cumsum(place), first, shift]


def _squeeze(x: np.ndarray) -> bytes:
    """A sorted array of integers."""
    planes = np.ascontiguousarray(np.diff(x, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _spread(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], n * 4, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64))


def union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [start, stop) joined where they touch, in order."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


def minus(start, stop, hole_start, hole_stop):
    """Joined ranges without joined holes."""
    if not len(start) or not len(hole_start):
        return start, stop
    cuts = np.unique(np.concatenate([start, stop, hole_start, hole_stop]))
    inside = lambda a, b: (np.searchsorted(a, cuts[:-1], "right") > np.searchsorted(b, cuts[:-1], "right"))
    keep = inside(start, stop) & ~inside(hole_start, hole_stop)
    return cuts[:-1][keep], cuts[1:][keep]


def _pairs(start: np.ndarray, stop: np.ndarray) -> bytes:
    return _squeeze(np.stack([start, stop], 1).ravel())


def _joined(docs: DataFrame, more: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """Texts with what a round told their documents; sent whole to every executor only if it is small."""
    columns = [F.length(c) for c in more.columns if c != on]
    size = more.agg(F.sum(sum(columns) + 64)).first()[0] or 0
    return docs.join(F.broadcast(more) if size <= BROADCAST_BYTES else more, on, how)


def repeated(docs: DataFrame, length: int = LENGTH, share: int = 1) -> DataFrame:
    """(doc_id, windows): starts of the windows of ``length`` bytes that an earlier document has as well."""
    gram = length * 2 // 5
    half = (length - gram) // 2
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")

    def first_round(batch, hasher):
        doc_id = np.asarray(batch.column(0))
        data, offsets = utf8(batch.column(1))
        for lo, hi in portions(offsets, SUB_BATCH):
            own = offsets[lo : hi + 1] - offsets[lo]
            at, rank = anchors(data[offsets[lo] : offsets[hi]], own, hasher, length)
            doc = np.searchsorted(own, at, "right") - 1
            yield rank, doc_id[lo + doc], (at - own[doc]) * 4

    def settle(batch):
        """(document, its bytes' offset, size and further columns) of each portion."""
        data, offsets = utf8(batch.column(1))
        for lo, hi in portions(offsets, SUB_BATCH):
            yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

    def second_round(batch, hasher):
        doc_id, blobs = np.asarray(batch.column(0)), batch.column(2).to_pylist()
        for lo, hi, data, own in settle(batch):
            spread = [_spread(b) for b in blobs[lo:hi]]
            at = np.concatenate([s + o for s, o in zip(spread, own[:-1], strict=True)])
            doc = np.repeat(np.arange(hi - lo), [len(s) for s in spread])
            begin, end = own[doc], own[doc + 1]
            for kind, (back, size) in enumerate(((half, gram + half), (0, gram + half), (0, length))):
                fits = (at - back >= begin) & (at - back + size <= end)
                a = at[fits]
                yield hasher(data, a - back, size) ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1), doc_id[lo + doc[fits]], (a - begin[fits]) * 4 + kind

    def settled(doc, place, first, shift):
        """(candidate windows, windows known to repeat) as ranges."""
        at, kind = place >> 2, place & 3
        left, right, whole = at[kind == 0], at[kind == 1], kind == 2
        start = np.maximum(np.concatenate([left - 2 * half - (length - gram) % 2, right - half - (length - gram) % 2]), 0)
        stop = np.concatenate([left - half + 1, right + 1])
        at, first, shift = at[whole], first[whole], shift[whole]
        same = (first[1:] == first[:-1]) & (shift[1:] == shift[:-1]) & (np.diff(at) <= length)
        to = at + 1
        to[:-1][same] = at[1:][same] + 1
        known = union(at, to)
        fine = stop > start
        candidates = minus(*union(start[fine], stop[fine]), *known)
        return _pairs(*candidates), _pairs(*known)

    def third_round(batch, hasher):
        doc_id, blobs = np.asarray(batch.column(0)), batch.column(2).to_pylist()
        for lo, hi, data, own in settle(batch):
            starts, docs = [], []
            for k, blob in enumerate(blobs[lo:hi]):
                a, b = _spread(blob).reshape(-1, 2).T
                b = np.minimum(b, own[k + 1] - own[k] - length + 1)
                fits = b > a
                starts.append(ranges(a[fits], (b - a)[fits]) + own[k])
                docs.append(np.full(len(starts[-1]), k))
            at, doc = np.concatenate(starts), np.concatenate(docs).astype(np.int64)
            for i in range(0, len(at), RECORDS):
                a, d = at[i : i + RECORDS], doc[i : i + RECORDS]
                yield hasher(data, a, length), doc_id[lo + d], (a - own[d]) * 4

    one = exchange(texts, first_round, lambda doc, place, first, shift: (_squeeze(np.unique(place >> 2)),), "places binary", [False] * 4, share)
    two = exchange(_joined(texts, one, "inner"), second_round, settled, "candidates binary, known binary", [False, False, True, True], share)
    near = _joined(texts, two.select("doc_id", "candidates"), "inner")
    three = exchange(near, third_round, lambda doc, place, first, shift: (_squeeze(np.unique(place >> 2)),), "windows binary", [True] * 4, share)
    return two.select("doc_id", "known").join(three, "doc_id", "full_outer")


def removals(docs: DataFrame, length: int = LENGTH, cut: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``spans``: (start, stop) byte ranges that repeat an earlier document, in order.

    With ``cut``, spans keep to whole characters, and the texts are without them.
    """
    given_docs = docs
    docs, masks = masked(docs)
    names, given, column = docs.columns, docs.dtypes, docs.columns.index("text")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    share = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct(text_hash).alias("n")).agg(F.max("n")).first()[0] or 1
    if share == 1:
        docs = docs.withColumn("_node", F.col("doc_id").cast("long"))
    else:  # rows that share a doc_id get numbers of their own, of one age
        texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_hash.alias("_hash")).distinct()
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_hash")) - 1
        ends = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        age = F.col("doc_id")
        if max(-ends.low, ends.high + 1) * share >= 1 << 63:  # such ids are numbered in their order
            ages = stored(texts.select("doc_id").distinct().orderBy("doc_id").withColumn("_age", F.monotonically_increasing_id()), "ages")
            texts, age = texts.join(ages, "doc_id"), F.col("_age")
        nodes = texts.select("doc_id", "_hash", (age * share + number).alias("_node"))
        docs = docs.withColumn("_hash", text_hash).join(nodes, ["doc_id", "_hash"], "left")
    found = repeated(docs.select(F.col("_node").alias("doc_id"), "text"), length, share).withColumnRenamed("doc_id", "_node")

    def run(batches):
        for batch in batches:
            known, windows = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            spans = []
            for k, w in zip(known, windows, strict=True):
                a, b = _spread(k).reshape(-1, 2).T if k else (np.zeros(0, np.int64),) * 2
                s = _spread(w) if w else np.zeros(0, np.int64)
                start, stop = union(np.concatenate([a, s]), np.concatenate([b - 1, s]) + length)
                spans.append([{"start": x, "stop": y} for x, y in zip(start.tolist(), stop.tolist(), strict=True)])
            columns = [batch.column(i) for i in range(len(names))]
            if cut:
                texts = columns[column].to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        raw = texts[i].encode()
                        spans[i] = own = whole_characters(raw, own)
                        texts[i] = kept_bytes(raw, own).decode()
                columns[column] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([*columns, pa.array(spans, kind)], [*names, "spans"])

    joined = _joined(docs, found, "left", "_node").select(*(docs[c] for c in names), "known", "windows")
    schema = ", ".join(f"`{c}` {t}" for c, t in given)
    out = joined.mapInArrow(tidy(run), f"{schema}, spans array<struct<start: long, stop: long>>")
    return unmasked(out, given_docs, masks, ["spans"])


def kept_bytes(raw: bytes, spans: list[dict]) -> bytes:
    at, out = 0, []
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["stop"]
    out.append(raw[at:])
    return b"".join(out)


def whole_characters(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans narrowed so that no character loses a part of its bytes."""
    out = []
    for s in spans:
        a, b = s["start"], s["stop"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append({"start": a, "stop": b})
    return out


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes removed, whole characters only, and n_removed."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    cut = removals(docs, length, cut=True)
    return cut.select(*(c for c in cut.columns if c not in ("spans", "n_removed")), removed.alias("n_removed"))


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``removals``."""

    def run(batches):
        for batch in batches:
            ids, n, removed, count, sha = batch.column(0), [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                n.append(len(raw))
                removed.append(sum(s["stop"] - s["start"] for s in spans))
                count.append(len(spans))
                sha.append(hashlib.sha256(kept_bytes(raw, spans)).hexdigest())
            yield pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(removals(docs))


OP10_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i) u
), firsts AS (
    SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), bad AS (
    SELECT doc_id, i, CASE WHEN i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh
    FROM g JOIN firsts USING (s) WHERE first < doc_id
), runs AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM bad
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
), cuts AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
    SELECT c.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS until, sum(b - a) AS removed, count(*) AS spans FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE head || substr(h, 2 * until + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
