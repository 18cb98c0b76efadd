"""BPE encoding and decoding in batched numpy rounds.

The texts of a batch lie in one byte buffer. Byte classes cut it into words, the vocabulary's pre-tokens;
equal words of a batch are found by sorting their hashes and encoded once, and hashes of recent words are
kept in sorted arrays. Words that are not known are encoded together: their symbols lie in one flat array,
each pair's rank is found by binary search over the sorted pair keys, and every round merges each word's
lowest-ranked pair wherever it stands. Decoding gathers the bytes of ids from a flat table.

The byte classes decide for ASCII and the letters of Latin-1; a text with other characters, or one that
spells a special token, goes to the tokenizers package whole. Words are told apart by 64-bit hashes.

Defined cases: null text is empty and has no ids; special tokens written out in a text become their ids, as
in the tokenizers package; repeated rows are each encoded; an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hasher, portions, ranges, table, tidy, utf8

KNOWN = 400_000
#: Bytes of text that are worked on at once: numpy holds some fifty bytes for each.
SUB_BATCH = 1 << 19
SUFFIX = "</w>"
LETTER, DIGIT, OTHER, SPACE, BREAK = 1, 2, 3, 4, 5


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies, by rule: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file as flat arrays. ``suffixed``: words end in symbols of their own, are lower case, and keep no space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.suffixed = spec["model"]["end_of_word_suffix"] == SUFFIX
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelt = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            spelt[i] = bytes(letters[c] for c in token.removesuffix(SUFFIX if self.suffixed else "\0")) + b" " * (self.suffixed and token.endswith(SUFFIX))
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        order = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.base = np.array([vocab[c] for c in order], np.int64)
        self.last = np.array([vocab[c + SUFFIX] for c in order], np.int64) if self.suffixed else self.base
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        keys = np.array([a << 20 | b for a, b, _ in pairs], np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[by], by.astype(np.int64), np.array([m for *_, m in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search; the number of pairs where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))


def merge_rounds(v: Vocabulary, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, numbers of ids) of words whose bytes stand one after another; every word has one byte at least."""
    none = len(v.keys)
    symbols = v.base[data]
    ends = np.cumsum(sizes)
    symbols[ends - 1] = v.last[data[ends - 1]]
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rank = np.full(len(symbols), none, np.int64)
    same = word[:-1] == word[1:]
    rank[:-1][same] = v.ranks(symbols[:-1][same], symbols[1:][same])
    done_word, done = [], []
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        of_word = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
        active = of_word < none
        if not active.all():
            done_word.append(word[~active])
            done.append(symbols[~active])
            symbols, word, rank, of_word = symbols[active], word[active], rank[active], of_word[active]
        if not len(symbols):
            break
        i = np.flatnonzero(rank == of_word)
        run = np.r_[True, np.diff(i) > 1]  # of a run of overlapping hits, every other one counts
        begin = np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
        i = i[(np.arange(len(i)) - begin) % 2 == 0]
        symbols[i] = v.merged[rank[i]]
        keep = np.ones(len(symbols), bool)
        keep[i + 1] = False
        now = np.cumsum(keep) - 1
        symbols, word, rank, i = symbols[keep], word[keep], rank[keep], now[i]
        for j in (i[i > 0] - 1, i):  # only pairs beside a merged symbol have new ranks
            last = j + 1 >= len(word)
            rank[j[last]] = none
            j = j[~last]
            inside = word[j] == word[j + 1]
            rank[j[~inside]] = none
            j = j[inside]
            rank[j] = v.ranks(symbols[j], symbols[j + 1])
    at, ids = np.concatenate(done_word), np.concatenate(done)
    return ids[np.argsort(at, kind="stable")].astype(np.uint32), np.bincount(at, minlength=len(sizes))


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[65:91] = out[97:123] = out[128:] = LETTER
    out[48:58] = DIGIT
    out[9:14], out[32] = BREAK, SPACE
    return out


CLASS = _classes()


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the letters of Latin-1."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    return np.where(second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 32, out).astype(np.uint8)


def word_starts(data: np.ndarray, offsets: np.ndarray, suffixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the pre-tokens of texts in ``data``: by class, with one space before, contractions apart."""
    cls = CLASS[data]
    before, after = np.zeros_like(cls), np.zeros_like(cls)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    before[edge] = 0
    after[edge[1:] - 1] = 0
    blank = cls >= SPACE
    if suffixed:
        start = (before != cls) | (cls == DIGIT)
    else:
        start = np.where(blank, (before < SPACE) | (after > 0) & (after < SPACE), (before != cls) & (before != SPACE))
    quotes = np.flatnonzero(start & (data == 0x27))
    if len(quotes):
        end = offsets[np.searchsorted(offsets, quotes, "right")]
        padded = np.r_[data, np.zeros(2, np.uint8)]
        one, two = padded[quotes + 1], padded[np.minimum(quotes + 2, len(data) + 1)]
        short = (quotes + 1 < end) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (quotes + 2 < end) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        for found, size in ((short, 2), (long, 3)):
            start[quotes[found] + 1] = False
            if size == 3:
                start[quotes[found] + 2] = False
            then = quotes[found] + size
            start[then[then < end[found]]] = True
    at = np.flatnonzero(start)
    size = np.diff(np.r_[at, len(data)])
    if suffixed:
        word = cls[at] < SPACE
        at, size = at[word], size[word]
    return at, size


class Encoder:
    """Whole texts to ids. ``whole``: encodes texts beyond the byte classes."""

    def __init__(self, v: Vocabulary, whole):
        self.v, self.whole = v, whole
        self.hashes, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.hasher = Hasher()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of every text, one after another."""
        data, offsets = utf8(texts)
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in portions(offsets, SUB_BATCH):
            own = offsets[lo : hi + 1]
            flat, count = self._portion(data[own[0] : own[-1]], own - own[0], texts.slice(lo, hi - lo))
            flats.append(flat)
            counts.append(count)
        return np.concatenate(flats), np.r_[0, np.cumsum(np.concatenate(counts))]

    def _portion(self, data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(offsets) - 1, np.diff(offsets)
        lead = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1]
        odd = (data >= 0x80) & ~lead & ~(second & (data != 0x97) & (data != 0xB7))
        odd[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # "<|", as special tokens start
        beyond = np.zeros(n, bool)
        beyond[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        if not beyond.any():
            return self._plain(data, offsets)
        flat, count = self._plain(data[np.repeat(~beyond, size)], np.r_[0, np.cumsum(size[~beyond])])
        parts, counts, at, ends = [], np.zeros(n, np.int64), 0, np.r_[0, np.cumsum(count)]
        counts[~beyond] = count
        left = np.cumsum(~beyond)
        others = self.whole(texts.filter(pa.array(beyond)).to_pylist())
        for i, ids in zip(np.flatnonzero(beyond).tolist(), others, strict=True):
            parts += [flat[ends[at] : ends[left[i]]], ids]
            at, counts[i] = left[i], len(ids)
        return np.concatenate([*parts, flat[ends[at] :]]), counts

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if self.v.suffixed:
            data = lower(data)
        at, size = word_starts(data, offsets, self.v.suffixed)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        hashes = self.hasher(data, at, size)
        word, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.minimum(np.searchsorted(self.hashes, word), max(0, len(self.hashes) - 1))
        known = self.hashes[found] == word if len(self.hashes) else np.zeros(len(word), bool)
        start, count = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        start[known], count[known] = self.starts[found[known]], self.sizes[found[known]]
        if not known.all():
            new = first[~known]
            ids, sizes = merge_rounds(self.v, data[ranges(at[new], size[new])], size[new])
            start[~known], count[~known] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.ids = np.concatenate([self.ids, ids])
        out_size = count[which]
        flat = self.ids[ranges(start[which], out_size)]
        ends = np.r_[0, np.cumsum(out_size)]
        marks = np.searchsorted(at, offsets)
        if not known.all():
            self._remember(word, start, count, known)
        return flat, np.diff(ends[marks])

    def _remember(self, word: np.ndarray, start: np.ndarray, count: np.ndarray, known: np.ndarray) -> None:
        if len(self.hashes) + int((~known).sum()) > KNOWN:  # only the words of this portion stay
            self.ids = self.ids[ranges(start, count)]
            self.hashes, self.starts, self.sizes = word, np.cumsum(count) - count, count
            return
        both = np.concatenate([self.hashes, word[~known]])
        order = np.argsort(both, kind="stable")
        self.hashes = both[order]
        self.starts = np.concatenate([self.starts, start[~known]])[order]
        self.sizes = np.concatenate([self.sizes, count[~known]])[order]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of the vocabulary at ``path``; kept by each Python worker."""

    @lru_cache(1)
    def library():  # loaded by the first text that needs it
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path)
        out.no_truncation()
        out.no_padding()
        return out

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in library().encode_batch_fast(texts, add_special_tokens=False)]

    return Encoder(vocabulary(path), whole)


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts that ids spell, in UTF-8; bytes that are no UTF-8 become U+FFFD."""
    size = v.sizes[ids]
    flat = v.bytes[ranges(v.at[ids], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][offsets].tolist()
    raw = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.array([r.decode(errors="replace") for r in raw], pa.string())


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and the text that those ids give back."""

    def run(batches):
        encode, v = encoder(path), vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, offsets = encode(part.column(1))
                yield pa.record_batch([part.column(0), lists(ids, offsets), decode(v, ids, offsets)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def op4_merge_rounds_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
