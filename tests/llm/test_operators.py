"""Each operator against a brute-force version on a small table with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mdloom.llm import bpe, exact_dedup, jaccard, line_dedup, packing, quality, sharding, suffix_dedup, token_output, top_k
from mdloom.llm.common import components

from .fixtures import frame, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EMPTY = "doc_id long, text string"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_sharding_balances_bytes_and_leaves_no_gaps(spark):
    data = rows() + [(5, "same")] * 9 + [(None, "nobody")] * 3
    got = sharding.shard(frame(spark, data), shards=5).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, zlib.crc32((t or "").encode())) for d, t in data)
    for r in got:
        assert r["size"] >= 16
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in got)
    for s in load:
        assert sorted(r["slot"] for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("slots", [64, 16384])
def test_many_equal_rows_are_spread_over_shards(spark, slots):
    data = [(7, "the same row"), (None, "a row without an id")] * 500 + [(100 + i, f"another row of about so many bytes {i}") for i in range(100)]
    got = sharding.shard(frame(spark, data).repartition(3), shards=4, slots=slots).collect()
    load, rows = Counter(), Counter()
    for r in got:
        load[r.shard] += r["size"]
        rows[r.shard] += 1
    assert len(load) == 4 and max(load.values()) <= 1.1 * min(load.values())
    for s in rows:
        assert sorted(r["slot"] for r in got if r.shard == s) == list(range(rows[s]))


def test_a_slot_map_is_edited_again(spark):
    docs, slot_map = frame(spark, rows()), sharding.SlotMap(spark)
    first = sharding.shard(docs, shards=4, slots=64, slot_map=slot_map).count()
    owner = slot_map.owner(2)
    again = sharding.shard(docs, shards=4, slots=64, slot_map=slot_map)
    assert first == again.count() == docs.count() and slot_map.latest() == 3 and slot_map.owner(3) == owner
    more = sharding.shard(docs, shards=5, slots=64, slot_map=slot_map)
    assert more.count() == first and {r.shard for r in more.collect()} == set(range(5))
    with pytest.raises(ValueError):
        sharding.shard(docs, shards=3, slots=64, slot_map=slot_map)


def test_a_new_shard_takes_slots_only_into_itself():
    owner = sharding.first_map(64, 4)
    load = [random.Random(i).randint(0, 50) for i in range(64)]
    after = sharding.grow(owner, load, 4)
    assert all(a == b or b == 4 for a, b in zip(owner, after, strict=True)) and 4 in after


def test_exact_dedup(spark):
    data = rows() + [(7, "same"), (9, "same"), (9, "same"), (None, "nobody")]
    groups = {}
    for d, t in data:
        groups.setdefault(t or "", []).append(d)
    want = Counter()
    for d, t in data:
        own = groups[t or ""]
        top = max((x for x in own if x is not None), default=None)
        want[d, top, len(own), d == top, sha((t or "").encode())] += 1
    got = exact_dedup.dedup(frame(spark, data), capacity=4)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert exact_dedup.dedup(spark.createDataFrame([], EMPTY)).count() == 0


def test_directory_splits_overfull_buckets_and_doubles():
    depth, cells, buckets = exact_dedup.directory({0: 100, 1: 1, 8: 3}, depth=4, capacity=10)
    assert depth == 4 and len(cells) == 16 and (0, 4) in buckets and cells[8] == cells[15]


def brute_components(data):
    sets, parent = {}, {}
    for d, t in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("limits", [{}, {"STAR_ROUNDS": 0, "CROWD": 2, "PORTION": 3}])
def test_jaccard_components(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    data = rows(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, data)).collect()}
    assert got == brute_components(data)


def test_jaccard_awkward_rows(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None)]
    got = sorted(map(tuple, jaccard.link(frame(spark, data)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard.link(spark.createDataFrame([], EMPTY)).count() == 0
    assert jaccard.one_of_each(frame(spark, data)).where("doc_id = 2").count() == 0


def test_jaccard_links_negative_ids(spark):
    data = [(-5 - d if d % 2 else d, t) for d, t in rows(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(frame(spark, data)).collect()}
    assert got == brute_components(data)


def test_jaccard_links_every_text_of_a_doc_id(spark):
    one, two = " ".join(f"a{i}" for i in range(41)), " ".join(f"b{i}" for i in range(41))
    data = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, "some other text of a few words")]
    got = sorted(map(tuple, jaccard.link(frame(spark, data)).collect()))
    assert got == [(1, 37, 1), (1, 37, 1), (2, 38, 1), (3, 38, 1), (4, 3, 4)]


def test_every_similar_pair_shares_a_block():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 7, 11, 40, 300):
        for _ in range(30):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a[rng.random(n) > 0.08]
            b = np.concatenate([b, rng.integers(0, 2**63, max(0, n // 12)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not both or both < 0.8 * len(np.union1d(a, b)):
                continue
            value = np.concatenate([np.unique(a), np.unique(b)])
            owner = np.repeat([0, 1], [len(np.unique(a)), len(np.unique(b))])
            doc, key = jaccard.block_keys(owner, value, np.bincount(owner))
            assert set(key[doc == 0]) & set(key[doc == 1])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.doc: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 140)}


def test_bpe_equals_the_library_and_decodes(spark):
    data = rows() + [(1, "<|endoftext|>x  y"), (2, "it's I'LL 've''s 12x3\r\n\t  é×ß")]
    out = {(r.doc_id): r for r in bpe.encode_and_decode(frame(spark, data), BYTE).collect()}
    tk = Tokenizer.from_file(BYTE)
    for d, t in data:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert out[d].ids == ids and out[d].decoded == tk.decode(ids, skip_special_tokens=False)
    assert bpe.encode_and_decode(spark.createDataFrame([], EMPTY), BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_bpe_on_random_texts(path):
    rng, tk, own = random.Random(1), Tokenizer.from_file(path), bpe.encoder(path)
    for letters in ("aab'  \n\t stvelrmd.,!12", "aB'  \n\t éßÉÀ×÷ü.", "a'  \n٣漢ΑΣς İ 　\x1c\x85👍🏽́"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(300)]
        ids, at = own(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_decode_replaces_bytes_that_are_no_text():
    v = bpe.vocabulary(BYTE)
    ids = bpe.encoder(BYTE)(pa.array(["👍"]))[0][:1]
    assert bpe.decode(v, ids, np.array([0, 1])).to_pylist()[0].startswith("�")


def test_quality_learns_only_from_rows_that_are_not_held_out(spark):
    good = [(i, "Plain words stand here in order. " * 3 + f"Number {i}.") for i in range(60)]
    bad = [(100 + i, "$$$ ### !!! " * 9 + str(i)) for i in range(60)]
    docs = frame(spark, good + bad + [(500, None), (501, "")])
    labels = [(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(500, None, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    assert all(got[d].predicted == 1 for d, _ in good) and all(got[d].predicted == 0 for d, _ in bad)
    kept = {r.doc_id for r in quality.filtered(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == pytest.approx({d: r.score for d, r in got.items()})
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_top_k_is_exact_beyond_longs(spark):
    rng = random.Random(5)
    data = [(i, [rng.choice([-1.0, 1.0]) * 2.0 ** rng.randint(0, 56) for _ in range(3)]) for i in range(60)]
    data += [(2**63 - 1, [2.0**56] * 3), (None, [-(2.0**56)] * 3), (2**63 - 21, [1.0, 2.0, 3.0]), (71, [1e300, 0.0, 0.0])]
    v = top_k.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = {}
    for r in top_k.search(v, v.where("vec_id % 20 = 0"), 9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ints = [(i, [int(64 * x) for x in e]) for i, e in data[:-1]]
    for q, e in ints:
        if q is not None and q % 20 == 0:
            scores = [(sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in ints if i != q]
            best = sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:9]
            assert got[q] == {k + 1: (i, s if -(2**63) <= s < 2**63 else None) for k, (s, i) in enumerate(best)}


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = random.Random(2)
    data = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(300)]
    data += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (480, [0.5]), (3, [0.5] * 6)]
    frame_ = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    v = top_k.usable(frame_)
    got = sorted(map(tuple, top_k.search(v, v.where("vec_id % 20 = 0"), 5).collect()))
    fine = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in data if e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, e in fine:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), i) for i, f in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert top_k.search(v.limit(0), v.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_automaton_and_prefix(spark):
    rng, data = random.Random(2), []
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        data.append(("".join(a), "".join(b)))
    pairs = spark.createDataFrame(data, "x string, y string")
    for k in (1, 2):
        for r in pairs.select("x", "y", line_dedup.within(F.col("x"), F.col("y"), k).alias("w")).collect():
            assert r.w == (distance(r.x, r.y) <= k)


def brute_lines(data, threshold=2, near=line_dedup.NEAR):
    found = [(d, i, line.strip(" \t\r")) for d, t in sorted(data, key=lambda x: x[0]) if t is not None for i, line in enumerate(t.split("\n"))]
    found = [x for x in found if x[2]]
    kinds = list(dict.fromkeys(x[2] for x in found))
    parent = {k: k for k in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kinds:
        for b in kinds:
            if a < b and min(len(a), len(b)) >= near and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                parent[find(a)] = find(b)
    seen, gone = set(), set()
    for d, i, k in found:
        if find(k) in seen:
            gone.add((d, i))
        seen.add(find(k))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t is not None else None for d, t in data}


def test_line_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(30, 44))) + "x" for _ in range(12)]

    def edited(line):
        b = list(line)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        return "".join(b)

    data = [(i, "\n".join(rng.choice([edited(rng.choice(base)), "short", "", "  " + rng.choice(base)]) for _ in range(6))) for i in range(40)]
    data += [(900, None), (901, "")]
    got = line_dedup.dedup_lines(frame(spark, data))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(data)
    assert got.columns == [*frame(spark, data).columns, "n_lines", "n_dropped"]
    same = frame(spark, [(1, "a\nb"), (1, "a\nb"), (2, "c\na")])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(same).where("doc_id = 2").collect()} == {2: "c"}
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def reach(n):
    """The threshold that op7 states for a shorter line of n characters."""
    return 0 if n < 3 else 1 if n < 24 else 2 if n < 60 else 3 if n < 80 else max(4, n // 32)


def test_line_dedup_threshold_grows_with_length(spark):
    rng = random.Random(7)
    words = ["ab", "cdée", "fghij", "klm", "nopqrstuvwxyzabcd", "漢字漢字👍👍👍👍", "e", "st,"]

    def line(n):
        return " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))[:n].strip() + "."

    def edited(text, edits):
        b = list(text)
        for i in rng.sample(range(len(b)), edits):
            b[i] = rng.choice(["", "Q", b[i] + "Z"])
        return "".join(b)

    def spaced(text, edits):
        """Edits at even distances leave the shortest common pieces."""
        b = list(text)
        for i in range(edits):
            b[(i + 1) * len(b) // (edits + 1)] = "#"
        return "".join(b)

    sizes = [32, 45, 59, 60, 61, 79, 80, 83, 99, 124, 127, 128, 130, 131, 160, 162, 199, 255, 256, 259, 330, 512, 530]
    bases = [line(n) for n in sizes]
    kinds = [x for b in bases for x in (b, edited(b, reach(len(b))), edited(b, reach(len(b)) + 2), spaced(b, reach(len(b))), spaced(b, reach(len(b)) + 1))]
    near = {(a, b) for a in kinds for b in kinds if a < b and abs(len(a) - len(b)) <= reach(min(len(a), len(b))) and distance(a, b) <= reach(min(len(a), len(b)))}
    assert sum(min(map(len, x)) >= 60 and distance(*x) > 2 for x in near) > 30
    docs = frame(spark, list(enumerate(kinds)))
    ids = {r.id: r.line for r in line_dedup.lines(docs).collect()}
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in line_dedup.near_links(docs).collect()} == near
    text = "word " * 30
    assert line_dedup.dedup_lines(frame(spark, [(1, text + "one"), (2, text + "six")])).where("n_dropped = 1").count() == 1


def test_line_dedup_links_short_lines(spark):
    rng = random.Random(11)
    kinds = ["Ly. Reonhe onble.", "Ly reonhe onble.", "Heti eror anesti.", "Heti, eror anesti.", "a", "b", "ab", "ac", "abc", "abd", "漢字👍", "漢字"]
    for n in (3, 4, 5, 7, 11, 22, 23, 24, 25, 26, 30, 31):
        base = "".join(rng.choice("abcdé ") for _ in range(n - 1)).strip().ljust(n - 1, "q") + "x"
        kinds += [base, base[:1] + "#" + base[2:], "#" + base, base[: n // 2] + base[n // 2 + 1 :], base[:1] + "##" + base[2:], "##" + base[1:-1] + "#"]
    kinds = list(dict.fromkeys(kinds))
    near = {(a, b) for a in kinds for b in kinds if a < b and distance(a, b) <= reach(min(len(a), len(b)))}
    docs = frame(spark, list(enumerate(kinds)))
    ids = {r.id: r.line for r in line_dedup.lines(docs).collect()}
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in line_dedup.near_links(docs).collect()} == near
    assert ("Ly reonhe onble.", "Ly. Reonhe onble.") not in near and ("Heti eror anesti.", "Heti, eror anesti.") in near


def test_quality_tells_long_words_apart():
    long = "漢" * 40
    data = np.frombuffer(f"{long}a {long}b {long}b".encode(), np.uint8)
    raw = quality.counts(data, np.array([0, len(data)]))
    k = len(quality.CLASSES) + 1
    assert raw[0, k] == 3 and raw[0, k + 1] == 2 and raw[0, k + 5] == 1


def test_packing(spark):
    data = rows() + [(1, "word " * 9000), (2, None), (2, None)]
    out = packing.pack_documents(frame(spark, data), WORD).collect()
    tk, want = Tokenizer.from_file(WORD), Counter()
    for d, t in data:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[d, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in out) // 4096)
    assert packing.pack_documents(spark.createDataFrame([], EMPTY), WORD).count() == 0


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(200):
        lengths = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for n, c in lengths.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        room = rng.randint(1, 60)
        got = packing.fullest(room, sorted(lengths.items(), reverse=True))
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room) and all(k <= lengths[n] for n, k in got)


def test_huffman_files(spark):
    data = rows() + [(-5, "first"), (2000, None)]
    got = sorted(map(tuple, token_output.write_and_read(frame(spark, data), BYTE).collect()))
    tk, at, want = Tokenizer.from_file(BYTE), 0, []
    for d, t in sorted(data, key=lambda x: x[0]):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_output.write_and_read(frame(spark, [(1, "a"), (1, "b"), (None, "c")]), BYTE).count() == 3
    assert token_output.write_and_read(spark.createDataFrame([], EMPTY), BYTE).count() == 0


def test_huffman_files_are_read_by_their_path_alone(spark):
    ids = token_output.encoded(frame(spark, rows()), BYTE)
    path = token_output.write(ids, token_output.code_lengths(token_output.count_ids(ids)))
    want = sorted(map(tuple, token_output.write_and_read(frame(spark, rows()), BYTE).collect()))
    assert sorted(map(tuple, token_output.read(spark.newSession(), path).collect())) == want


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 60):
        counts = rng.integers(1, 1000, n)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((token_output.code_lengths(counts, 16) * counts).sum()) == cost
    skewed = token_output.code_lengths(2 ** np.arange(30), 8)
    assert skewed.max() <= 8 and (2.0 ** -skewed.astype(float)).sum() <= 1
    ids = rng.integers(0, 30, 1000)
    lengths = token_output.code_lengths(np.bincount(ids, minlength=30))
    bits, marks = token_output.write_bits(ids, lengths, token_output.canonical(lengths))
    assert (token_output.read_bits([(bits, marks, 1000)], token_output.decode_table(lengths))[0] == ids).all()


def brute_removed(data, length=50):
    out = []
    for d, t in data:
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        pool = [(u or "").encode() for e, u in data if d is not None and e is not None and e < d]
        for p in range(len(raw) - length + 1):
            if any(raw[p : p + length] in u for u in pool):
                hit[p : p + length] = b"\1" * length
        spans = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((d, len(raw), sum(hit), spans, sha(bytes(b for b, h in zip(raw, hit, strict=True) if not h))))
    return Counter(out)


@pytest.mark.parametrize("records", [None, 50])
def test_prefix_doubling(spark, monkeypatch, records):
    if records:
        monkeypatch.setattr(suffix_dedup, "RECORDS", records)
    data = rows(6, 30) + [(None, "x" * 400), (90, "shared id " * 9), (90, "x" * 90 + "y"), (91, "x" * 90 + "y")]
    docs = frame(spark, data)
    assert Counter(map(tuple, suffix_dedup.digest(suffix_dedup.removals(docs)).collect())) == brute_removed(data)
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == [*docs.columns, "n_removed"] and cut.count() == len(data)


def test_prefix_doubling_with_large_ids(spark):
    passage = "a passage of well over fifty bytes that is repeated in other documents"
    big = 6 * 10**18
    data = [(-big, passage), (big, "first " + passage), (big, "other " + passage), (big + 1, passage + " end")]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.digest(suffix_dedup.removals(frame(spark, data))).collect())
    n = len(passage)
    assert got == [(-big, 0), (big, n), (big, n), (big + 1, n)]


def test_prefix_doubling_of_nothing(spark):
    assert suffix_dedup.digest(suffix_dedup.removals(spark.createDataFrame([], EMPTY))).count() == 0


def test_spans_keep_whole_characters():
    raw = "aé漢b".encode()
    assert suffix_dedup.whole_characters(raw, [{"start": 2, "stop": 5}]) == [{"start": 3, "stop": 3}] or suffix_dedup.whole_characters(raw, [{"start": 2, "stop": 5}]) == []
    assert suffix_dedup.whole_characters(raw, [{"start": 1, "stop": 6}]) == [{"start": 1, "stop": 6}]
