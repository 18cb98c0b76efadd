"""Fill-in-middle against a plain version with regular expressions, and its SQL."""

import hashlib
import random
import re

import duckdb

from mdloom.llm import fill_in_middle as fim

from .fixtures import frame, rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    spm = h4 % 100 < 80
    return len(tokens), "spm" if spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def awkward():
    rng = random.Random(3)
    out = rows() + [(-5, "a b"), (None, "no id here"), (None, None), (8, "x <M> y"), (9, " \t\n\v\f\r "), (10, " a　b\x85c"), (11, "one"), (12, " lead"), (13, "trail ")]
    out += [(5000 + i, "".join(rng.choice(["a", "é", "漢", "👍", " ", "\n", "\x1c"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    return [*out, (77, "word and more " * 100_000), (77, "word and more " * 100_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_texts_are_cut_and_rebuilt(spark):
    data = awkward()
    whole = fim.fill_in_middle(frame(spark, data)).collect()
    digests = fim.digests(frame(spark, data)).collect()
    seen = set()
    for (doc_id, text), w, d in zip(data, whole, digests, strict=True):
        n, form, p, m, output = plain(doc_id, text)
        assert (w.doc_id, w.n, w.form, w.prefix, w.middle, w.output) == (doc_id, n, form, p, m, output)
        assert fim.restore(output.encode(), form).decode() == (text or "")
        sizes = (None, None) if p is None else (len(p), len(m))
        assert tuple(d) == (doc_id, n, form, *sizes, sha(output), sha(text or ""))
        seen.add(form)
    assert seen == {"plain", "spm", "psm"}
    assert fim.digests(frame(spark, data).limit(0)).count() == 0


def test_rates_are_parameters():
    forms = [fim.transform(i, b"some words here", rate=100, spm=0)[1] for i in range(50)]
    assert set(forms) == {"psm"} and {fim.transform(i, b"x", rate=0)[1] for i in range(50)} == {"plain"}


def test_ranked_bits():
    rng = random.Random(1)
    for width in (1, 2, 3, 17, 64, 1000):
        bits = rng.getrandbits(width)
        places = [i for i in range(width) if bits >> (width - 1 - i) & 1]
        assert [fim.nth(bits, k + 1, width) for k in range(len(places))] == places


def test_query_equals_its_sql(spark, tmp_path):
    frame(spark, awkward()).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op13_bit_parallel_fill_in_middle(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(fim.OP13_SQL).fetchall(), key=str)
