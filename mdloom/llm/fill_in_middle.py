"""Fill-in-middle transformation by big-integer bit-parallelism.

A text's UTF-8 bytes become masks of one bit a byte, the first byte highest: ``bytes.translate`` writes each byte's
class as a binary digit, and one conversion makes the number. A byte ends a token if it is no white space and
the byte after it is; shifted boolean operations find all such bytes at once, ``bit_count`` gives their number, and
the k-th is found by halving: a half's ``bit_count`` says in which half it lies. White space is ASCII,
so that bytes and code points agree on where tokens end.

Each document's cuts and form come from a hash of its doc_id alone. No row needs another one: there is no shuffle.

Defined cases: null counts as empty; an empty text has no tokens and stays plain, as does a text that holds a sentinel;
a null doc_id is hashed as an empty string; rows that share a doc_id are cut alike; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100: documents that are transformed, and of these the share of suffix-prefix-middle.
RATE, SPM = 50, 80

_SPACE = b" \t\n\v\f\r"
_WORDS = bytes(ord("0") if c in _SPACE else ord("1") for c in range(256))
_STARTS = bytes(ord("0") if 0x80 <= c < 0xC0 else ord("1") for c in range(256))

FRAME = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def mask(data: bytes, classes: bytes) -> int:
    """One bit a byte, the first byte highest."""
    return int(data.translate(classes) or b"0", 2)


def ends(data: bytes) -> int:
    """The mask of bytes that end a token."""
    if not data:
        return 0
    words = mask(data, _WORDS)
    return words & ~(words << 1) | (~words & 1)  # white space at the end is a token of its own


def nth(bits: int, k: int, width: int) -> int:
    """Place, counted from the highest of ``width`` bits, of the ``k``-th set bit (from 1)."""
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        n = high.bit_count()
        if k <= n:
            bits, width = high, width - low
        else:
            bits, width, at, k = bits & ((1 << low) - 1), low, at + width - low, k - n
    return at


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(doc_id: int | None, data: bytes, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, tuple[bytes, bytes, bytes] | None, bytes]:
    """(tokens, form, (prefix, middle, suffix) or None, output)."""
    bits = ends(data)
    n = bits.bit_count()
    a, b, c, d = draws(doc_id, seed)
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= rate:
        return n, "plain", None, data
    lo, hi = (nth(bits, k, len(data)) + 1 if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = data[:lo], data[lo:hi], data[hi:]
    if d % 100 < spm:
        return n, "spm", (prefix, middle, suffix), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", (prefix, middle, suffix), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of ``form`` was made from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _mapped(docs: DataFrame, row, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            rows = [row(d, t or b"") for d, t in zip(ids, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {n: {"long": pa.int64(), "string": pa.string()}[t] for n, t in (f.split(" ") for f in schema.split(", "))}
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS binary) AS text").mapInArrow(tidy(run), schema)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for (doc_id, text); the parts are null where form is plain."""

    def row(doc_id, data):
        n, form, cut, output = transform(doc_id, data, seed, rate, spm)
        return doc_id, n, form, *(x.decode() for x in cut or ()), *(() if cut else (None,) * 3), output.decode()

    return _mapped(docs, row, FRAME)


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per document: sizes of its parts in code points, and sha256 of its output and of the text rebuilt from it."""

    def row(doc_id, data):
        n, form, cut, output = transform(doc_id, data, seed, rate, spm)
        chars = [mask(x, _STARTS).bit_count() for x in cut[:2]] if cut else [None, None]
        return doc_id, n, form, *chars, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()

    return _mapped(docs, row, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_bit_parallel_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


_HASH = "sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), '')))"
OP13_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, {_HASH} AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
    FROM documents
), e AS (
    SELECT doc_id, t, tokens, len(tokens) AS n,
           [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r
    FROM d
), f AS (
    SELECT doc_id, t, tokens, n,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
           least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi
    FROM e
), g AS (
    SELECT doc_id, t, n, form, coalesce(array_to_string(tokens[1:lo], ''), '') AS p,
           coalesce(array_to_string(tokens[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(tokens[hi + 1:n], ''), '') AS s
    FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END)
           AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE concat(p, m, s) END) AS restored_sha256
FROM g
"""
