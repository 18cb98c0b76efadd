"""Native cooked values against the kernel's, on random raw texts and on every character that has a case."""

import random
import sys

from pyspark.sql import functions as F

from mdloom.functions import text as t
from mdloom.kernel import grammar as g
from mdloom.kernel import render as r

PARTS = ["\\", "\\*", "\\a", "&", "&amp;", "&amp", "&#65;", "&#x1F600;", "&#0;", "&#xD800;", "&#1114112;", "&#12345678;", "&#xABCDEF1;", "&nosuch;", "&ngE;", "&;", "&#;", "é", "漢", "😀", " ", "\n", "\n  ", "\n \t ", "\n    x",
         "a", "Z9", "%", "%2", "%zz", "%4G", "<", ">", '"', "'", "(", ")", "[", "]", "$", "^", "`", "{", "-", "~", "/?#@:", "\u0000", " "]


def test_cooked_values_equal_the_kernel(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    quoted = F.concat(F.lit('"'), "x", F.lit('"'))
    got = df.select("x", t.decode(F.col("x")).alias("decoded"), t.encode_href(F.col("x")).alias("href"), t.title(quoted).alias("title"), t.html_inline(F.col("x")).alias("html")).collect()
    for row in got:
        if row.x is None:
            assert tuple(row) == (None,) * 5
            continue
        raw, at, pieces = row.x.encode(), 0, []
        for line in raw.split(b"\n"):
            pieces.append((at, at + len(line), 0))
            at += len(line) + 1
        lines = [x if i == 0 else x.lstrip(" \t") for i, x in enumerate(row.x.split("\n"))]
        want = (g.decode(row.x), r.encode_href(row.x), g.decode("\n".join(lines)), r.join_stripped(raw, pieces, 3))
        assert tuple(row)[1:] == want, row.x


def test_labels_fold_like_the_kernel(spark):
    letters = [chr(c) for c in range(sys.maxunicode) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c))]
    labels = letters + [f" {a}\t\n{b} " for a, b in zip(letters[::3], letters[1::3])] + ["ẞ", "ss", "σς", "ﬀ", "İ", "　x", None, ""]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select("x", t.normalize_label(F.col("x")).alias("key")).collect()
    differ = [row for row in rows if row.x is not None and row.key != g.normalize_label(row.x)]
    assert not differ, differ[:10]
