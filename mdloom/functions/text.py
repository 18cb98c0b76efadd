"""Scalar functions: spans, segments and cooked values, natively; delimiter runs by the kernel's rules."""

from __future__ import annotations

import json
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import grammar as g
from ..kernel import inlines as il
from ..kernel import render as r

# ---- native


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """The text of a byte span."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def span_contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at < end)


def span_empty(start: Column, end: Column) -> Column:
    return start == end


def segments_join(text: Column, segments: Column) -> Column:
    """Segments as text: lines joined, virtual spaces written out."""
    one = lambda s: F.concat(F.repeat(F.lit(" "), s["padding"]), span_slice(text, s["start"], s["end"]))
    return F.array_join(F.transform(segments, one), "\n")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def has_cjk(text: Column) -> Column:
    return text.rlike(g.CJK.pattern)


def literal_kind(text: Column) -> Column:
    mail = text.rlike(r"\A[A-Za-z0-9+\-._]+@(?=[^.]*[A-Za-z0-9_\-])(?:[A-Za-z0-9_\-]|\.(?=[A-Za-z0-9]))*\.(?:[A-Za-z0-9_\-]|\.(?=[A-Za-z0-9]))*[A-Za-z]\z")
    return F.when(text.rlike(r"(?i)\Ahttps?://"), "Http").when(mail, "Email").otherwise("Www")


def canonical_inputs(html: Column) -> Column:
    """``<input>`` attributes in order, so that renderers that differ in it compare equal."""
    parts = F.split(html, r"(?=<input )|(?<=/>)")
    attributes = lambda x: F.array_join(F.array_sort(F.split(F.regexp_replace(x, r"\A<input | ?/>\z", ""), " ")), " ")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("<input "), F.concat(F.lit("<input "), attributes(x), F.lit(" />"))).otherwise(x)), "")


#: Pieces of raw text: an escape, a character reference, or what lies between.
_COOKED = r"(?s)\\[!-/:-@\[-`{-~]|&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z0-9]+);|[^\\&]+|."
#: Characters of an address that stand for themselves.
_PLAIN = "".join(re.escape(chr(b)) for b in sorted(r.SAFE))


def _pieces(text: Column, pattern: str, one) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one), "")


def code_point(n: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    fine = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode(raw: Column) -> Column:
    """Backslash escapes and character references, resolved; names are looked up in a constant map."""
    names = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"[0-9a-fA-F]+", 0)
        return (
            F.when(x.startswith("\\") & (F.length(x) == 2), F.substring(x, 2, 1))
            .when(x.rlike(r"\A&#[xX].+;\z"), code_point(F.conv(digits, 16, 10).cast("long")))
            .when(x.rlike(r"\A&#.+;\z"), code_point(digits.try_cast("long")))
            .when(x.rlike(r"\A&.+;\z"), F.coalesce(F.try_element_at(names, F.substring(x, F.lit(2), F.length(x))), x))
            .otherwise(x)
        )

    return F.when(raw.rlike(r"[\\&]"), _pieces(raw, _COOKED, one)).otherwise(raw)


def destination(raw: Column) -> Column:
    """A link destination without its angle brackets, decoded."""
    return decode(F.when(raw.startswith("<"), F.regexp_replace(raw, r"(?s)\A<(.*)>\z", "$1")).otherwise(raw))


def normalize_label(label: Column) -> Column:
    """The key under which a label is looked up: white space collapsed, each character folded by lower, upper, lower.

    Case functions right inside each other would be taken for one; an empty text between them keeps all three.
    """
    plain = F.btrim(F.regexp_replace(label, r"[\t\n\r ]+", " "), F.lit(" "))
    apart = lambda c: F.concat(c, F.lit(""))
    folded = _pieces(plain, r"(?s).", lambda c: F.lower(apart(F.upper(apart(F.lower(c))))))
    return F.when(label.rlike(r"\A[\x00-\x7F]*\z"), F.lower(plain)).otherwise(folded)


def encode_href(text: Column) -> Column:
    """An address as an attribute: bytes of unsafe characters by number, stray percent signs too."""

    def one(x: Column) -> Column:
        byte = F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")
        return F.when(x == "&", "&amp;").when(x == "%", "%25").when(x.rlike(rf"\A(?:%..|[{_PLAIN}]+)\z"), x).otherwise(byte)

    return _pieces(text, rf"(?s)%(?:[0-9A-Za-z]{{2}})?|[{_PLAIN}]+|.", one)


def title(joined: Column) -> Column:
    """A title's text from its joined lines, with its quotes."""
    lines = F.regexp_replace(joined, r"\n[ \t]+", "\n")
    return decode(F.substring(lines, F.lit(2), F.greatest(F.length(lines) - 2, F.lit(0))))


def html_inline(joined: Column) -> Column:
    """Inline HTML whose continuation lines lose up to three columns."""
    return F.regexp_replace(joined, r"\n(?: {0,2}\t| {1,3})", "\n")


# ---- by rules of a whole run of characters


@F.pandas_udf(T.StructType([T.StructField("can_open", T.BooleanType()), T.StructField("can_close", T.BooleanType())]))
def classify(marker: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows = [il.classify(m, b or "", a or "") for m, b, a in zip(marker, before, after, strict=True)]
    return pd.DataFrame(rows, columns=["can_open", "can_close"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("opener", T.IntegerType()), T.StructField("closer", T.IntegerType()), T.StructField("strong", T.BooleanType())])))
def pairs(runs: pd.Series) -> pd.Series:
    """Delimiter pairs of runs given as array<struct<marker, length, before, after>>."""
    made = lambda x: [{"opener": a, "closer": b, "strong": s} for a, b, s in il.pairs([(q["marker"], q["length"], q["before"] or "", q["after"] or "") for q in x])]
    return runs.map(made, na_action="ignore")
