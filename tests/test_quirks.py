"""The shapes on which parsers differ, against plain patterns over whole texts."""

import random
import re

import pytest

from mdloom.operators.invariants import known_quirks
from mdloom.sources import corpus

INDENT, SOLID, BLANK, MARKER = r"(?: {0,3}\t| {4})", r"[^ \t\r\n]", r"[ \t]*\r?\n", r"(?:[-+*]|[0-9]{1,9}[.)])"
OPENER, NAMED = rf"[ \t]{{0,3}}(?:>|{MARKER}[ \t])", r"[^\W_]|[_{\[]"
ITEM = rf"{MARKER}(?:[ \t]|\r?\n|\Z)"


def has(pattern, text, flags=re.M):
    return bool(re.search(pattern, text, flags))


def failed_tag(text):
    for opener, closer in ((r"^[ \t]{0,3}\{%", r"%\}[ \t]*\r?$"), (r"^[ \t]{0,3}\{\{", r"\}\}[ \t]*\r?$")):
        for m in re.finditer(opener, text, re.M):
            close = re.compile(closer, re.M).search(text, m.end())
            container = re.compile(r"^[ \t]{0,3}(?:>|[-+*][ \t]+\S|0{0,8}1[.)][ \t]+\S|\[\^[^\]\s]+\]:)", re.M).search(text, m.end())
            lost = close is None or container is not None and container.start() < close.start()
            if lost and re.compile(r"^[ \t]{0,3}(?:[-+*#<>`~$]|[0-9]{1,9}[.)])", re.M).search(text, m.end()):
                return True
    return False


def forward(text):
    first = text.find("[")
    for m in re.finditer(rf"^[ \t]{{0,3}}:{{3,}}[ \t]*(?:{NAMED})", text, re.M):
        if 0 <= first < m.start() and re.compile(r"^[ \t>]*\[[^\]\n]*\]:", re.M).search(text, m.end()):
            return True
    return False


PLAIN = {
    "deep_blank_in_code": lambda t: has(rf"^{INDENT}[ \t]*\r?$", t) and has(rf"^{INDENT}{SOLID}", t),
    "list_after_code": lambda t: has(rf"(?:\A|\n{BLANK}|\n{INDENT}[^\n]*\n){INDENT}[ \t]*{SOLID}[^\n]*\n(?:{BLANK})*(?:{OPENER})*[ \t]{{0,3}}{ITEM}", t, 0),
    "list_after_opened_container": lambda t: has(rf"[^\n]\r?\n(?:{OPENER})+[ \t]{{0,3}}{ITEM}", t, 0),
    "directive_in_item": lambda t: has(rf"^[ \t]{{0,3}}{MARKER}[ \t][^\n]*\n(?:[^\n]*\n)*?[ \t]+:{{3,}}[^ \t\r\n:][^\n]*\n(?:[^\n]*\n)*?{BLANK}", t),
    "directive_drops_footnotes": lambda t: has(r"^[^\n]*\[\^[^\n]*\r?\n[ \t]{0,3}:{3,}", t),
    "failed_liquid": failed_tag,
    "definition_in_directive": forward,
    "astral_punctuation": lambda t: has("[*_~][\U00010000-\U0010ffff]|[\U00010000-\U0010ffff][*_~]", t),
}


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_shapes(spark, ending):
    rng = random.Random(ending)
    tokens = [*corpus.WIDE, "- ", "> ", ":::note\n", "[x]: /u\n", "{% a\n", "{{\n", "%}\n", "\n", "\n\n", "    c\n", "\n  :::d\n", "[^1]\n", "1. x\n", "    \n"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(2, 30))).replace("\r\n", "\n").replace("\n", ending) for _ in range(2500)]
    got = known_quirks(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")).collect()
    seen = set()
    for r in got:
        text = texts[r.doc_id] if r.doc_id < len(texts) else ""
        for name, plain in PLAIN.items():
            assert r[name] == plain(text), (name, text)
            seen |= {name} if r[name] else set()
    assert seen == set(PLAIN)


@pytest.mark.parametrize(
    ("name", "text", "found"),
    [
        ("fence_meta_space", "> ``` a \nx", True), ("fence_meta_space", "``` a\nx ", False), ("fence_meta_space", "- $$ m\t\r\n", True), ("code_after_container", "> a\n\n    b\n    c", True),
        ("code_after_container", "> a\n\n    b\nc", False), ("loose_directive", "::: note\n", True), ("loose_directive", ":::note\n", False), ("loose_directive", ":::note[l]", True),
        ("directive_tab_or_astral", ":::\t\nx", True), ("directive_tab_or_astral", "> :::😀", True), ("directive_tab_or_astral", "::: x", False),
    ],
)
def test_chosen_shapes(spark, name, text, found):
    assert known_quirks(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()[name] == found


def test_long_texts(spark):
    text = "- x\n" + "    code\n" * 50_000 + "[a]\n" + "> " * 20_000 + "\n{% x\n" + "y\n" * 50_000
    assert known_quirks(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
    assert known_quirks(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().list_after_code is False
