"""Queries of the relational side: what Spark adds around the parse, over the driver's tables, each with its SQL."""

from __future__ import annotations

import os
import signal
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as lx
from ..functions import soup, variants
from ..functions import text as t
from ..kernel.constructs import Constructs
from ..operators import compare, invariants, resolve, sketches, totals, views
from ..operators.guard import guarded, node_rows
from ..operators.linestates import line_states
from ..operators.parse import blank_lines, parse_markdown, render_html
from ..sources import corpus
from ..sources.datasource import register
from ..sources.store import scratch, stored
from ..streaming import state
from .queries import _LINES, MARKERS, SQL, _marked_lines, _prose, query

# ---- rows that fail


def _planted(doc_id: int | None, source: bytes):
    """Bytes that the root node covers; some documents are made to fail, to kill their process, or to hang."""
    key = doc_id or 0
    if key % 97 == 5:
        raise ValueError(f"planted failure of {doc_id}")
    if key % 331 == 7:
        os.kill(os.getpid(), signal.SIGKILL)
    if key % 997 == 11:
        time.sleep(3600)
    nodes = node_rows(doc_id, source, inlines=False)
    return [(doc_id, nodes[0][9] - nodes[0][8])]


@query(
    """
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN CAST(strlen(coalesce(text, '')) AS BIGINT) END AS covered,
       CASE WHEN reason IS NOT NULL THEN CAST(strlen(coalesce(text, '')) AS BIGINT) END AS dead_bytes
FROM (SELECT *, CASE WHEN doc_id % 97 = 5 THEN 'exception' WHEN doc_id % 331 = 7 THEN 'crash' WHEN doc_id % 997 = 11 THEN 'timeout' END AS reason FROM documents)
"""
)
def md_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, parsed or in the dead-letter table, where some fail, kill their process or hang."""
    out = guarded(_prose(spark, sf_dir), _planted, "doc_id bigint, covered bigint", seconds=1.5)
    good = out.results.select("doc_id", F.lit(None).cast("string").alias("reason"), "covered", F.lit(None).cast("long").alias("dead_bytes"))
    return good.unionByName(out.dead.select("doc_id", "reason", F.lit(None).cast("long").alias("covered"), F.col("n_bytes").alias("dead_bytes")))


# ---- lines in context

#: Lines that take the place of those of a text, which stands where the percent sign is.
PLANTED = [
    "%", "%", "", "===", "%", "```", "%", "# %", "~~~ sql", "%", "~~~~", "<!-- %", "%", "-->", "<div>", "%", "", "a | b", "| - | - |", "%", "$$", "%", "    %", "- %", "%",
    "<pre>", "%", "</pre>", "", "2. %", "%", "---", "<a>", "````", "%", "", "> %", "[^n]: %", "", "{{ v }}", "::: note", "%", "-|-|-", "|x|\\||",
]


def _planted_lines(docs: DataFrame) -> DataFrame:
    """Texts whose every line has a marker of ``PLANTED``, so that what a line means hangs on those before it."""
    marker = lambda i: F.get(F.array(*map(F.lit, PLANTED)), F.pmod(F.col("doc_id") + (i * (i + 1) / 2).cast("long"), F.lit(len(PLANTED))).cast("int"))
    lines = F.transform(lx.split_lines(F.col("text")), lambda x, i: F.replace(marker(i), F.lit("%"), x))
    return docs.select("doc_id", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").alias("text"))


_SPLIT = r"""
split AS (
    SELECT doc_id, CASE WHEN text = '' THEN [] WHEN regexp_matches(text, '[\r\n]\z') THEN l[1:len(l) - 1] ELSE l END AS l
    FROM (SELECT doc_id, text, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL)
)"""
_MARKS = ", ".join(f"'{m}'" for m in PLANTED)
_STATES = rf"""
{_SPLIT.strip()}, raw AS (
    SELECT doc_id, i - 1 AS place, replace([{_MARKS}][(((doc_id + (i - 1) * i // 2) % {len(PLANTED)}) + {len(PLANTED)}) % {len(PLANTED)} + 1], '%', l[i]) AS line
    FROM split, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u
), cut AS (
    SELECT *, CASE WHEN NOT regexp_matches(line, '^(?: {{4}}| {{0,3}}\t)') THEN ltrim(line, ' ') END AS t, regexp_full_match(line, '[ \t]*') AS blank,
           lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY place) AS above
    FROM raw
), cells AS (
    SELECT *, t IS NULL AS deep, NOT regexp_matches(above, '^(?: {{4}}| {{0,3}}\t)') AS shallow,
           string_split(regexp_replace(regexp_replace(trim(above, ' ' || chr(9)), '^\|', ''), '(?s)\\.', 'xx', 'g'), '|') AS head,
           string_split(regexp_replace(regexp_replace(trim(coalesce(t, ''), ' ' || chr(9)), '^\|', ''), '(?s)\\.', 'xx', 'g'), '|') AS row
    FROM cut
), kinds AS (
    SELECT *, CASE WHEN starts_with(t, '<!--') THEN 2 WHEN starts_with(t, '<?') THEN 3 WHEN starts_with(t, '<![CDATA[') THEN 5 WHEN regexp_matches(t, '^<![A-Za-z]') THEN 4
                   WHEN regexp_matches(t, '(?i)^<(?:pre|script|style|textarea)(?:[ \t>]|$)') THEN 1
                   WHEN regexp_matches(t, '(?i)^</?(?:{"|".join(lx.g.BLOCK_TAGS)})(?:[ \t>]|/>|$)') THEN 6
                   WHEN regexp_full_match(t, '(?:<[A-Za-z0-9\-]+(?:[ \t]+[A-Za-z_:][A-Za-z0-9_:.\-]*(?:[ \t]*=[ \t]*(?:"[^"]*"|''[^'']*''|[^ \t\n"''=<>`]+))?)*[ \t]*/?>|</[A-Za-z0-9\-]+[ \t]*>)[ \t]*') THEN 7 END AS html,
           CASE WHEN regexp_matches(t, '^(?:-[ \t]*-|=)') AND regexp_full_match(t, '(?:=+|-+)[ \t]*') OR regexp_full_match(t, '-[ \t]*') THEN true ELSE false END AS setext,
           len(list_filter(head, lambda c: true)) - CASE WHEN trim(head[len(head)], ' ' || chr(9)) = '' THEN 1 ELSE 0 END AS n_head,
           len(row) - CASE WHEN trim(row[len(row)], ' ' || chr(9)) = '' THEN 1 ELSE 0 END AS n_row
    FROM cells
), fresh AS (
    SELECT *, CASE WHEN t IS NULL THEN NULL
        WHEN starts_with(t, '>') THEN 'Blockquote'
        WHEN regexp_full_match(t, '(?:-[ \t]*){{3,}}|(?:_[ \t]*){{3,}}|(?:\*[ \t]*){{3,}}') THEN 'ThematicBreak'
        WHEN regexp_matches(t, '^#{{1,6}}(?:[ \t]|$)') THEN 'AtxHeading'
        WHEN regexp_full_match(t, '`{{3,}}[^`]*|~{{3,}}.*') THEN 'CodeFence'
        WHEN html IS NOT NULL THEN 'HtmlBlock'
        WHEN regexp_full_match(t, '\${{2,}}[^$]*') THEN 'MathFence'
        WHEN regexp_matches(t, '^\{{\{{') THEN CASE WHEN NOT contains(t[3:], '}}}}') OR regexp_full_match(regexp_extract(t, '^\{{\{{.*?\}}\}}(.*)$', 1), '[ \t]*') THEN 'Liquid' END
        WHEN regexp_matches(t, '^\{{%') THEN CASE WHEN NOT contains(t[3:], '%}}') OR regexp_full_match(regexp_extract(t, '^\{{%.*?%\}}(.*)$', 1), '[ \t]*') THEN 'Liquid' END
        WHEN regexp_matches(t, '^:{{3,}}[ \t]*[\p{{L}}\p{{N}}_{{\[]') THEN 'DirectiveOpener'
        WHEN regexp_matches(t, '^\[\^[^\]\[ \t\\]+\]:') THEN 'FootnoteDefinition'
        WHEN regexp_matches(t, '^(?:[-*+]|[0-9]{{1,9}}[.)])(?:[ \t]|$)') THEN 'ListItem'
        WHEN regexp_full_match(t, ':{{3,}}[ \t]*') THEN 'DirectiveCloser'
        WHEN starts_with(t, '|') THEN 'TableRow' END AS fresh,
        CASE WHEN shallow AND n_head = n_row AND n_row > 0 AND regexp_full_match(t, '[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*') THEN true ELSE false END AS delimits,
        regexp_extract(t, '^(?:`{{3,}}|~{{3,}}|\${{2,}})') AS run,
        CASE WHEN regexp_matches(t, '^(?:`{{3,}}|~{{3,}}|\${{2,}})[ \t]*$') THEN regexp_extract(t, '^(?:`{{3,}}|~{{3,}}|\${{2,}})') ELSE '' END AS closer,
        [regexp_matches(line, '(?i)</(?:pre|script|style|textarea)>'), contains(line, '-->'), contains(line, '?>'), contains(line, '>'), contains(line, ']]>')] AS ends,
        regexp_full_match(ltrim(above, ' '), '<a>|</a>') AND shallow AS above_tag
    FROM kinds
), facts AS (
    SELECT *, CASE WHEN deep THEN NULL WHEN fresh = 'Blockquote' THEN fresh WHEN setext THEN 'SetextUnderline'
        WHEN fresh = 'ListItem' THEN CASE WHEN regexp_matches(t, '^(?:[-*+]|0{{0,8}}1[.)])[ \t]+[^ \t]') THEN fresh END
        WHEN delimits AND (fresh IS NULL OR fresh IN ('DirectiveCloser', 'TableRow') OR html = 7) THEN 'TableDelimiterRow'
        WHEN html = 7 THEN NULL ELSE fresh END AS within
    FROM fresh
), folded AS (
    SELECT doc_id, list({{'blank': blank, 'deep': deep, 'fresh': fresh, 'within': within, 'html': html, 'run': run, 'closer': closer, 'ends': ends, 'above_tag': above_tag, 't': t}} ORDER BY place) AS f
    FROM facts GROUP BY doc_id
), RECURSION AS (
    SELECT doc_id, f, 0 AS place, 'none' AS state FROM folded
    UNION ALL
    SELECT doc_id, f, place + 1, CASE
        WHEN state LIKE 'fence%' OR state LIKE 'math%' THEN CASE WHEN x.closer <> '' AND x.closer[1] = state[6] AND length(x.closer) >= CAST(state[7:] AS INTEGER) THEN 'none' ELSE state END
        WHEN state LIKE 'html%' THEN CASE WHEN state[5] IN ('6', '7') THEN CASE WHEN x.blank THEN 'none' ELSE state END WHEN x.ends[CAST(state[5] AS INTEGER)] THEN 'none' ELSE state END
        WHEN x.blank THEN CASE state WHEN 'code' THEN 'code' ELSE 'none' END
        WHEN x.deep THEN CASE WHEN state IN ('paragraph', 'container') THEN state ELSE 'code' END
        ELSE coalesce(CASE
            WHEN s IN ('AtxHeading', 'ThematicBreak', 'SetextUnderline', 'DirectiveOpener', 'DirectiveCloser') THEN 'none'
            WHEN s = 'CodeFence' THEN 'fence' || x.run[1] || length(x.run) WHEN s = 'MathFence' THEN 'math_' || '$' || length(x.run)
            WHEN s = 'HtmlBlock' THEN CASE WHEN x.html <= 5 AND x.ends[x.html] THEN 'none' ELSE 'html' || x.html END
            WHEN s = 'Liquid' AND contains(x.t, CASE WHEN starts_with(x.t, '{{%') THEN '%}}' ELSE '}}}}' END) THEN 'none'
            WHEN s IN ('Blockquote', 'FootnoteDefinition', 'ListItem') THEN 'container'
            WHEN s = 'TableDelimiterRow' THEN CASE WHEN x.above_tag THEN 'html7' ELSE 'table' END END,
            CASE WHEN state IN ('table', 'container') THEN state ELSE 'paragraph' END) END
    FROM (SELECT *, f[place + 1] AS x, CASE WHEN state = 'paragraph' THEN f[place + 1].within ELSE f[place + 1].fresh END AS s FROM RECURSION WHERE place < len(f))
)
"""
_STATES = "WITH RECURSIVE " + _STATES.replace("RECURSION", "states")


@query(
    _STATES
    + r"""
SELECT a.doc_id, CAST(a.place AS INTEGER) AS place, regexp_replace(a.state, '^(fence|math).*', '\1') AS open,
       CASE WHEN a.state LIKE 'fence%' OR a.state LIKE 'math%' OR a.state LIKE 'html%' OR (a.state = 'code' AND b.state = 'code') THEN NULL WHEN a.state = 'table' AND b.state = 'table' THEN 'TableRow'
            WHEN a.state = 'paragraph' THEN a.f[a.place + 1].within ELSE a.f[a.place + 1].fresh END AS starts,
       (a.state LIKE 'fence%' OR a.state LIKE 'math%' OR a.state LIKE 'html%') AND b.state = 'none' AS closes
FROM states a JOIN states b ON a.doc_id = b.doc_id AND b.place = a.place + 1
"""
)
def lex_line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open before each line of every text, what the line starts there, and what it closes."""
    return line_states(_planted_lines(_prose(spark, sf_dir)))


# ---- options by row, and what differs between tables

_KINDS = SQL["lex_line_start"]
_RAW_KINDS = _KINDS.replace(_LINES, _LINES.replace("list_extract([" + ", ".join("'" + m + "'" for m in MARKERS) + f"], CAST((doc_id + i - 1) % {len(MARKERS)} AS INTEGER) + 1) || ", ""))
#: What each switch of the grammar takes from the classes of lines.
_TAKES = {"html_flow": ["HtmlBlock"], "math_flow": ["MathFence"], "liquid": ["Liquid"], "container_directive": ["DirectiveOpener", "DirectiveCloser"], "gfm_footnote": ["FootnoteDefinition"], "gfm_table": ["TableRow"]}
_SWITCHES = [f.name for f in fields(Constructs)]
_QUOTED = {name: ", ".join(f"'{k}'" for k in _TAKES.get(name, ["-"])) for name in _SWITCHES}


@query(
    f"WITH k AS ({_KINDS}) "
    + " UNION ALL ".join(f"SELECT '{name}' AS switch, count(*) AS n_lines, CAST(sum(CASE WHEN kind IN ({_QUOTED[name]}) THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, count(kind) - CAST(sum(CASE WHEN kind IN ({_QUOTED[name]}) THEN 1 ELSE 0 END) AS BIGINT) AS n_left FROM k" for name in _SWITCHES)
)
def lex_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each switch of the grammar turned alone, as a column of options: lines whose class changes, and those that still have one."""
    tails = _marked_lines(spark, sf_dir).select(lx.flow_tail(F.col("line")).alias("tail"))
    tested = tails.groupBy(lx.tail_tests(F.col("tail"), F.lit(False)).alias("tests")).agg(F.count("*").alias("n"))  # lines of the same tests have the same classes
    lines = tested.withColumn("switch", F.explode(F.array(*map(F.lit, _SWITCHES))))
    turned = {name: F.lit(getattr(Constructs.markdown(), name)) != (F.col("switch") == name) for name in _SWITCHES}
    plain, own = lx.tests_start(F.col("tests")), lx.tests_start(F.col("tests"), F.col("options"))
    kinds = lines.withColumn("options", lx.options(**turned)).select("switch", "n", plain.alias("plain"), own.alias("own"))
    of = lambda those: F.sum(F.when(those, F.col("n")).otherwise(0))
    return kinds.groupBy("switch").agg(F.sum("n").alias("n_lines"), of(~F.col("plain").eqNullSafe(F.col("own"))).alias("n_changed"), of(F.col("own").isNotNull()).alias("n_left"))


def _kinds(spark: SparkSession, sf_dir: str, constructs: Constructs | None = None) -> DataFrame:
    return _marked_lines(spark, sf_dir).select("doc_id", "place", lx.line_start(F.col("line"), F.lit(False), constructs).alias("kind"))


@query(f"WITH k AS ({_KINDS}) SELECT doc_id, place, 'changed' AS change, 'kind' AS fields, kind AS was, CAST(NULL AS VARCHAR) AS now FROM k WHERE kind IN ({', '.join(q for n, q in _QUOTED.items() if n in _TAKES and n != 'html_flow')})")
def md_preset_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are something else to CommonMark than to general Markdown."""
    found = compare.changes(_kinds(spark, sf_dir), _kinds(spark, sf_dir, Constructs.commonmark()), ["doc_id", "place"])
    return found.select("doc_id", "place", "change", F.array_join("fields", ",").alias("fields"), F.col("before.kind").alias("was"), F.col("after.kind").alias("now"))


@query(
    f"""
WITH marked AS (SELECT doc_id, kind FROM ({_KINDS})), raw AS (SELECT doc_id, kind FROM ({_RAW_KINDS}))
SELECT doc_id, kind, 'added' AS change, count(*) AS n FROM (SELECT * FROM marked EXCEPT ALL SELECT * FROM raw) GROUP BY doc_id, kind
UNION ALL SELECT doc_id, kind, 'removed', count(*) FROM (SELECT * FROM raw EXCEPT ALL SELECT * FROM marked) GROUP BY doc_id, kind
"""
)
def md_structure_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of lines that two versions of every text have more or fewer of."""
    lines = _prose(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    raw = lines.select("doc_id", lx.line_start(F.col("line"), F.lit(False)).alias("kind"))
    return compare.multiset_difference(raw, _kinds(spark, sf_dir).drop("place"))


# ---- totals, sketches, semi-structured properties


def _class_sql(column: str) -> str:
    return f"CASE WHEN {column} < 200 THEN 'short' WHEN {column} < 2000 THEN 'middle' WHEN {column} IS NOT NULL THEN 'long' END"


_CUBE = f"(SELECT d.source, d.lang, {_class_sql('length(d.text)')} AS class, k.kind FROM ({_KINDS}) k JOIN documents d USING (doc_id))"


def _described_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", totals.size_class(F.length("text")).alias("class"))
    return _kinds(spark, sf_dir).join(docs, "doc_id")


@query(f"SELECT source, lang, class, kind, CAST(GROUPING(source, lang, class, kind) AS BIGINT) AS level, count(*) AS n FROM {_CUBE} GROUP BY CUBE (source, lang, class, kind)")
def md_kind_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of lines by source, language and size of document, with all subtotals."""
    return totals.totals(_described_kinds(spark, sf_dir), ["source", "lang", "class", "kind"], {"n": F.count("*")})


@query(f"SELECT lang, kind, CAST(GROUPING(lang, kind) AS BIGINT) AS level, count(*) AS n, count(DISTINCT source) AS sources FROM {_CUBE} GROUP BY ROLLUP (lang, kind)")
def md_kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.totals(_described_kinds(spark, sf_dir), ["lang", "kind"], {"n": F.count("*"), "sources": F.count_distinct("source")}, "rollup")


@query(f"SELECT lang, class, kind, CAST(GROUPING(lang, class, kind) AS BIGINT) AS level, count(*) AS n FROM {_CUBE} GROUP BY GROUPING SETS ((lang, class), (kind), ())")
def md_kind_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.totals(_described_kinds(spark, sf_dir), ["lang", "class", "kind"], {"n": F.count("*")}, [["lang", "class"], ["kind"], []])


@query(
    r"""
WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents)
SELECT source, count(*) AS n, count(DISTINCT word) AS words, true AS distinct_within, true AS median_within FROM w GROUP BY source
"""
)
def md_word_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by source from sketches stored by source and language, beside exact answers: whether each lies within its bound."""
    docs = corpus.table(spark, sf_dir, "documents")
    words = docs.select("source", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("word")).withColumn("size", F.octet_length("word").cast("long"))
    parts = stored(sketches.sketched(words, ["source", "lang"], "word", "size"), "sketches")
    about = sketches.estimates(sketches.merged(parts, ["source"]), ["source"], (0.5,))
    near = words.join(F.broadcast(about.select("source", "q50")), "source")  # a row a source
    exact = near.groupBy("source").agg(F.count_distinct("word").alias("words"), F.mean((F.col("size") < F.col("q50")).cast("double")).alias("under"), F.mean((F.col("size") <= F.col("q50")).cast("double")).alias("upto"))
    full = about.join(exact, "source")
    off = F.abs(F.col("distinct") - F.col("words")) <= 5 * sketches.DISTINCT_ERROR * F.col("words") + 1
    rank = (F.col("under") <= 0.5 + 3 * sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - 3 * sketches.RANK_ERROR)
    return full.select("source", "n", "words", off.alias("distinct_within"), rank.alias("median_within"))


@query(
    """
WITH j AS (SELECT event_id, '{"props":' || coalesce(props, 'null') || ',"user":{"id":' || user_id || ',"tags":["' || event_type || '",null]}' || CASE WHEN event_id % 3 = 0 THEN ',"extra":{"v":' || event_id || '}' ELSE '' END || '}' AS j FROM events)
SELECT event_id, TRY_CAST(json_extract_string(j, '$.props.k') AS BIGINT) AS k, json_extract_string(j, '$.user.tags[0]') AS tag, TRY_CAST(json_extract_string(j, '$.extra.v') AS BIGINT) AS extra,
       json_extract_string(j, '$.user.none.deeper') AS missing, TRY_CAST(json_extract_string(j, '$.user.tags[0]') AS BIGINT) AS mistyped, CAST(CASE WHEN event_id % 3 = 0 THEN 5 ELSE 4 END AS BIGINT) AS n_leaves FROM j
"""
)
def md_variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, missing and mistyped paths of semi-structured properties, and the number of their scalars."""
    e = corpus.table(spark, sf_dir, "events")
    extra = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"extra":{"v":'), "event_id", F.lit("}"))).otherwise("")
    json = F.concat(F.lit('{"props":'), F.coalesce("props", F.lit("null")), F.lit(',"user":{"id":'), "user_id", F.lit(',"tags":["'), "event_type", F.lit('",null]}'), extra, F.lit("}"))
    rows = e.select("event_id", variants.parsed(json).alias("v"))
    sizes = variants.leaves(rows, "v", ["event_id"]).groupBy("event_id").agg(F.count("*").alias("n_leaves"))
    v = F.col("v")
    paths = rows.select("event_id", variants.at(v, "$.props.k", "bigint").alias("k"), variants.at(v, "$.user.tags[0]").alias("tag"), variants.at(v, "$.extra.v", "bigint").alias("extra"), variants.at(v, "$.user.none.deeper").alias("missing"), variants.at(v, "$.user.tags[0]", "bigint").alias("mistyped"))
    return paths.join(sizes, "event_id")


# ---- reproducible tokens

_WIDE = ", ".join("'" + x.replace("'", "''") + "'" for x in corpus.WIDE)


@query(
    f"""
WITH {_SPLIT.strip()}, l AS (
    SELECT doc_id, i, l[i] AS line, (((doc_id % 4294967296) + 4294967296) % 4294967296 + CAST(i AS HUGEINT) * 1831565813) & 4294967295 AS s FROM split, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u
), a AS (SELECT *, (CAST(xor(s, s >> 15) AS HUGEINT) * (s | 1)) & 4294967295 AS x FROM l
), b AS (SELECT *, xor(x, (x + ((CAST(xor(x, x >> 7) AS HUGEINT) * (x | 61)) & 4294967295)) & 4294967295) AS y FROM a
), c AS (SELECT *, [{_WIDE}] AS tokens, (xor(y, y >> 14) * {len(corpus.WIDE)}) >> 32 AS k FROM b)
SELECT doc_id, count(*) AS n_tokens, md5(string_agg(tokens[CAST(k AS BIGINT) + 1] || line, chr(10) ORDER BY i)) AS digest FROM c GROUP BY doc_id
"""
)
def check_planted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a token of the reproducible generator before each of its lines."""
    tokens = F.array(*map(F.lit, corpus.WIDE))
    line = lambda x, i: F.concat(F.get(tokens, soup.below(F.col("doc_id"), i + 1, len(corpus.WIDE)).cast("int")), x)
    lines = _prose(spark, sf_dir).select("doc_id", lx.split_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("lines", line), "\n").cast("binary")).alias("digest"))


# ---- streams


@query(
    """
WITH e AS (SELECT user_id, ts, value, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 7200000000 AS ended, count(*) AS n, max(value) AS most FROM s GROUP BY user_id, session
"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events' users from a stream of the whole table."""
    events = corpus.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(events).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} AS timestamp_ntz))").alias(c)
    out = state.run_to_end(state.sessions(stream, ["user_id"], "ts", "2 hours", most=F.max("value")), "sessions", "complete")
    return out.select("user_id", micros("started"), micros("ended"), "n", "most")


# ---- a test suite from its own source, run and summed up


@query(
    "SELECT p_brand AS section, count(*) AS total, CAST(sum(CASE WHEN p_partkey % 50 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_failed FROM part GROUP BY p_brand"
)
def check_suite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written in the format of suites, read by ranges, rendered, and held against what they expect; some expect wrongly."""
    register(spark)
    parts, fence = corpus.table(spark, sf_dir, "part"), "`" * 32
    wrong = F.when(F.col("p_partkey") % 50 == 0, "not ").otherwise("")
    example = F.concat(F.lit("# "), "p_brand", F.lit(f"\n\n{fence} example\n→\n*"), "p_name", F.lit("* `"), "p_partkey", F.lit("`\n.\n<p>"), wrong, F.lit("<em>"), "p_name", F.lit("</em> <code>"), "p_partkey", F.lit(f"</code></p>\n{fence}\n"))
    folder = scratch(spark, "suite")
    parts.select(example).write.text(folder)
    suite = spark.read.format("markdown_suite").load(folder).withColumn("doc_id", F.xxhash64("path", "example"))
    made = render_html(suite.withColumnRenamed("html", "expected"), Constructs.commonmark(), text_col="markdown", keep=["section", "example", "expected"])
    results = made.select("section", "example", (F.col("html") == F.col("expected")).alias("passed"))
    return invariants.suite_summary(results).select("section", "total", "passed", F.size("failed").alias("n_failed"))


# ---- checks that must find what is planted


@query("SELECT doc_id, 'bounds' AS rule FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'empty' FROM documents WHERE doc_id % 7 = 1 AND regexp_matches(text, '[^ \\t\\r\\n]') UNION ALL SELECT doc_id, 'inside' FROM documents WHERE doc_id % 7 = 2 AND regexp_matches(text, '[^ \\t\\r\\n]')")
def check_planted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every text, some of them damaged: roots that begin before their text, texts of no length, and blocks that end before their first text."""
    docs = _prose(spark, sf_dir)
    nodes = stored(parse_markdown(docs), "nodes")
    first = nodes.where("type = 'Text'").groupBy("doc_id").agg(F.min_by("node_id", F.struct("start", "node_id")).alias("text_id"), F.min_by("parent_id", F.struct("start", "node_id")).alias("block_id"))
    kind, node = F.col("doc_id") % 7, F.col("node_id")
    damaged = nodes.join(first, "doc_id", "left").withColumns(
        {
            "start": F.when((kind == 0) & (node == 0), -5).otherwise(F.col("start")),
            "end": F.when((kind == 1) & (node == F.col("text_id")), F.col("start")).otherwise(F.col("end")),
        }
    )
    cut = damaged.withColumn("end", F.when((kind == 2) & (node == F.col("block_id")), F.col("start")).otherwise(F.col("end"))).drop("text_id", "block_id")
    found = invariants.broken_spans(cut, docs).where("rule <> 'segment'")
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n")).select("doc_id", "rule")


@query("SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS list_id FROM customer WHERE c_nationkey % 3 = 0 GROUP BY c_nationkey")
def check_planted_tightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklists of every nation, with the flag of some turned: just those come back."""
    docs = corpus.customer_checklists(spark, sf_dir)
    nodes = stored(parse_markdown(docs, inlines=False, types=["List", "ListItem"]), "nodes")
    turned = nodes.withColumn("tight", F.when(F.col("doc_id") % 3 == 0, ~F.col("tight")).otherwise(F.col("tight")))
    return views.tightness_check(turned, blank_lines(docs))


@query(
    "SELECT p_partkey, replace(p_name, 'a', '&') || chr(233) || '*' || chr(128512) || chr(65533) AS decoded, '/' || replace(p_name, ' ', '%20') || '%C3%A9%25&amp;' AS href, p_brand || chr(10) || 'x\"' AS title, '<' || p_brand || chr(10) || ' y>' AS html, lower(p_name) || ' ss' || chr(963) AS label FROM part"
)
def fn_cooked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, references, addresses, titles and labels made of every part's name."""
    name, brand = F.col("p_name"), F.col("p_brand")
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey",
        t.decode(F.concat(F.replace(name, F.lit("a"), F.lit("&amp;")), F.lit("&eacute;\\*&#x1F600;&#0;"))).alias("decoded"),
        t.encode_href(F.concat(F.lit("/"), name, F.lit("é%&"))).alias("href"),
        t.title(F.concat(F.lit("'"), brand, F.lit("\n \tx\\\"'"))).alias("title"),
        t.html_inline(F.concat(F.lit("<"), brand, F.lit("\n    y>"))).alias("html"),
        t.normalize_label(F.concat(F.lit(" "), F.upper(name), F.lit("\t\nẞς "))).alias("label"),
    )


@query()
def check_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes on which parsers differ, in every text with a token of the reproducible generator before each of its lines."""
    tokens = F.array(*map(F.lit, corpus.WIDE))
    line = lambda x, i: F.concat(F.get(tokens, soup.below(F.col("doc_id"), i + 1, len(corpus.WIDE)).cast("int")), x)
    docs = _prose(spark, sf_dir).select("doc_id", F.array_join(F.transform(lx.split_lines(F.col("text")), line), "\n").alias("text"))
    return invariants.known_quirks(docs)


# ---- tab stops and alternative texts

_LEADS = ["", "\t", " \t", "  \t ", "    ", "   \t", "\t\t", " ", "  \t\t", "     \t"]
_LEADS_SQL = ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in _LEADS)


@query(
    f"""
WITH l AS (SELECT doc_id, i - 1 AS place, [{_LEADS_SQL}][(doc_id + i - 1) % {len(_LEADS)} + 1] || l[i] AS line, CAST((doc_id + i - 1) % 7 AS INTEGER) AS n
           FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents) d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u),
c AS (SELECT *, regexp_extract(line, '^[ \\t]*') AS lead FROM l),
p AS (SELECT *, [list_reduce([0] || [CASE WHEN lead[j] = chr(9) THEN 1 ELSE 0 END FOR j IN range(1, k + 1)], lambda a, t: a + CASE WHEN t = 1 THEN 4 - a % 4 ELSE 1 END) FOR k IN range(0, length(lead) + 1)] AS cols FROM c),
t AS (SELECT *, coalesce(list_position([x >= n FOR x IN cols], true), len(cols)) - 1 AS k FROM p)
SELECT doc_id, CAST(place AS INTEGER) AS place, substr(line, CAST(k AS BIGINT) + 1) AS rest, CAST(greatest(cols[k + 1] - n, 0) AS INTEGER) AS padding FROM t
"""
)
def lex_strip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text behind white space of some shape, less up to six columns of it; tabs may be cut in two."""
    lines = _prose(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("place", "raw"))
    k = F.col("doc_id") + F.col("place")
    line = F.concat(F.get(F.array(*map(F.lit, _LEADS)), (k % len(_LEADS)).cast("int")), "raw")
    cut = lines.select("doc_id", "place", line.alias("line"), (k % 7).cast("int").alias("n")).select("doc_id", "place", lx.strip_columns(F.col("line"), F.col("n")).alias("x"))
    return cut.select("doc_id", "place", "x.rest", "x.padding")


@query("SELECT p_partkey AS doc_id, p_name || ' & ' || p_brand || chr(10) || p_partkey AS alt, '/img/' || p_partkey AS url, p_type AS title FROM part")
def md_image_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative texts of images, of the text below them: emphasis, references, code and line endings."""
    p = corpus.dealt(corpus.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    text = F.concat(F.lit("![*"), "p_name", F.lit("* &amp; **"), "p_brand", F.lit("**\n`"), "p_partkey", F.lit("`](/img/"), "p_partkey", F.lit(' "'), "p_type", F.lit('")\n'))
    docs = p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    nodes = stored(parse_markdown(docs, types=["Definition", "Link", "Image", *views.TEXTS]), "nodes")
    alt = views.plain_text(nodes, docs, "Image").withColumnRenamed("content", "alt")
    return resolve.links(nodes, docs).where("type = 'Image'").join(alt.hint("merge"), ["doc_id", "node_id"]).select("doc_id", "alt", "url", "title")
