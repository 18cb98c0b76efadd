"""Every registered query of the subpackage over whole tables: against its SQL, or against what its contract says of any result."""

import zlib
from collections import Counter

import duckdb
import pytest

from mdloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())


def test_shards_hold_equal_bytes(spark, con):
    rows = QUERIES["op1_virtual_slot_sharding"](spark, SF).collect()
    texts = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert {r.law for r in rows} == {"bytes"} and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows) and set(load) <= set(range(40))
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_quality_of_held_out_rows(spark, con):
    rows = {r.doc_id: r for r in QUERIES["op5_quadratic_discriminant_quality"](spark, SF).collect()}
    labels = dict(con.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in labels.items() if d in rows and rows[d].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)
