"""Orphan references: runs, as-of match and every defined odd case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundline.operators import references as R

DAY = lambda n: dt.datetime(2018, 1, 1) + dt.timedelta(days=n)
DOCS = "doc_id bigint, ingested_at timestamp_ntz, source_file string, section_headings array<string>, chunk_id string"
CHUNKS = "chunk_id string, doc_id bigint, created_at timestamp_ntz, ingested_at string, live boolean, k int"
DELETIONS = "doc_id bigint, deleted_at timestamp_ntz"
QRELS = "query_id string, judged_at timestamp_ntz, relevant array<struct<document:string,sections:array<string>>>"


@pytest.fixture
def tables(spark):
    docs = [(1, DAY(0), "a.md", ["One", "Two"], "x"), (2, DAY(5), "b.md", None, "x"), (3, DAY(0), None, [], "x"), (5, None, "e.md", ["One"], "x"), (70_000, DAY(0), "f.md", [], "x"), (None, DAY(0), "g.md", [], "x")]
    deletions = [(1, DAY(-1)), (3, DAY(9)), (3, DAY(-4)), (None, DAY(9)), (99, DAY(1))]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(deletions, DELETIONS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_are_cut_at_blocks(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 5, 9, 10, -1, None)], "id bigint")
    assert rows(R.key_runs(keys, "id", 8).drop("block")) == [(-1, -1), (1, 3), (5, 5), (9, 10)]


def test_keys_beyond_runs_match_brute_force(spark):
    have = {k for k in range(-40, 400) if (k * 7919) % 5}
    runs = R.key_runs(spark.createDataFrame([(k,) for k in have], "id bigint"), "id", 16)
    asked = spark.createDataFrame([(k,) for k in [*range(-60, 450), 7, 7, None]], "id bigint")
    found = {r[0] for r in R.beyond_runs(asked, "id", runs, 16).collect()}
    assert found == {k for k in range(-60, 450) if k not in have}


def test_chunk_references(spark, tables):
    chunks = [("c1", 1, DAY(3)), ("c2", 2, DAY(3)), ("c3", 2, DAY(5)), ("c4", 3, DAY(3)), ("c5", 4, DAY(3)), ("c5", 4, DAY(3)), ("c6", None, DAY(3)), ("c7", 5, DAY(3)), ("c8", 2, None), ("c9", 4, None), (None, 4, DAY(40))]
    c = spark.createDataFrame([(*r, "clash", True, 1) for r in chunks], CHUNKS)
    found = {(r.period, r.ref_id, r.doc_key) for r in R.orphan_chunks(c, *tables).collect()}
    assert found == {("2018-01", "c2", "2"), ("2018-01", "c4", "3"), ("2018-01", "c5", "4"), (None, "c9", "4"), ("2018-02", None, "4")}


def test_hot_references_are_spread_and_whole(spark, tables):
    n = 500
    c = spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit(4).cast("bigint").alias("doc_id"), F.lit(DAY(1)).cast("timestamp_ntz").alias("created_at"))
    assert R.orphan_chunks(c, *tables, hot=20).count() == n


def test_judgements(spark, tables):
    q = [
        ("q1", DAY(3), [("a.md", ["One", "Three", None, "one"]), None, (None, ["One"])]), ("q2", DAY(3), [("b.md", ["One"])]), ("q3", DAY(6), [("b.md", ["One", "One"]), ("b.md", ["One"])]),
        ("q4", DAY(6), None), ("q5", DAY(6), [("A.md", None), ("a.md", None)]), ("q6", None, [("a.md", ["Two"])]), ("q1", DAY(3), [("a.md", ["Three"])]), ("q7", DAY(6), [("e.md", ["One"])]),
    ]
    for hot in (R.HOT_REFERENCES, 2):
        found = rows(R.orphan_judgements(spark.createDataFrame(q, QRELS), *tables, hot=hot).select("ref_id", "doc_key", "section"))
        assert found == [("q1", "a.md", "Three"), ("q1", "a.md", "one"), ("q2", "b.md", ""), ("q3", "b.md", "One"), ("q5", "A.md", "")]


def test_empty_tables(spark, tables):
    docs, deletions = tables
    none = spark.createDataFrame([], CHUNKS)
    assert R.orphan_chunks(none, docs, deletions).count() == 0
    one = spark.createDataFrame([("c", 1, DAY(1), "", True, 1)], CHUNKS)
    assert R.orphan_chunks(one, docs.limit(0), deletions.limit(0)).count() == 1
    assert R.orphan_judgements(spark.createDataFrame([], QRELS), docs, deletions).count() == 0


def test_report(spark, tables):
    c = spark.createDataFrame([("c5", 4, DAY(3), "", True, 1), ("c6", 4, DAY(3), "", True, 1)], CHUNKS)
    assert rows(R.orphan_report(R.orphan_chunks(c, *tables))) == [("chunks", "2018-01", 2, 2)]
