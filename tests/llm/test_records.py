"""Survivorship, top N and percentiles against brute force, and their defined odd cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from groundline.llm import percentiles as P
from groundline.llm import survivorship as S
from groundline.llm import topn

FACTS = "cik string, concept string, unit string, fiscal_year int, fact_id bigint, form string, end_date string, accession_number string, value double, entity_name string, fiscal_period string, rank string, has int"


def fact(i, form="10-K", end="2020-12-31", acc="0000000001-21-000001", value=1.0, name="A", cik="12", concept="us-gaap:Assets", unit=" usd", year=2020):
    return (cik, concept, unit, year, i, form, end, acc, value, name, "FY", "clash", 0)


def survivors(spark, rows):
    return [r.asDict() for r in S.survivors(spark.createDataFrame(rows, FACTS)).collect()]


def test_key_and_order(spark):
    rows = [
        fact(1, "8-K", "2021-12-31", value=None), fact(2, "10-K/A", "20201231", "000000000122000005", math.nan, " "), fact(3, "10-K", "2020-12-31T00:00:00", "bad", 3.0, None, cik="0000000012", concept="Assets ", unit="USD"),
        fact(4, None, None, None, 4.0, "D", cik="CIK 12", concept="x:y:Assets"),
    ]
    (r,) = survivors(spark, rows)
    assert (r["cik"], r["concept"], r["unit"]) == ("0000000012", "Assets", "USD")
    # both annual rows have one end date; the one with an accession comes first
    assert (r["fact_id"], r["value_fact_id"], r["entity_name_fact_id"], r["accession_number_fact_id"]) == (2, 3, 1, 2)
    assert r["value"] == 3.0 and r["entity_name"] == "A" and r["contested"]


def test_ties_repeats_and_nothing(spark):
    (r,) = survivors(spark, [fact(7, value=None, name=None, acc=None), fact(7, value=None, name=None, acc=None)])
    assert (r["fact_id"], r["value_fact_id"], r["entity_name_fact_id"], r["accession_number_fact_id"], r["contested"]) == (7, 0, 0, 0, False) and r["value"] is None
    assert survivors(spark, [fact(8), fact(9)])[0]["fact_id"] == 9
    assert survivors(spark, [fact(1, year=None), fact(2, cik=None), fact(3, cik="none"), fact(4, concept=None), fact(5, unit=None), (*fact(6)[:4], None, *fact(6)[5:])]) == []
    assert survivors(spark, []) == []


def test_spellings(spark):
    ends = {" 2020-01-05 ": 20200105, "20200105": 20200105, "20200105x": 20200105, "2020-01": None, "n/a": None, "": None, None: None, " 2020-01-05Z": 20200105}
    df = spark.createDataFrame([(k,) for k in ends], "e string")
    assert [r[0] for r in df.select(S.end_day(F.col("e"))).collect()] == list(ends.values())
    accs = {"0000000001-21-000002": 21000002, " 000000000121000002": 21000002, "1-21-2": None, None: None, "": None}
    df = spark.createDataFrame([(k,) for k in accs], "e string")
    assert [r[0] for r in df.select(S.accession_rank(F.col("e"))).collect()] == list(accs.values())


def brute_top(rows, n):
    best = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        key = (-s, t is None, t or 0)
        if (g, i) not in best or key < best[g, i]:
            best[g, i] = key
    out = []
    for g in {g for g, _ in best}:
        order = sorted((v, i) for (h, i), v in best.items() if h == g)
        out += [(g, p, i) for p, (_, i) in enumerate(order[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_top_n_like_brute_force(spark, seed, batch):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None] + ["hot"] * 8), rng.choice([None, *map(str, range(25))]), rng.choice([None, math.nan, math.inf, -math.inf, 0.5, 1.0, 1.5]), rng.choice([None, 1, 2])) for _ in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "query_id string, chunk_id string, score double, rank int, place int, g string").repartition(5)
        got = sorted(tuple(r) for r in topn.top_n(df, "query_id", "chunk_id", "score", "rank", 10).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_top(rows, 10)


def test_top_n_of_nothing(spark):
    none = spark.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    out = topn.top_n(none, "query_id", "chunk_id", "score", "rank")
    assert out.columns == ["query_id", "place", "chunk_id"] and out.count() == 0


def ranked(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values) - 1e-9)) - 1]


@pytest.mark.parametrize("finish", [1, 40])
def test_percentiles_like_sorting(spark, finish):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.choice([None, "x"]), rng.choice([None, math.nan, rng.random(), float(rng.randrange(5)), math.inf, -7.0])) for _ in range(900)]
    df = spark.createDataFrame([(*r, 5, 0.1) for r in rows], "s string, k string, v double, n int, p double").repartition(4)
    blocks = P.sorted_blocks(df, ["s", "k"], "v", block_values=100)
    ps = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in P.select_percentiles(blocks, ["s", "k"], ps, finish=finish).collect()}
    want = {}
    for key in {(s, k) for s, k, _ in rows}:
        vs = [v for s, k, v in rows if (s, k) == key and v is not None and not math.isnan(v)]
        want |= {(*key, p): (len(vs), ranked(vs, p)) for p in ps}
    assert got == want


def test_every_group_of_the_log_passes_pivot_rounds(spark):
    from groundline.llm import queries

    by, rounds = ["log_day", "strategy", "measure"], []
    blocks = queries._measures(spark, "/root/testdata/sf0.01")
    groups = blocks.select(*by).distinct().count()
    P.select_percentiles(blocks, by, [0.1, 0.95], rounds=rounds)
    assert rounds[0] == groups and len(rounds) > 2 and sum(rounds[1:]) > groups


def test_ruled_out_ranges_are_discarded(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(P, "_allotted", lambda state, parts, *how, f=P._allotted: kept.append(parts.agg(F.sum(F.size("v"))).first()[0]) or f(state, parts, *how))
    blocks = P.sorted_blocks(spark.range(4000).select(F.lit("g").alias("g"), (F.col("id") * 7 % 4001).cast("double").alias("v")).repartition(4), ["g"], "v")
    assert P.select_percentiles(blocks, ["g"], [0.25]).first().value == ranked([i * 7 % 4001 for i in range(4000)], 0.25)
    # what a round leaves out is not read again: the next one sees the part with the wanted rank alone
    assert kept[0] == 3999 and all(b <= 0.8 * a for a, b in zip(kept, kept[1:]))


def test_a_state_too_large_to_broadcast_is_salted(spark, monkeypatch):
    rows = [(f"g{i % 7}", float(i * 31 % 501)) for i in range(500)]
    want = {g: ranked([v for h, v in rows if h == g], 0.5) for g, _ in rows}
    blocks = P.sorted_blocks(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", block_values=20)
    monkeypatch.setattr(P, "STATE_BYTES", 1 << 40)
    assert {r.g: r.value for r in P.select_percentiles(blocks, ["g"], [0.5], finish=3).collect()} == want


def test_blocks_of_days_join(spark):
    rng = random.Random(1)
    days = [[("g", rng.gauss(0, 1)) for _ in range(n)] for n in (1, 50, 333)]
    blocks = [P.sorted_blocks(spark.createDataFrame(d, "g string, v double"), ["g"], "v") for d in days]
    union = blocks[0].unionByName(blocks[1]).unionByName(blocks[2])
    r = P.select_percentiles(union, ["g"], [0.9], finish=4).first()
    assert (r.n, r.value) == (384, ranked([v for d in days for _, v in d], 0.9))


def test_percentiles_of_equal_values_and_of_nothing(spark):
    same = P.sorted_blocks(spark.createDataFrame([("g", 2.0)] * 500, "g string, v double"), ["g"], "v")
    assert P.select_percentiles(same, ["g"], [0.5], finish=1).first().value == 2.0
    none = P.sorted_blocks(spark.createDataFrame([("g", None)], "g string, v double"), ["g"], "v")
    assert P.select_percentiles(none, ["g"], [0.5]).count() == 0


def test_log_queries_count_a_query_once(spark, tmp_path):
    from groundline.llm import queries

    at = dt.datetime(2019, 1, 7)
    rows = [("q1", " A", at, 2000.0, 0.4), ("q1", " A", at, 2000.0, 0.4), ("q2", "a", at, -1.0, 1.5), ("q3", None, at, 9e9, 0.0), ("q4", " ", at, 9e9, 0.0), ("q5", "b", at, math.nan, math.nan)]
    spark.createDataFrame(rows, "query_id string, strategy string, created_at timestamp_ntz, latency_ms double, groundedness double").write.parquet(str(tmp_path / "query_log.parquet"))
    got = sorted(tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect())
    assert got == [("2019-01-07", "a", "groundedness"), ("2019-01-07", "a", "latency_ms")]
