"""Queries of the training-data operators, for the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import mixing, neardup, percentiles, sentences, survivorship, tokenize, topn
from groundline.llm.sql import SQL
from groundline.runtime import materialise, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivorship.survivors(table(spark, d, "financial_facts")).where("contested")
    origins = [F.col(f"{f}_fact_id").alias(a) for f, a in (("value", "value_fact_id"), ("entity_name", "entity_fact_id"), ("accession_number", "accession_fact_id"))]
    return best.select("cik", "concept", "unit", "fiscal_year", "fact_id", *origins)


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "financial_facts")).drop("contested")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "retrieved_chunks"), "query_id", "chunk_id", "score", "rank", 10)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "chunks", "chunk_id", "text", busy=True), "chunk_id", "text", width=3, at_least=0.6)


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The same links between classes of copies alone, with their similarity."""
    links = neardup.similar_links(table(spark, d, "chunks", "chunk_id", "text", busy=True), "chunk_id", "text", width=3, at_least=0.6)
    return links.withColumn("similarity", F.round("similarity", 9))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of copies that each chunk belongs to, by its smallest chunk_id."""
    return neardup.class_members(table(spark, d, "chunks", "chunk_id", "text"), "chunk_id", "text").select("chunk_id", "rep", "n")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of latency_ms and groundedness by day and strategy; each query_id counts once."""
    log = table(spark, d, "query_log").select("query_id", "strategy", "created_at", "latency_ms", "groundedness")
    strategy = F.lower(survivorship.strip(F.col("strategy")))
    log = log.select("query_id", strategy.alias("strategy"), F.date_format("created_at", "yyyy-MM-dd").alias("log_day"), "latency_ms", "groundedness")
    once = log.where("query_id is not null").dropDuplicates(["query_id"]).where("strategy is not null and strategy <> ''")
    latency = F.when((F.col("latency_ms") >= 0) & ~F.isnan("latency_ms"), F.col("latency_ms"))
    grounded = F.when((F.col("groundedness") >= 0) & (F.col("groundedness") <= 1), F.col("groundedness"))
    each = F.explode(F.array(F.struct(F.lit("latency_ms").alias("measure"), latency.alias("v")), F.struct(F.lit("groundedness").alias("measure"), grounded.alias("v"))))
    long = once.select("log_day", "strategy", each.alias("m")).select("log_day", "strategy", "m.measure", "m.v").where("v is not null")
    return materialise(percentiles.sorted_blocks(long, ["log_day", "strategy", "measure"], "v"), "blocks")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    by = ["log_day", "strategy", "measure"]
    found = percentiles.select_percentiles(_measures(spark, d), by, [0.1, 0.95])
    slow = "measure = 'latency_ms' and p = 0.95 and value > 1500"
    return found.where(f"({slow}) or (measure = 'groundedness' and p = 0.1 and value < 0.5)").select(*by)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each day, and of all days joined from the same blocks (log_day 'all')."""
    blocks = _measures(spark, d)
    ps = [0.1, 0.5, 0.9, 0.95, 0.99]
    days = percentiles.select_percentiles(blocks, ["log_day", "strategy", "measure"], ps)
    whole = percentiles.select_percentiles(blocks, ["strategy", "measure"], ps).withColumn("log_day", F.lit("all"))
    return days.unionByName(whole).select("log_day", "strategy", "measure", "p", "n", "value")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents", "doc_id", "text", busy=True))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents", "doc_id", "source", "text", busy=True).select("doc_id", "source", F.xxhash64("text").alias("copy_of"), "text").where("source is not null")
    docs = docs.join(targets.select("source").distinct(), "source", "left_semi").select("doc_id", "source", "copy_of", "text")
    sized = materialise(tokenize.count_tokens(docs), "sizes")
    # a text that comes as several documents of a source has so much smaller odds for each of them
    copies = sized.groupBy("source", "copy_of").agg(F.count(F.lit(1)).alias("copies"))
    sized = sized.join(copies, ["source", "copy_of"]).select("doc_id", "source", "n_tokens", (1 / F.col("copies")).alias("w"))
    return mixing.mix_sources(sized, targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents", "doc_id", "text", "lang", busy=True), lang="lang")


QUERIES = {f.__name__: f for f in (p2_found, p2_survivors, p3_found, p4_found, p4_links, p4_members, p5_found, p5_percentiles, p6_ids, p7_mix, p7_shares, p8_found)}

__all__ = ["QUERIES", "SQL"]
