"""References to records that do not exist, are deleted, or came in only later.

Method: sorted integer parent keys are compressed to contiguous runs; a reference is matched as-of to
the preceding run start, and is an orphan if its key lies beyond that run's end. Runs are cut at block
borders of the key space, so neither the runs nor the match ever sort all keys in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.runtime import broadcast_if_small, materialise

#: Keys per block of the key space; a block holds at most so many parents and distinct references.
BLOCK_KEYS = 1 << 16
#: References to one parent beyond which its rows are spread over several tasks.
HOT_REFERENCES = 200_000


def key_runs(parents: DataFrame, key: str, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Contiguous runs of an integer key: block, run_start, run_end.

    Null keys make no run; repeated keys count once; an empty table gives no runs.
    """
    keys = parents.select(F.col(key).cast("bigint").alias("k")).where("k is not null").distinct()
    keys = keys.withColumn("block", F.floor(F.col("k") / F.lit(block_keys)))
    order = Window.partitionBy("block").orderBy("k")
    islands = keys.withColumn("island", F.col("k") - F.row_number().over(order))
    return islands.groupBy("block", "island").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("island")


def beyond_runs(references: DataFrame, key: str, runs: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Distinct reference keys (column ``key``) that no run covers, by an as-of match to the preceding run start."""
    wanted = references.select(F.col(key).cast("bigint").alias("k")).where("k is not null").distinct()
    marks = wanted.select(F.floor(F.col("k") / F.lit(block_keys)).alias("block"), "k", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_end"))
    marks = marks.unionByName(runs.select("block", F.col("run_start").alias("k"), F.lit(0).alias("kind"), "run_end"))
    asof = Window.partitionBy("block").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("covers_to", F.last("run_end", ignorenulls=True).over(asof))
    return seen.where("kind = 1 and (covers_to is null or k > covers_to)").select(F.col("k").alias(key))


def last_deletions(deletions: DataFrame, key: str = "doc_id", at: str = "deleted_at") -> DataFrame:
    return deletions.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(at).alias("last_deleted"))


def parent_state(documents: DataFrame, deletions: DataFrame, *extra: str) -> DataFrame:
    """doc_id, ingested_at, live (false if a deletion is at or after the ingest) and extra columns."""
    docs = documents.select("doc_id", "ingested_at", *extra)
    joined = docs.join(last_deletions(deletions), "doc_id", "left")
    gone = F.col("last_deleted").isNotNull() & F.coalesce(F.col("last_deleted") >= F.col("ingested_at"), F.lit(False))
    return joined.withColumn("live", ~gone).drop("last_deleted")


def month(at: str | Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def spread_join(refs: DataFrame, parents: DataFrame, key: str, counts: DataFrame, hot: int, by: Column, how: str = "inner") -> DataFrame:
    """Join of references to parents on ``key``; a key with more than ``hot`` references spreads over several tasks.

    ``counts``: key, n_refs. Rows of a hot key get one of as many salts as their number needs (chosen by ``by``), and
    the key's parent is copied for each salt. Without hot keys it is a plain join.
    """
    hot_keys = counts.where(F.col("n_refs") > hot).select(key, F.ceil(F.col("n_refs") / F.lit(hot)).cast("int").alias("salts"))
    n_hot = hot_keys.count()
    if not n_hot:
        return refs.join(parents, key, how)
    hot_keys = broadcast_if_small(hot_keys, n_hot, 64)
    salted = refs.join(hot_keys, key, "left").withColumn("salt", F.pmod(by, F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = parents.join(hot_keys, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(copies, [key, "salt"], how).drop("salt")


def orphan_chunks(chunks: DataFrame, documents: DataFrame, deletions: DataFrame, block_keys: int = BLOCK_KEYS, hot: int = HOT_REFERENCES) -> DataFrame:
    """Chunk references that do not hold: ref_table, period, ref_id, doc_key, section.

    A null doc_id is no reference. A null created_at or ingested_at can't show that the document came later,
    so such a reference holds if its document is live; its period is null. Repeated rows give one case.
    Empty documents make every reference a case; empty chunks give no rows. Other columns are not looked at.
    References are reduced to distinct keys before the match; a key with more than ``hot`` references is
    spread over several tasks in the final join.
    """
    refs = chunks.select("chunk_id", F.col("doc_id").cast("bigint").alias("doc_id"), "created_at").where("doc_id is not null")
    state = parent_state(documents, deletions)
    live = state.where("live").select("doc_id", "ingested_at")
    by_key = refs.groupBy("doc_id").agg(F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("n_refs"))
    absent = beyond_runs(by_key, "doc_id", key_runs(live, "doc_id", block_keys), block_keys)
    absent = absent.select("doc_id", F.lit(None).cast("timestamp_ntz").alias("holds_from"))
    late = by_key.join(live, "doc_id").where("first_at < ingested_at").select("doc_id", F.col("ingested_at").cast("timestamp_ntz").alias("holds_from"))
    bad = absent.unionByName(late).join(by_key.select("doc_id", "n_refs"), "doc_id")
    bad = materialise(bad, "bad-keys")
    cases = spread_join(refs, bad.select("doc_id", "holds_from"), "doc_id", bad.select("doc_id", "n_refs"), hot, F.xxhash64("chunk_id", "created_at"))
    cases = cases.where("holds_from is null or created_at < holds_from")
    return cases.select(
        F.lit("chunks").alias("ref_table"), month("created_at").alias("period"), F.col("chunk_id").alias("ref_id"),
        F.col("doc_id").cast("string").alias("doc_key"), F.lit("").alias("section"),
    ).distinct()


def orphan_judgements(qrels: DataFrame, documents: DataFrame, deletions: DataFrame, hot: int = HOT_REFERENCES) -> DataFrame:
    """Judgement references that do not hold, documents and sections, in the columns of orphan_chunks.

    Documents are named by ``source_file``; text keys have no runs, so they are matched by equality, exact in
    every character. Null relevant, document, sections or section are no references. A document without
    section_headings has none, so every section named in it is a case. Repeated targets give one case.
    """
    targets = qrels.select("query_id", "judged_at", F.explode("relevant").alias("r")).select("query_id", "judged_at", F.col("r.document").alias("document"), F.col("r.sections").alias("sections"))
    targets = targets.where("document is not null")
    named = parent_state(documents, deletions, "source_file", "section_headings").where("source_file is not null")
    named = named.withColumnRenamed("source_file", "document").withColumnRenamed("doc_id", "found_id")
    counts = targets.groupBy("document").agg(F.count(F.lit(1)).alias("n_refs"))
    met = spread_join(targets, named, "document", counts, hot, F.xxhash64("query_id", "judged_at"), "left")
    holds = F.col("found_id").isNotNull() & F.col("live") & ~F.coalesce(F.col("ingested_at") > F.col("judged_at"), F.lit(False))
    met = met.withColumn("holds", F.coalesce(holds, F.lit(False)))
    missing = F.filter(F.coalesce("sections", F.array().cast("array<string>")), lambda s: s.isNotNull() & ~F.coalesce(F.array_contains(F.col("section_headings"), s), F.lit(False)))
    met = met.withColumn("section", F.explode(F.when(F.col("holds"), missing).otherwise(F.array(F.lit("")))))
    return met.select(
        F.lit("qrels").alias("ref_table"), month("judged_at").alias("period"), F.col("query_id").alias("ref_id"),
        F.col("document").alias("doc_key"), "section",
    ).distinct()


def orphan_references(chunks: DataFrame, qrels: DataFrame, documents: DataFrame, deletions: DataFrame) -> DataFrame:
    return orphan_chunks(chunks, documents, deletions).unionByName(orphan_judgements(qrels, documents, deletions))


def orphan_report(cases: DataFrame) -> DataFrame:
    """Number of orphan references and of distinct referring records per table and month."""
    return cases.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_id").alias("n_referring"))
