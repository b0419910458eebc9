"""Mixing sources to target weights by Pareto order sampling.

Each source of a mix gets a token goal; every document gets its certain whole copies, and the rest of the goal is
drawn by Pareto order sampling: documents are ranked by random odds over inclusion odds, and the ranking is taken up
to the goal. The ranking's prefix is found through a histogram of the ranks, so no source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.runtime import broadcast_if_small, materialise

#: Buckets of the rank histogram of one source of one mix; only the bucket that holds the goal is sorted.
BUCKETS = 4096


def uniform(seed: int, *by: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the seed and the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def goals(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Token goal of each mix and source by water-filling.

    The mix's size is that of all documents of its sources. Sources share it by target_share; one whose cap
    (max_repeats times its tokens) is below its share is filled to the cap, and what it leaves is shared by the others
    in proportion. Columns: mix_name, source, share (relative, adding to 1), cap, tokens, goal.
    """
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
    t = t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    t = t.withColumns({"cap": F.col("repeats") * F.col("tokens"), "share": F.col("w") / F.sum("w").over(mix)})
    t = t.withColumn("total", F.least(F.sum("tokens").over(mix), F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).over(mix)))
    # sources in the order in which rising water meets their caps: cap over weight
    t = t.withColumn("level", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
    before = Window.partitionBy("mix_name").orderBy(F.col("level").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(mix) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    t = t.withColumn("water", F.when(F.col("w_left") > 1e-12, (F.col("total") - F.col("filled")) / F.col("w_left")))
    # the first source whose cap lies above the water at its place sets the level of all that follow
    t = t.withColumn("stops", F.col("level") > F.col("water"))
    t = t.withColumn("final", F.first(F.when(F.col("stops"), F.col("water")), ignorenulls=True).over(mix.orderBy(F.col("level").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    goal = F.when(F.col("w") <= 0, F.lit(0.0)).when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")))
    return t.select("mix_name", "source", "share", "repeats", "cap", "tokens", goal.alias("goal"))


def inclusion(goal: DataFrame, weights: DataFrame) -> DataFrame:
    """Certain copies and the factor of the inclusion probabilities of each mix and source.

    ``weights`` has, by source, the distinct document weights w with the tokens they hold. Beyond the certain copies,
    a document is included with probability min(1, factor * w); the factor makes the expected tokens meet the goal.
    """
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens") + 1e-9)).otherwise(0)
    g = goal.withColumn("copies", whole.cast("int")).withColumn("rest", F.greatest(F.col("goal") - F.col("copies") * F.col("tokens"), F.lit(0.0)))
    j = g.join(weights, "source")
    up = Window.partitionBy("mix_name", "source").orderBy(F.col("w").desc())
    j = j.withColumns({"sure": F.coalesce(F.sum("w_tokens").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "mass": F.sum(F.col("w") * F.col("w_tokens")).over(up.rowsBetween(0, Window.unboundedFollowing))})
    j = j.withColumn("factor", F.when(F.col("mass") > 0, (F.col("rest") - F.col("sure")) / F.col("mass")))
    ok = j.where("factor is not null and factor * w <= 1 + 1e-9").groupBy("mix_name", "source").agg(F.max_by("factor", "w").alias("factor"))
    return g.join(ok, ["mix_name", "source"], "left").withColumn("factor", F.greatest(F.coalesce("factor", F.lit(0.0)), F.lit(0.0)))


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 20260101, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Documents of each mix with their copies, and the shares reached.

    ``sized``: doc_id, source, n_tokens, w (positive weight of the document within its source). First result:
    mix_name, source, doc_id, n_tokens, copies (> 0, at most max_repeats). Second: mix_name, source, target_share,
    goal_tokens, tokens, share, documents, source_tokens.

    Documents with a null source or no tokens are in no mix; a source without documents gets nothing and its share
    goes to the others; null max_repeats means once; null or negative target shares count as 0; targets given twice
    add up; empty tables give no rows. The same seed gives the same mix.
    """
    docs = sized.where("source is not null and n_tokens > 0")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = docs.groupBy("source", "w").agg(F.sum("n_tokens").alias("w_tokens"))
    # a row for each target: written once, for it is read at every step
    goal = materialise(goals(targets, sizes), "goals")
    plan = materialise(inclusion(goal, weights).select("mix_name", "source", "repeats", "copies", "rest", "factor"), "plan")
    # one row for each target at most, so the number of targets bounds what is broadcast, and no source is shuffled as one
    bound = targets.count()
    d = docs.join(broadcast_if_small(plan, bound, 128), "source")
    p = F.least(F.col("factor") * F.col("w"), F.lit(1.0))
    u = uniform(seed, F.col("mix_name"), F.col("doc_id"))
    # Pareto rank: odds of u over odds of p; 0 for certain inclusion, null where the source has no rest to fill
    rank = F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) * ((1 - p) / p))
    d = d.withColumn("q", F.when((F.col("rest") > 0) & (F.col("copies") < F.col("repeats")), rank))
    d = d.withColumn("bucket", F.floor(F.lit(buckets) * F.col("q") / (1 + F.col("q"))).cast("int"))
    hist = d.where("bucket is not null").groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).join(plan.select("mix_name", "source", "rest"), ["mix_name", "source"])
    edge = hist.where("before < rest and before + t >= rest").select("mix_name", "source", F.col("bucket").alias("edge"), F.col("before").alias("edge_before"))
    d = d.join(broadcast_if_small(edge, bound, 96), ["mix_name", "source"], "left")
    # only the documents of the edge bucket are put in order; the prefix ends where it is nearest to the goal
    at_edge = d.where("bucket = edge").withColumn("cum", F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) + F.col("edge_before"))
    taken = (F.abs(F.col("cum") - F.col("rest")) <= F.abs(F.col("cum") - F.col("n_tokens") - F.col("rest"))) & (F.col("cum") - F.col("n_tokens") < F.col("rest"))
    out = ["mix_name", "source", "doc_id", "n_tokens", "copies"]
    chosen = at_edge.select(*out[:4], (F.col("copies") + taken.cast("int")).alias("copies"))
    others = d.where("bucket is null or edge is null or bucket <> edge").select(*out[:4], (F.col("copies") + F.coalesce((F.col("bucket") < F.coalesce("edge", F.lit(buckets + 1))).cast("int"), F.lit(0))).alias("copies"))
    mix = others.unionByName(chosen).where("copies > 0")
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("got"), F.count(F.lit(1)).alias("documents"))
    report = goal.join(got, ["mix_name", "source"], "left").fillna(0, ["got", "documents"])
    whole = F.sum("got").over(Window.partitionBy("mix_name"))
    report = report.select(
        "mix_name", "source", F.round("share", 9).alias("target_share"), F.round("goal", 3).alias("goal_tokens"), F.col("got").alias("tokens"),
        F.when(whole > 0, F.round(F.col("got") / whole, 9)).alias("share"), "documents", F.col("tokens").alias("source_tokens"),
    )
    return mix, report
