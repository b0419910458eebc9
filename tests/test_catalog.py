"""Registered queries against the engine's own settings and exact results, on the smallest tables."""

import numpy as np
from pyspark.sql import functions as F

from groundline.config import Settings
from groundline.operators import dense, metrics, rerank
from groundline.plans import catalog, search
from groundline.runtime import table

TABLES = "/root/testdata/sf0.001"


def exact_latent_top(spark, folder, dim, k):
    """The k nearest documents of every 20th one by an exact decomposition: {doc_id: [doc_id]}."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights, _ = dense.tfidf(docs, "doc_id", F.col("text"))
    rows = weights.toPandas()
    ids, at = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    terms, column = np.unique(rows["term"].to_numpy(), return_inverse=True)
    x = np.zeros((len(ids), len(terms)))
    x[at, column] = rows["w"]
    values, u = np.linalg.eigh(x @ x.T)
    keep = np.argsort(values)[::-1][: min(dim, len(ids) - 1)]
    p = u[:, keep] * np.sqrt(np.maximum(values[keep], 0))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    scores = np.round(p @ p.T, 6)
    return {int(d): [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-scores[i, j], ids[j]))[:k]] for i, d in enumerate(ids) if d % 20 == 0}


def latent_recall(spark, folder):
    want = exact_latent_top(spark, folder, 256, 5)
    got = {}
    for r in catalog.lsi_topk(spark, folder).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got.keys() == want.keys()
    return sum(len(set(got[d]) & set(want[d])) for d in want) / sum(map(len, want.values()))


def test_latent_top_k_like_an_exact_decomposition(spark):
    assert latent_recall(spark, TABLES) >= 0.99


def test_reranker_learns_from_fused_candidates(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rerank, "fit", lambda rows, fit=rerank.fit: seen.append(rows) or fit(rows))
    hits = catalog.rerank_logistic(spark, TABLES)
    r = seen[0].agg(F.count_distinct("dense_score").alias("dense"), F.sum((F.col("score") != F.col("lexical_score")).cast("int")).alias("fused"), F.sum((F.col("lexical_score") == 0).cast("int")).alias("dense_only"), F.max("label").alias("label")).first()
    assert r.dense > 1 and r.fused > 0 and r.dense_only > 0 and r.label == 1
    assert 0 < hits.count() == hits.select("query_id", "chunk_id").distinct().count()


def test_probe_queries_take_the_whole_path(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "answer", lambda index, queries, settings: seen.append((index, settings)) or queries)
    catalog.answer_probe_queries(spark, TABLES)
    index, settings = seen[0]
    assert settings == Settings() and index.model is not None and index.model.numFeatures == 10
    assert index.vectors.where(F.size("vector") > 32).count() == index.vectors.count() > 0


def test_bootstrap_takes_the_default_resamples(spark):
    q = table(spark, TABLES, "query_log").where("groundedness between 0 and 1").select("query_id", "groundedness").dropDuplicates(["query_id"])
    assert catalog.bootstrap_mean(spark, TABLES).first() == metrics.bootstrap_intervals(q, ["groundedness"], resamples=2000).drop("measure").first()
