"""What an endpoint calls: checked requests, the state of a running service, health and counters, DDL and logging."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.config import GroundlineError, RequestError, Settings
from groundline.functions import text as T
from groundline.operators import store
from groundline.plans import evaluate, search
from groundline.sources.judgements import read_judgements

# Limits of requests.
QUERY_CHARS, MOST_HITS, MOST_DOCUMENTS = 2000, 50, 200


@dataclass
class State:
    """The index and settings of a running service, and where it logs its queries; ``error`` if it could not start."""

    settings: Settings
    index: search.Index | None = None
    facts: DataFrame | None = None
    log_path: str | None = None
    error: str | None = None


def build_state(spark: SparkSession, settings: Settings, folder: str, facts: DataFrame | None = None, log_path: str | None = None) -> State:
    """State at startup from a saved index. A service whose index can't be loaded runs, degraded, and says why."""
    state = State(settings, facts=facts, log_path=log_path)
    try:
        state.index = search.load_index(spark, folder)
    except GroundlineError as e:
        state.error = str(e)
        log.warning("the index is not available: %s", e)
    return state


def _ready(state: State) -> search.Index:
    if state.index is None:
        raise RequestError(state.error or "the index is not available")
    return state.index


def check_top_k(top_k: int | None) -> None:
    if top_k is not None and not 1 <= top_k <= MOST_HITS:
        raise RequestError(f"top_k lies between 1 and {MOST_HITS}")


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries within the limits, and the others with the reason: query_id, error."""
    size = F.coalesce(F.length("query"), F.lit(0))
    reason = F.when(size < 1, "an empty query").when(size > QUERY_CHARS, f"more than {QUERY_CHARS} characters")
    return queries.where(reason.isNull()), queries.where(reason.isNotNull()).select("query_id", reason.alias("error"))


def query(state: State, queries: DataFrame, top_k: int | None = None, include_evidence: bool = False) -> DataFrame:
    """Answers of checked queries as JSON: query_id, response. They are logged if the state names a log.

    Queries beyond the limits come back with an error.
    """
    index = _ready(state)
    check_top_k(top_k)
    good, bad = valid_queries(queries)
    run = search.run_queries(index, good, state.settings, top_k, state.facts)
    if state.log_path:
        store.log_queries(run.answers, state.log_path)
    out = answer_responses(run, include_evidence)
    return out.unionByName(bad.select("query_id", F.to_json(F.struct("error")).alias("response")))


def answer_responses(run: search.Run, include_evidence: bool = False) -> DataFrame:
    """Wire form of answers: query_id, response (JSON with the answer, its citations and, if asked for, its evidence)."""
    cited = run.citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "chunk_id", "quote", "support_score", "verified"))).alias("citations"))
    out = run.answers.join(cited, "query_id", "left")
    if include_evidence:
        held = run.evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("evidence"))
        out = out.join(held, "query_id", "left")
    return search.responses(out)


def hit_responses(hits: DataFrame) -> DataFrame:
    """Wire form of hits: one row a hit with its scores, unknown ones as null."""
    return hits.select("qid", "chunk_id", "doc_id", "source_type", "section_heading", "text", "score", "lexical_score", "dense_score", "rerank_score", "rank")


def ingest(state: State, documents: DataFrame) -> dict:
    """Adds documents (1 to 200 with a text) to the index of the state."""
    n = documents.limit(MOST_DOCUMENTS + 1).count()
    if not 1 <= n <= MOST_DOCUMENTS:
        raise RequestError(f"a request brings 1 to {MOST_DOCUMENTS} documents")
    if documents.where(F.coalesce(F.length("text"), F.lit(0)) < 1).head(1):
        raise RequestError("a document without text")
    state.index = search.add_documents(_ready(state), documents, state.settings)
    return {"ingested": n, "total_documents": state.index.documents.count(), "total_chunks": state.index.chunks.count()}


def evaluation(state: State, spark: SparkSession, judgement_path: str | None, relevant: DataFrame) -> dict:
    """Retrieval summary of the state's index over a judgement file."""
    if not judgement_path:
        raise RequestError("no judgement file is named")
    judged = read_judgements(spark, judgement_path)
    return evaluate.summary(evaluate.evaluate_retrieval(_ready(state), judged.select("query_id", "query", "type"), relevant, state.settings), state.settings)


def health(state: State, database_url: str = "") -> dict:
    """Readiness, sizes of the index, and the database's address without its password."""
    sizes = {r["source_type"] or "all": r["chunks"] for r in state.index.describe().collect()} if state.index else {"built": False}
    shown = state.index.chunks.sparkSession.range(1).select(T.redact_url(F.lit(database_url))).first()[0] if state.index else ""
    return {"status": "ok" if state.index else "degraded", "index": sizes | ({"error": state.error} if state.error else {}), "database": shown}


def counters(log_: DataFrame) -> DataFrame:
    """Counters over the query log by strategy: queries, latency_sum and groundedness_sum."""
    return log_.groupBy("strategy").agg(F.count(F.lit(1)).alias("queries"), F.sum("latency_ms").alias("latency_sum"), F.sum("groundedness").alias("groundedness_sum"))


_SQL_TYPES = {"string": "TEXT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "date": "DATE", "timestamp": "TIMESTAMPTZ"}


def schema_sql() -> str:
    """DDL of the side tables for an SQL database, from the same columns and keys as the engine's own tables."""
    out = []
    for name, columns in store.TABLES.items():
        lines = [f"    {c} {_SQL_TYPES[kind]}" for c, kind in (x.strip().split(" ") for x in columns.split(","))]
        out.append(f"CREATE TABLE IF NOT EXISTS {name} (\n" + ",\n".join([*lines, f"    PRIMARY KEY ({', '.join(store.KEYS[name])})"]) + "\n);")
    return "\n\n".join(out)


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}, ensure_ascii=False)


def configure_logging(level: str = "INFO", json_output: bool = False) -> logging.Logger:
    """The engine's log on standard error, as lines or JSON; called again, it takes the new level and form."""
    root = logging.getLogger("groundline")
    handler = logging.StreamHandler()
    handler.setFormatter(_JsonLines() if json_output else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    root.handlers[:], root.propagate = [handler], False
    root.setLevel(getattr(logging, level.upper(), logging.INFO))
    return root


log = logging.getLogger(__name__)
