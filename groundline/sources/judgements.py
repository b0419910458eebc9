"""Relevance judgements from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.config import EvaluationError

JUDGEMENTS = """version string, corpus string, description string, queries array<struct<query_id:string,query:string,type:string,
relevant:array<struct<document:string,sections:array<string>>>,answer_terms:array<string>>>"""


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """One row a query: query_id, query, type, relevant, answer_terms. Malformed files and files without queries raise."""
    q = spark.read.schema(JUDGEMENTS).json(path, multiLine=True, mode="FAILFAST").select(F.explode("queries").alias("q")).select("q.*")
    if not q.head(1):
        raise EvaluationError(f"{path} holds no queries")
    return q.withColumn("type", F.coalesce("type", F.lit("single_hop"))).withColumn("answer_terms", F.coalesce("answer_terms", F.array().cast("array<string>")))


def targets(judgements: DataFrame) -> DataFrame:
    """Targets of judgements: query_id, target, document, sections (null sections mean the whole document)."""
    return judgements.select("query_id", F.posexplode("relevant").alias("target", "r")).select("query_id", "target", "r.document", F.coalesce("r.sections", F.array().cast("array<string>")).alias("sections"))
