"""Groundline: a Spark-native engine for retrieval, grounding and evaluation over document corpora."""

__version__ = "0.1.0"
