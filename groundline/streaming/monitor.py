"""Streams over the query log and over dropped files (an extension: the batch operators are the reference point)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.operators.store import replace_groups
from groundline.runtime import delete


def log_windows(log: DataFrame, at: str = "created_at", length: str = "10 minutes", slide: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Sliding windows: window_start, window_end, queries, mean_groundedness, mean_latency. Batch or stream.

    In a stream rows later than the watermark are dropped from closed windows, so each window comes out once. Impossible
    measurements are no measurements: a negative or NaN latency and a groundedness outside 0 to 1 count as null. Means
    are sums of billionths, rounded half up to six places, so they don't depend on the order of the rows.
    """
    rows = log.withWatermark(at, late) if log.isStreaming and late else log
    rows = rows.withColumns({"groundedness": F.when(F.col("groundedness").between(0, 1), F.col("groundedness")), "latency_ms": F.when((F.col("latency_ms") >= 0) & ~F.isnan("latency_ms"), F.col("latency_ms"))})

    def mean(c: str):
        total, n = F.sum(F.round(F.col(c) * 1e9).cast("bigint")), F.count(c)
        return F.when(n > 0, F.call_function("div", 2 * total + 1000 * n, 2000 * n) / 1e6)

    g = rows.groupBy(F.window(at, length, slide)).agg(F.count(F.lit(1)).alias("queries"), mean("groundedness").alias("mean_groundedness"), mean("latency_ms").alias("mean_latency"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "queries", "mean_groundedness", "mean_latency")


def alerts(windows: DataFrame, least_groundedness: float = 0.8, most_latency: float = 1500.0) -> DataFrame:
    return windows.where((F.col("mean_groundedness") < least_groundedness) | (F.col("mean_latency") > most_latency))


def ingest(spark: SparkSession, folder: str, schema: str, table_path: str, keys: list[str], checkpoint: str, on_batch: Callable[[DataFrame], DataFrame] | None = None):
    """Files dropped to a folder are upserted into a table; a batch that runs again gives the same table.

    Every batch writes a new version of the table beside the old one and then names it in a pointer file. The version
    before stays for those who are reading it; older ones are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = on_batch(batch) if on_batch else batch
        new = new.dropDuplicates(keys)
        old = current(spark, table_path)
        out = new if old is None else replace_groups(old, new, keys)
        out.write.mode("overwrite").parquet(f"{table_path}/v{number}")
        spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("overwrite").json(f"{table_path}/pointer")
        delete(spark, f"{table_path}/v{number - 2}")

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The table's present version; None before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        version = spark.read.schema("version int").json(f"{table_path}/pointer").first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{table_path}/v{version['version']}") if version else None
