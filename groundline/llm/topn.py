"""Top N items within every group by secondary sort.

Rows are sorted by group, score and identifier, and a streaming pass over Arrow batches emits the first N distinct
items of each group, holding no more than N identifiers of the group it is in. The pass runs first within the input
partitions, without a shuffle: each emits at most N items a group, so a group with a third of all rows reaches the
shuffle as N items per input partition. The survivors are hash-partitioned by group and pass the same operator again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int, places: bool):
    """Batches of (g, item, ...) sorted by group and merit: keeps the first n distinct items of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = pc.dictionary_encode(batch.column(0))
            codes = g.indices.to_numpy(zero_copy_only=False)
            items = pc.dictionary_encode(batch.column(1)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
            pair = run_of * (items.max() + 1) + items
            order = np.argsort(pair, kind="stable")
            first = np.zeros(len(codes), bool)
            first[order[np.r_[True, pair[order][1:] != pair[order][:-1]]]] = True
            # the group carried over from the batch before: its items so far are passed over
            carried = batch.column(0)[0].as_py() == group
            if carried:
                end = starts[1] if len(starts) > 1 else len(codes)
                old = pc.is_in(batch.column(1).slice(0, end), pa.array(list(taken), batch.column(1).type)).to_numpy(zero_copy_only=False)
                first[:end] &= ~old
            seen = np.cumsum(first)
            place = seen - np.repeat(np.r_[0, seen[starts[1:] - 1]], np.diff(np.r_[starts, len(codes)]))
            if carried:
                place[: starts[1] if len(starts) > 1 else len(codes)] += len(taken)
            keep = np.flatnonzero(first & (place <= n))
            last = starts[-1]
            if not (carried and len(starts) == 1):
                taken = {}
            for i in keep[keep >= last]:
                taken[batch.column(1)[int(i)].as_py()] = True
            group = batch.column(0)[len(codes) - 1].as_py()
            if len(keep):
                out = batch.take(pa.array(keep))
                if places:
                    out = pa.RecordBatch.from_arrays([out.column(0), pa.array(place[keep].astype(np.int32)), out.column(1)], [out.schema.field(0).name, "place", out.schema.field(1).name])
                yield out

    return run


def top_n(rows: DataFrame, group: str, item: str, score: str, tie: str, n: int = 10) -> DataFrame:
    """The n best distinct items of every group: group, place (1..n), item.

    An item counts once per group by its best row. Order: score descending, ``tie`` ascending with null last, item
    ascending. Rows with a null item or group, or a null or NaN score, are passed over; infinite scores order as
    numbers. Repeated rows and items are one; groups with fewer than n items give fewer; empty tables give no rows.
    """
    g, i = rows.schema[group].dataType.simpleString(), rows.schema[item].dataType.simpleString()
    clean = rows.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(tie).alias("tie"))
    clean = clean.where("g is not null and item is not null and score is not null and not isnan(score)")
    merit = [F.col("g"), F.col("score").desc(), F.col("tie").asc_nulls_last(), F.col("item")]
    local = clean.sortWithinPartitions(*merit).mapInArrow(_first_n(n, False), clean.schema)
    final = local.repartition("g").sortWithinPartitions(*merit).mapInArrow(_first_n(n, True), f"g {g}, place int, item {i}")
    return final.select(F.col("g").alias(group), "place", F.col("item").alias(item))
