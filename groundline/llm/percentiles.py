"""Exact percentiles per group by distributed multi-select, over blocks that can be joined across days and shares.

A block is one sorted array of values of a group that one partition saw; blocks of different days or shares of a
table are joined by a plain union. All percentiles of a group are selected together. In every round each block
proposes the median of its values still in question, the weighted median of the proposals becomes the pivot, and the
blocks are counted and cut three ways (below, equal, above). The wanted ranks fall to one of the three parts; a part
without a wanted rank is discarded, so the blocks shrink from round to round. Every group passes at least one round,
and it ends when the pivot is the value, or when no more than a handful of values are left to compare. Values never
leave their blocks' partitions but for that handful; the error is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.runtime import BROADCAST_BYTES, discard, materialise

#: Values a partition gathers before it writes its blocks: bounds a task's memory and a block's size.
BLOCK_VALUES = 1 << 19
#: So few values are compared directly.
FINISH = 16
#: Bytes taken for one row of the selection's state when it is broadcast.
STATE_BYTES = 400
#: Where the state is too large to broadcast, the blocks of a group spread over so many tasks.
SALTS = 32


def _block_batches(limit: int):
    def flush(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        names = t.schema.names[:-1]
        pdf = t.select(names).to_pandas()
        v = t.column(len(names)).to_numpy()
        g = pdf.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        ends = np.r_[starts[1:], len(g)]
        keys = t.select(names).take(pa.array(order[starts])).combine_chunks()
        values = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(g)], pa.int32()), pa.array(v))
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys.columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ends - starts, pa.int64()), values], [*names, "n_values", "sorted_values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= limit:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def sorted_blocks(values: DataFrame, by: list[str], value: str, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Blocks of every group: by, n_values, sorted_values (array<double>).

    Null and NaN values are passed over; null group keys are a group of their own; no shuffle takes place. An empty
    table gives no blocks.
    """
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("value__"))
    keys = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(_block_batches(block_values), f"{keys}, n_values bigint, sorted_values array<double>")


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (g, seg, pivot, salt, v) -> their parts (g, at, side, salt, n, median, v): below -1, equal 0, above 1.

    The equal values are only counted. A part's median is its proposal for the next round.
    """
    for batch in batches:
        v, pivots = batch.column(4), batch.column(2).to_numpy(zero_copy_only=False)
        ends, flat = v.offsets.to_numpy(), v.values.to_numpy()
        rows, sides, counts, medians, parts = [], [], [], [], []
        for i, pivot in enumerate(pivots):
            block = flat[ends[i] : ends[i + 1]]
            a, b = int(np.searchsorted(block, pivot, "left")), int(np.searchsorted(block, pivot, "right"))
            for side, n, part in ((-1, a, block[:a]), (0, b - a, block[:0]), (1, len(block) - b, block[b:])):
                if n:
                    rows.append(i), sides.append(side), counts.append(n), parts.append(part)
                    medians.append(float(part[(n - 1) // 2]) if side else float(pivot))
        offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32())
        values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64()))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pc.take(batch.column(0), take), pc.take(batch.column(1), take), pa.array(sides, pa.int32()), pc.take(batch.column(3), take), pa.array(counts, pa.int64()), pa.array(medians, pa.float64()), values],
            ["g", "at", "side", "salt", "n", "median", "v"],
        )


def _met(blocks: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    """Blocks joined to rows of the state on (g, at, side).

    A state of a checked size is broadcast. A larger one has very many groups and is shuffled, each of its rows to all
    salts, so that the blocks of a hot group spread over several tasks.
    """
    if rows * STATE_BYTES <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(state), ["g", "at", "side"])
    return blocks.join(state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "at", "side", "salt"])


def _sides(parts: DataFrame) -> DataFrame:
    """Of every (g, at): below, equal and above, the values on each side, and the sides' pivots low and high.

    A pivot is the weighted lower median of the blocks' proposals, so it is one of the values. Only counts and
    proposals are shuffled.
    """
    p = parts.select("g", "at", "side", "n", "median").repartition("g", "at")
    w = Window.partitionBy("g", "at", "side")
    upto = F.sum("n").over(w.orderBy("median").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumns({"upto": upto, "all": F.sum("n").over(w)}).withColumn("half", F.when(2 * F.col("upto") >= F.col("all"), F.col("median")))
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    return p.groupBy("g", "at").agg(*[F.coalesce(F.sum(of(s, "n")), F.lit(0)).alias(c) for s, c in ((-1, "below"), (0, "equal"), (1, "above"))], F.min(of(-1, "half")).alias("low"), F.min(of(1, "half")).alias("high"))


_TARGETS = "array<struct<i:int,p:double,k:bigint>>"


def select_percentiles(blocks: DataFrame, by: list[str], ps: list[float], finish: int = FINISH, rounds: list[int] | None = None) -> DataFrame:
    """Exact percentiles of every group: by, p, n, value.

    The p-th percentile is the value of rank ceil(p * n) (the lowest value that at least a share p does not exceed).
    ``blocks`` come from sorted_blocks and are read from a table; groups without values give no row. Ties are values
    like any other; infinite values order as numbers; a percentile asked for twice is given once. ``rounds``, if
    given, gets the number of segments that went through each round.
    """
    ps = sorted({float(p) for p in ps})
    names = {c: f"by{i}" for i, c in enumerate(by)}
    g = F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    # all values of a group lie above the pivot of no round
    work = blocks.select(
        g.alias("g"), F.lit(-1).alias("at"), F.lit(1).alias("side"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), F.col("n_values").alias("n"),
        F.expr("sorted_values[cast((n_values - 1) div 2 as int)]").alias("median"), F.col("sorted_values").alias("v"),
    )
    key = work.schema["g"].dataType.simpleString()
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9)).cast("bigint")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), rank(p).alias("k")) for i, p in enumerate(ps)]).cast(_TARGETS)
    # a segment (g, seg) is named by its first target; its values lie in the part (at, side) of the blocks
    state = _sides(work).select("g", F.col("above").alias("n"), F.col("high").alias("pivot"))
    state = state.select("g", F.lit(-1).alias("at"), F.lit(1).alias("side"), F.lit(0).alias("seg"), "n", "pivot", wanted.alias("targets"), F.lit(None).cast("double").alias("value"))
    state, written = materialise(state, "selection"), []
    while n_open := state.where("value is null").count():
        if rounds is not None:
            rounds.append(n_open)
        asked = state.where("value is null").select("g", "at", "side", "seg", "pivot")
        parts = _met(work.select("g", "at", "side", "salt", "v"), asked, n_open).select("g", "seg", "pivot", "salt", "v")
        parts = materialise(parts.mapInArrow(_cuts, f"g {key}, at int, side int, salt int, n bigint, median double, v array<double>"), "parts")
        following = materialise(_allotted(state, parts, n_open, finish), "selection")
        for old in (state, *written):
            discard(old)
        work, state, written = parts, following, [parts]
    out = state.select("g", "n", F.explode("targets").alias("t"), "value")
    return out.select(*[F.col(f"g.{n}").alias(c) for c, n in names.items()], F.col("t.p").alias("p"), "n", "value")


def _allotted(state: DataFrame, parts: DataFrame, n_open: int, finish: int) -> DataFrame:
    """The state after a round: targets fall below, on or above the pivot; small rests are compared directly."""
    # the state's own rows join without a shuffle where their counted size allows it
    small = lambda df: F.broadcast(df) if 2 * n_open * STATE_BYTES <= BROADCAST_BYTES else df
    s = _sides(parts).withColumnRenamed("at", "seg").join(small(state.where("value is null").drop("at", "side", "value")), ["g", "seg"])
    part = F.expr("""filter(array(
        named_struct('side', -1, 'left', below, 'pivot', low, 'targets', filter(targets, t -> t.k <= below)),
        named_struct('side', 0, 'left', equal, 'pivot', pivot, 'targets', filter(targets, t -> t.k > below and t.k <= below + equal)),
        named_struct('side', 1, 'left', above, 'pivot', high, 'targets',
            transform(filter(targets, t -> t.k > below + equal), t -> named_struct('i', t.i, 'p', t.p, 'k', t.k - below - equal)))
        ), part -> size(part.targets) > 0)""")
    s = s.select("g", F.col("seg").alias("at"), "n", F.explode(part).alias("part")).select("g", "at", "n", "part.*")
    few = _met(parts.select("g", "at", "side", "salt", "v"), s.where(f"side <> 0 and left <= {finish}").select("g", "at", "side"), 2 * n_open)
    few = few.groupBy("g", "at", "side").agg(F.array_sort(F.flatten(F.collect_list("v"))).alias("few"))
    s = s.join(small(few), ["g", "at", "side"], "left")
    # a target that is found by comparison gets a row of its own
    s = s.withColumn("targets", F.explode(F.when(F.col("few").isNull(), F.array("targets")).otherwise(F.transform("targets", lambda t: F.array(t)))))
    value = F.when(F.col("side") == 0, F.col("pivot")).otherwise(F.expr("few[cast(targets[0].k as int) - 1]"))
    s = s.select("g", "at", "side", F.expr("targets[0].i").alias("seg"), "n", "pivot", F.col("targets").cast(_TARGETS).alias("targets"), value.alias("value"))
    return state.where("value is not null").unionByName(s)
