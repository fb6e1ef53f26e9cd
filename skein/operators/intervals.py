"""Continuous periods and gaps of overlapping closed intervals, by compressed run bitmaps.

Time is discretised without loss: instant ``t`` is bit ``2t`` and the open stretch between ``t`` and ``t + 1`` is bit
``2t + 1``. A closed interval ``[s, e]`` sets the bits ``2s .. 2e``, so intervals that share an instant join while
``[1, 2]`` and ``[3, 4]`` stay apart (bit 5 is clear). The bit axis of an entity is cut into shards of a power of two
instants, chosen per trace by how dense its intervals lie, about ``SHARD_INTERVALS`` to a shard. A shard's bitmap is kept
compressed as its runs of set bits. An interval over more than two shards sets one run at the upper level, in a
bitmap of whole shards, so no interval yields more than three rows.

Bitmaps are united within each map task before the shuffle and again per (entity, shard) after it; a hot entity is
thereby spread over its shards. Only the first and last run of each shard go on to the entity level, to join runs
over the borders of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SHARD_INTERVALS = 1000
DEFAULT_BITS = 32  # width of the shards of a trace that has only open intervals
RUNS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))


def _runs_of(codes: np.ndarray, g: np.ndarray, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Unites the runs of each key. Returns the keys' first positions, per-key run offsets and the runs' ends."""
    order = np.lexsort((lo, shard, g, codes))
    codes, g, shard, lo, hi = codes[order], g[order], shard[order], lo[order], hi[order]
    n = len(lo)
    fresh = np.ones(n, bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (g[1:] != g[:-1]) | (shard[1:] != shard[:-1])
    rank = np.empty(n, np.int64)
    by_hi = np.argsort(hi, kind="stable")
    rank[by_hi] = np.arange(n)
    so_far = np.maximum.accumulate(np.cumsum(fresh) * n + rank) % n  # largest end so far within the key
    before = hi[by_hi][so_far]
    start = fresh.copy()
    start[1:] |= lo[1:] > before[:-1] + 1
    first = np.flatnonzero(start)
    ends = np.maximum.reduceat(hi, first)
    keys = np.flatnonzero(fresh[first])
    return order[first[keys]], np.append(keys, len(first)), lo[first], ends


def _bitmaps(trace: pa.Array, width: np.ndarray, g: np.ndarray, shard: np.ndarray, lo: np.ndarray, hi: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    coded = trace.dictionary_encode() if not pa.types.is_dictionary(trace.type) else trace
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at, offsets, lo, hi = _runs_of(codes, g, shard, lo, hi)
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
    return pa.RecordBatch.from_arrays([trace.take(pa.array(at)), pa.array(width[at]), pa.array(g[at]), pa.array(shard[at]), runs], schema=schema)


def _schema(trace: pa.DataType) -> pa.Schema:
    runs = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    return pa.schema([("trace_id", trace), ("width", pa.int32()), ("g", pa.int64()), ("shard", pa.int64()), ("runs", runs)])


class _ToBitmaps:
    """Map side: intervals of a batch to one bitmap per (entity, shard)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            trace, g, s, e, bits = b.column(0), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            bits = bits.astype(np.int64)
            a, z = s >> bits, e >> bits
            two = np.flatnonzero(z > a)
            rows = np.concatenate([np.arange(len(g)), two])
            shard = np.concatenate([a, z[two]])
            wide = bits[rows]
            top = (shard + 1 << wide + 1) - 1
            lo = np.concatenate([2 * s, 2 * (z[two] << bits[two])])
            hi = np.minimum(np.concatenate([2 * e, 2 * e[two]]), top)
            yield _bitmaps(trace.take(pa.array(rows)), (wide + 1).astype(np.int32), g[rows], shard, lo, hi, _schema(trace.type))


class _Unite:
    """Reduce side: bitmaps sorted by key to one bitmap per key; only the last key of what was united is held back.

    The bitmap held back is united again only once as many runs again have come, so the work stays in proportion to the
    runs, however many bitmaps a key has.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, runs, enough = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            pool.append(b if not pool else b.cast(pool[0].schema))
            runs += len(b.column("runs").flatten())
            if runs >= enough:
                done, held = self.unite(pool)
                pool, runs = [held], len(held.column("runs").flatten())
                enough = 2 * runs
                if done.num_rows:
                    yield done
        if pool:
            yield from self.unite(pool)

    @staticmethod
    def unite(pool: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The united bitmaps of all keys but the last one, and that one's."""
        b = pa.Table.from_batches(pool).combine_chunks().to_batches()[0]
        runs = b.column("runs")
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        flat = runs.flatten()
        width, g, shard = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("width", "g", "shard"))
        lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
        united = _bitmaps(b.column("trace_id").take(pa.array(row)), width, g, shard, lo, hi, _schema(b.column("trace_id").type))
        last = b.slice(b.num_rows - 1)
        same = pc.and_(
            pc.and_(pc.equal(united.column("g"), last.column("g")[0]), pc.equal(united.column("shard"), last.column("shard")[0])),
            pc.is_null(united.column("trace_id")) if not last.column("trace_id")[0].is_valid else pc.fill_null(pc.equal(united.column("trace_id"), last.column("trace_id")[0]), False),
        )
        return united.filter(pc.invert(same)), united.filter(same)


def shard_widths(intervals: DataFrame, per: int = SHARD_INTERVALS) -> DataFrame:
    """``trace_id, bits``: per trace the width, in bits, of shards that hold about ``per`` of its closed intervals on average."""
    span = F.greatest(F.max("end_ts") - F.min("start_ts"), F.lit(0)) + 1
    facts = intervals.where("g is not null and start_ts <= end_ts").groupBy("trace_id").agg(F.ceil(F.count(F.lit(1)) / per).cast("bigint").alias("_shards"), span.alias("_span"))
    return facts.select("trace_id", F.greatest(F.length(F.bin("_span")) - F.length(F.bin("_shards")), F.lit(0)).alias("bits"))


def shard_bitmaps(intervals: DataFrame) -> DataFrame:
    """``trace_id, width, g, shard, runs``: the united bitmap of each entity and shard, from ``trace_id, g, start_ts, end_ts, bits``; a shard has ``2**width`` bits."""
    out = T.StructType([intervals.schema["trace_id"], T.StructField("width", T.IntegerType()), T.StructField("g", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("runs", RUNS)])
    narrow = intervals.select("trace_id", F.col("g").cast("bigint"), F.col("start_ts").cast("bigint"), F.col("end_ts").cast("bigint"), F.col("bits").cast("int"))
    keys = ("trace_id", "g", "shard")
    return narrow.mapInArrow(_ToBitmaps(), out).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_Unite(), out)


def close_ends(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """``trace_id, g, start_ts, end_ts`` with open ends closed and impossible rows left out.

    A null start is the smallest ``ts`` of the trace in ``events``, a null end the largest. Rows with null ``g`` or the end
    before the start are left out, as are open rows of traces that have no ``ts``. Only open rows meet the bounds of their
    trace, after they have been reduced: all rows of an entity that start at the trace's start unite to the one with
    the latest end, and likewise for ends.
    """
    rows = intervals.where("g is not null").select("trace_id", "g", "start_ts", "end_ts")
    whole = rows.where("start_ts <= end_ts")
    kind = F.when(F.col("start_ts").isNotNull(), 1).when(F.col("end_ts").isNotNull(), 2).otherwise(3)
    ajar = (
        rows.where("start_ts is null or end_ts is null")
        .groupBy("trace_id", "g", kind.alias("_kind"))
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    )
    bounds = events.groupBy("trace_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    closed = (
        ajar.join(bounds, ajar.trace_id.eqNullSafe(bounds.trace_id))
        .select(ajar.trace_id, "g", F.coalesce("start_ts", "_first").alias("start_ts"), F.coalesce("end_ts", "_last").alias("end_ts"))
        .where("start_ts <= end_ts")
    )
    return whole.unionByName(closed)


def _left(value: Column, bits: Column) -> Column:
    """Shift by an expression, which SQL's function form takes."""
    return F.call_function("shiftleft", value, bits)


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def periods_and_gaps(intervals: DataFrame, events: DataFrame, shard_bits: int | None = None) -> DataFrame:
    """``trace_id, g, kind, start_ts, end_ts``: the continuous periods of each entity and the gaps between them.

    Both ends belong to an interval; intervals that share an instant are one. ``kind`` is ``period`` for each longest
    continuous period and ``gap`` for each pause between neighbouring periods, from the end of the first to the start of
    the second. Open ends and rows left out: see :func:`close_ends`. Repeated rows change nothing, an empty interval
    (start = end) is a period, a null trace is an entity's trace like any other. Times must lie within +-2**61. ``shard_bits``
    sets one width of shards for all traces, by default each has its own (:func:`shard_widths`).
    """
    closed = close_ends(intervals, events)
    if shard_bits is None:
        own = shard_widths(intervals).select(F.col("trace_id").alias("_t"), F.col("bits").alias("_b"))
        closed = closed.join(own, closed.trace_id.eqNullSafe(own._t), "left").select("trace_id", "g", "start_ts", "end_ts", F.coalesce("_b", F.lit(DEFAULT_BITS)).alias("bits"))
    else:
        closed = closed.withColumn("bits", F.lit(shard_bits))
    maps = shard_bitmaps(closed)
    width, one_bit = F.col("width"), F.lit(1).cast("bigint")
    full = _left(one_bit, width) - 1
    base = _left(F.col("shard"), width)

    # upper level: runs of whole shards, one per entity and first shard
    first, last = _right(F.col("start_ts"), F.col("bits")), _right(F.col("end_ts"), F.col("bits"))
    start = _left(F.col("_from"), width)
    covers = (
        closed.select("trace_id", (F.col("bits") + 1).alias("width"), "g", (first + 1).alias("_from"), (last - 1).alias("_to"))
        .where("_from <= _to")
        .groupBy("trace_id", "width", "g", "_from")
        .agg(F.max("_to").alias("_to"))
        .select("trace_id", "width", "g", F.lit(True).alias("whole"), start.alias("pos"), F.array(F.struct(start.alias("lo"), (_left(F.col("_to"), width) + full).alias("hi"))).alias("pieces"))
    )
    one, many = F.element_at("runs", 1), F.element_at("runs", -1)
    borders = maps.select("trace_id", "width", "g", F.lit(False).alias("whole"), base.alias("pos"), F.when(F.size("runs") == 1, F.array(one)).otherwise(F.array(one, many)).alias("pieces"))
    up_to_here = Window.partitionBy("trace_id", "g").orderBy("pos", F.desc("whole")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entity = borders.unionByName(covers).withColumn("_reach", F.max(F.when(F.col("whole"), F.col("pieces")[0]["hi"])).over(up_to_here))
    covered = ~F.col("whole") & F.coalesce(F.col("_reach") >= F.col("pos") + full, F.lit(False))

    # entity level: join the border runs and the runs of whole shards
    pieces = entity.where(~covered).select("trace_id", "width", "g", F.explode("pieces").alias("run")).select("trace_id", "width", "g", "run.lo", "run.hi")
    by_start = Window.partitionBy("trace_id", "g").orderBy("lo", "hi")
    before = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    joined = (
        pieces.withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("trace_id", "g", "width", "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    follow = F.lead("lo").over(Window.partitionBy("trace_id", "g").orderBy("lo"))
    own = F.array(F.struct(F.lit("period").alias("kind"), F.col("lo"), F.col("hi")))
    pause = F.array(F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("lo"), F.col("_next").alias("hi")))
    apart = F.col("_next").isNotNull() & (_right(F.col("_next"), width) != _right(F.col("hi"), width))
    outer = joined.withColumn("_next", follow).select("trace_id", "g", F.explode(F.when(apart, F.concat(own, pause)).otherwise(own)).alias("x"))

    # inside a shard: all gaps, and the periods between the first and the last run
    hidden = entity.where(covered).select(F.col("trace_id").alias("_t"), F.col("g").alias("_g"), _right(F.col("pos"), width).alias("_s"))
    inner = maps.where(F.size("runs") > 1)
    inner = inner.join(hidden, inner.trace_id.eqNullSafe(hidden._t) & (inner.g == hidden._g) & (inner.shard == hidden._s), "left_anti")
    n = F.size("runs")
    gaps = F.transform(F.arrays_zip(F.slice("runs", F.lit(1), n - 1).alias("a"), F.slice("runs", F.lit(2), n - 1).alias("b")), lambda x: F.struct(F.lit("gap").alias("kind"), x["a"]["hi"].alias("lo"), x["b"]["lo"].alias("hi")))
    mid = F.transform(F.slice("runs", F.lit(2), n - 2), lambda x: F.struct(F.lit("period").alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    inside = inner.select("trace_id", "g", F.explode(F.concat(gaps, mid)).alias("x"))
    return outer.unionByName(inside).select("trace_id", "g", "x.kind", F.shiftright("x.lo", 1).alias("start_ts"), F.shiftright("x.hi", 1).alias("end_ts"))
