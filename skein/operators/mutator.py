"""Mutator utilisation: which share of the processors is left to the program, as a step function of time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from skein.functions.catalog import ID, STARTS, STOPS
from skein.functions.stepfn import as_of
from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, running, sum_over

TOLERANCE = 1e-5
_ORDER = ["ord", "rec_offset"]


def contributions(ev: DataFrame, background: bool = True, assist: bool = True, sweep: bool = True, per_proc: bool = False) -> DataFrame:
    """``trace_id, ord, rec_offset, ts, p, d``: where collector work on a processor begins (+1) and ends (-1).

    Sweeps count on the processor of their events. A mark assist counts while its goroutine runs. Background workers
    are goroutines started with a label ``GC ...`` except ``GC (idle)`` and, per processor, ``GC (dedicated)``.
    """
    parts = []
    if sweep:
        kind = F.when(F.col("type_id") == ID["GcSweepStart"], 1).when(F.col("type_id") == ID["GcSweepDone"], -1)
        parts.append(ev.withColumn("d", kind))
    going = None
    if assist or background:
        types = [*STARTS, *STOPS, ID["GcMarkAssistStart"], ID["GcMarkAssistDone"]]
        going = durable(ev.where(F.col("type_id").isin(*types) & F.col("g").isNotNull()).select("trace_id", "g", "ord", "rec_offset", "type_id", "ts", "p", "string_args"))
        begins = F.col("type_id").isin(*STARTS)
        over = F.col("type_id").isin(*STOPS)
        step = F.when(F.col("type_id") == ID["GcMarkAssistStart"], 1).when(F.col("type_id") == ID["GcMarkAssistDone"], -1)
        run = F.when(begins, F.struct(F.lit(True).alias("on"), "p", F.try_element_at("string_args", F.lit(1)).alias("label"), "type_id")).when(over, F.struct(F.lit(False).alias("on"), "p", F.lit(None).cast("string").alias("label"), "type_id"))
        going = running(going, ["trace_id", "g"], _ORDER, {"_run": ("before", run), "_depth": ("sum", step)}, EVENT_BITS)
        going = going.withColumn("_depth", F.col("_depth") - F.coalesce(step, F.lit(0)))
    if assist:
        d = step
        d = F.when(begins & (F.col("_depth") > 0), 1).when(over & (F.col("_depth") > 0) & F.col("_run.on"), -1).otherwise(d)
        at = F.when(over, F.col("_run.p")).otherwise(F.col("p"))
        parts.append(going.withColumn("d", d).withColumn("p", at))
    if background:
        idle = ["GC (idle)", "GC (dedicated)"] if per_proc else ["GC (idle)"]
        label = F.try_element_at("string_args", F.lit(1))
        works = lambda c: c.startswith("GC ") & ~c.isin(*idle)
        d = F.when((F.col("type_id") == ID["GoStartLabel"]) & works(label), 1).when(over & F.col("_run.on") & (F.col("_run.type_id") == ID["GoStartLabel"]) & works(F.col("_run.label")), -1)
        parts.append(going.withColumn("d", d).withColumn("p", F.when(over, F.col("_run.p")).otherwise(F.col("p"))))
    cols = ["trace_id", "ord", "rec_offset", "ts", F.col("p").cast("int").alias("p"), F.col("d").cast("int").alias("d")]
    if not parts:
        return ev.where("false").select(*cols[:-1], F.lit(0).alias("d"))
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out.where("d is not null and p is not null").groupBy("trace_id", "ord", "rec_offset", "ts", "p").agg(F.sum("d").cast("int").alias("d"))


def _busy(ev: DataFrame, deltas: DataFrame) -> DataFrame:
    """``trace_id, p, ord, rec_offset, ts, busy, change``: whether a processor does collector work after each event, and the change.

    When the number of processors falls, what the dropped ones were doing is forgotten.
    """
    procs = ev.where(F.col("type_id") == ID["Gomaxprocs"]).select("trace_id", "ord", "rec_offset", "ts", F.col("a0").alias("_n"))
    cut = procs.withColumn("_was", F.lag("_n").over(Window.partitionBy("trace_id").orderBy(*_ORDER))).where("_n < _was")
    lost = cut.select("trace_id", "ord", "rec_offset", "ts", F.explode(F.sequence(F.col("_n").cast("int"), (F.col("_was") - 1).cast("int"))).alias("p"), F.lit(0).alias("d"), F.lit(1).alias("_reset"))
    every = durable(deltas.withColumn("_reset", F.lit(0)).unionByName(lost))
    keys, cleared = ["trace_id", "p"], F.when(F.col("_reset") == 1, F.col("_sum"))
    summed = sum_over(every, keys, _ORDER, F.col("d"), "_sum", bits=EVENT_BITS)
    # what a processor did before its last reset does not count, for the row itself and for the one before it
    count = running(summed, keys, _ORDER, {"_base": ("last", cleared), "_old": ("before", cleared)}, EVENT_BITS)
    busy = lambda total, base: (total - F.coalesce(base, F.lit(0)) > 0).cast("int")
    count = count.withColumn("busy", busy(F.col("_sum"), "_base"))
    return count.withColumn("change", F.col("busy") - busy(F.col("_sum") - F.col("d"), "_old")).select("trace_id", "p", "ord", "rec_offset", "ts", "busy", "change")


def _trace_state(ev: DataFrame, stw: bool) -> DataFrame:
    """Per event that matters to the whole trace: change of the stop-the-world depth and the number of processors."""
    kind = F.col("type_id")
    d = F.when(kind == ID["GcStwStart"], 1).when(kind == ID["GcStwDone"], -1).otherwise(0) if stw else F.lit(0)
    types = [ID["Gomaxprocs"], *([ID["GcStwStart"], ID["GcStwDone"]] if stw else [])]
    return ev.where(kind.isin(*types)).select("trace_id", "ord", "rec_offset", "ts", d.alias("stw"), F.when(kind == ID["Gomaxprocs"], F.col("a0")).alias("procs"))


def raw_utilisation(ev: DataFrame, stw: bool = True, background: bool = True, assist: bool = True, sweep: bool = True) -> DataFrame:
    """``trace_id, ord, rec_offset, time, util``: the utilisation after each event that may change it, all processors together.

    ``util`` is 1 - busy / n, and 0 while the world is stopped. Nothing is known before the first Gomaxprocs; a last point of 0
    marks the end of the trace.
    """
    busy = _busy(ev, contributions(ev, background, assist, sweep)).groupBy("trace_id", "ord", "rec_offset", "ts").agg(F.sum("change").alias("change"))
    state = _trace_state(ev, stw)
    none = F.lit(None)
    merged = busy.select("trace_id", "ord", "rec_offset", "ts", "change", F.lit(0).alias("stw"), none.cast("bigint").alias("procs")).unionByName(state.withColumn("change", F.lit(0).cast("bigint")).select("trace_id", "ord", "rec_offset", "ts", "change", "stw", "procs"))
    merged = merged.groupBy("trace_id", "ord", "rec_offset", "ts").agg(F.sum("change").alias("change"), F.sum("stw").alias("stw"), F.max("procs").alias("procs"))
    run = running(durable(merged), ["trace_id"], _ORDER, {"busy": ("sum", F.col("change")), "stopped": ("sum", F.col("stw")), "n": ("last", F.col("procs"))}, EVENT_BITS).where("n > 0")
    util = 1.0 - F.when(F.col("stopped") > 0, F.col("n")).otherwise(F.col("busy")) / F.col("n")
    points = run.select("trace_id", "ord", "rec_offset", F.col("ts").alias("time"), util.alias("util"))
    return points.unionByName(_end_marks(ev, points))


def _end_marks(ev: DataFrame, points: DataFrame) -> DataFrame:
    last = ev.groupBy("trace_id").agg(F.max_by(F.struct("ts"), F.struct(*_ORDER)).alias("_e"), F.max("ord").alias("_o"))
    return last.join(points.select("trace_id").distinct(), "trace_id").select("trace_id", (F.col("_o") + 1).alias("ord"), F.lit(0).cast("bigint").alias("rec_offset"), F.col("_e.ts").alias("time"), F.lit(0.0).alias("util"))


def raw_utilisation_per_proc(ev: DataFrame, stw: bool = True, background: bool = True, assist: bool = True, sweep: bool = True) -> DataFrame:
    """``trace_id, series, ord, rec_offset, time, util``: the same for each processor: 0 while it does collector work or the world is stopped.

    A processor's series begins with 1 when Gomaxprocs adds it and ends with 0 when it is dropped or the trace ends.
    """
    busy = _busy(ev, contributions(ev, background, assist, sweep, per_proc=True))
    state = _trace_state(ev, stw)
    n = state.where("procs is not null").select("trace_id", "ord", "rec_offset", "ts", "procs", F.coalesce(F.lag("procs").over(Window.partitionBy("trace_id").orderBy(*_ORDER)), F.lit(0)).alias("_was"))
    added = n.where("procs > _was").select("trace_id", F.explode(F.sequence(F.col("_was").cast("int"), (F.col("procs") - 1).cast("int"))).alias("p"), "ord", "rec_offset", F.col("ts").alias("time"), F.lit(1.0).alias("util"))
    dropped = n.where("procs < _was").select("trace_id", F.explode(F.sequence(F.col("procs").cast("int"), (F.col("_was") - 1).cast("int"))).alias("p"), "ord", "rec_offset", F.col("ts").alias("time"), F.lit(0.0).alias("util"))
    lives = added.select("trace_id", "p", F.col("ord").alias("_from")).unionByName(dropped.select("trace_id", "p", F.col("ord").alias("_from"))).groupBy("trace_id", "p").agg(F.min("_from").alias("_from"))
    stopped = sum_over(state.where("stw <> 0"), ["trace_id"], _ORDER, F.col("stw"), "stopped") if stw else state.where("false").withColumn("stopped", F.lit(0))
    spread = stopped.select("trace_id", "ord", "rec_offset", "ts", "stopped").join(lives.select("trace_id", "p", "_from"), "trace_id").where("ord > _from")
    rows = busy.select("trace_id", "p", "ord", "rec_offset", "ts", F.col("busy"), F.lit(None).cast("bigint").alias("stopped")).unionByName(spread.select("trace_id", "p", "ord", "rec_offset", "ts", F.lit(None).cast("int").alias("busy"), F.col("stopped").cast("bigint")))
    rows = running(durable(rows), ["trace_id", "p"], _ORDER, {"_b": ("last", F.col("busy")), "_s": ("last", F.col("stopped"))}, EVENT_BITS)
    procs = as_of(n, rows, ["trace_id"], "ord", F.col("procs"), "_n", bits=EVENT_BITS).where("p < _n")
    util = F.when((F.coalesce("_b", F.lit(0)) > 0) | (F.coalesce("_s", F.lit(0)) > 0), 0.0).otherwise(1.0)
    points = procs.select("trace_id", "p", "ord", "rec_offset", F.col("ts").alias("time"), util.alias("util")).unionByName(added).unionByName(dropped)
    last = n.groupBy("trace_id").agg(F.max_by("procs", F.struct(*_ORDER)).alias("_n"))
    ends = _end_marks(ev, points).join(last, "trace_id").where("_n > 0").select("trace_id", F.explode(F.sequence(F.lit(0).cast("int"), (F.col("_n") - 1).cast("int"))).alias("p"), "ord", "rec_offset", "time", "util")
    return points.unionByName(ends).withColumnRenamed("p", "series")


class _Compress:
    """Streams sorted points and keeps those that change the series, in constant memory."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        for b in batches:
            out = []
            for trace, series, time, util in zip(*(b.column(c).to_pylist() for c in ("trace_id", "series", "time", "util"))):
                if (trace, series) != key:
                    if last is not None:
                        out.append((*key, *last))
                    key, last = (trace, series), (time, util)
                elif abs(last[1] - util) < TOLERANCE:
                    continue
                elif last[0] == time:
                    last = (time, min(last[1], util))
                else:
                    out.append((*key, *last))
                    last = (time, util)
            yield self.batch(out)
        if last is not None:
            yield self.batch([(*key, *last)])

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["trace_id", "series", "time", "util"])


def compressed(points: DataFrame) -> DataFrame:
    """``trace_id, series, time, util`` without points that change nothing.

    A point that differs from the last one kept by less than 1e-5 is skipped; of points at the same time the lower one
    stays. Points are taken in the order of events. A trace is one stream in one task, in constant memory: only events
    that concern the collector are in it.
    """
    out = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("series", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("util", T.DoubleType())])
    rows = points if "series" in points.columns else points.withColumn("series", F.lit(0))
    return rows.repartition("trace_id", "series").sortWithinPartitions("trace_id", "series", *_ORDER).select("trace_id", F.col("series").cast("int").alias("series"), "time", "util").mapInArrow(_Compress(), out)


def mutator_utilisation(ev: DataFrame, stw: bool = False, background: bool = False, assist: bool = False, sweep: bool = False, per_proc: bool = False) -> DataFrame:
    """``trace_id, series, time, util``: the utilisation series; without a flag for a contribution all four count."""
    if not (stw or background or assist or sweep):
        stw = background = assist = sweep = True
    raw = raw_utilisation_per_proc if per_proc else raw_utilisation
    return compressed(raw(ev, stw, background, assist, sweep))
