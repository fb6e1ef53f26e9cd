"""What a user calls: read traces, then derive goroutines, tasks and utilisation from their events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions.catalog import ID, NAME, NETPOLL_P
from skein.functions.tables import durable
from skein.operators import events as E, futile, goroutines as G, linking, mmu as M, mutator, ordering, projection, tasks as K
from skein.sources import trace_file


@dataclass
class Trace:
    """The tables of one or many traces."""

    events: DataFrame
    strings: DataFrame
    stacks: DataFrame
    meta: DataFrame
    violations: DataFrame


def read_trace(spark: SparkSession, path: str, mode: str = "FAILFAST", strict: bool = False, sequences: bool = False) -> Trace:
    """Reads, orders, checks and links the traces at ``path``.

    ``events`` has the columns of the event table: ``trace_id, rec_offset, ord, type, type_id, raw_type_id, ts, seq, p, g, a0, a1, a2, string_args, stack_id,
    link_offset, link_ts, link_g``. Times are nanoseconds since the first event. Violations of the format and of the states are
    rows of ``violations``; with ``strict`` the first one is raised instead. Broken sequence
    numbers are among them with ``strict`` or ``sequences``.
    """
    raw = durable(trace_file.read_raw(spark, path, mode))
    meta = projection.meta(raw)
    projected = projection.project(raw)
    strings = projection.strings(raw)
    stacks = E.resolved_frames(projection.stacks(raw), strings)
    ordered = durable(ordering.ordered(projected))
    early = ordering.order_violations(projected.withColumn("ord", F.col("rec_offset")), ("trace_id", "p"), ("rec_offset",))
    timed = E.with_world_time(ordered, meta).withColumn("ts", F.coalesce("ns", "ts")).drop("ns")
    timed = E.with_pseudo_processors(timed, meta).withColumn("p", F.col("pseudo_p")).drop("pseudo_p")
    kept = durable(futile.without_futile(timed))
    polled = linking.netpoll_unblocks(kept).withColumn("_polled", F.lit(True))
    kept = durable(kept.join(polled, ["trace_id", "rec_offset"], "left").withColumn("p", F.when(F.col("_polled"), NETPOLL_P).otherwise(F.col("p"))).drop("_polled"))
    linked = linking.links(kept, meta)
    starts = linked.groupBy("trace_id", "rec_offset").agg(F.min("link_offset").alias("link_offset"), F.min_by("link_ts", "link_offset").alias("link_ts"), F.min_by("link_g", "link_offset").alias("link_g"))
    closes = G.user_regions(kept).where("start_offset is not null and end_offset is not null").select("trace_id", F.col("start_offset").alias("rec_offset"), F.col("end_offset").alias("_ro"), F.col("end_ts").alias("_rt"), F.col("g").alias("_rg"))
    ev = kept.join(starts, ["trace_id", "rec_offset"], "left").join(closes, ["trace_id", "rec_offset"], "left")
    ev = ev.withColumn("link_offset", F.coalesce("link_offset", "_ro")).withColumn("link_ts", F.coalesce("link_ts", "_rt")).withColumn("link_g", F.coalesce("link_g", "_rg"))
    # a goroutine's first start shows the stack it was created with
    first = kept.where(F.col("type_id").isin(ID["GoStart"], ID["GoStartLabel"])).groupBy("trace_id", "g").agg(F.min_by("rec_offset", F.struct("ord", "rec_offset")).alias("rec_offset"))
    made = kept.where(F.col("type_id") == ID["GoCreate"]).groupBy("trace_id", F.col("a0").alias("g")).agg(F.min_by("a1", F.struct("ord", "rec_offset")).alias("_stack"))
    ev = ev.join(first.join(made, ["trace_id", "g"]).drop("g"), ["trace_id", "rec_offset"], "left").withColumn("stack_id", F.coalesce("_stack", "stack_id"))
    names = F.create_map(*(F.lit(x) for pair in NAME.items() for x in pair))
    ev = ev.withColumn("type", F.try_element_at(names, F.col("type_id")))
    ev = durable(ev.select("trace_id", "rec_offset", "ord", "type", "type_id", "raw_type_id", "ts", "seq", "p", "g", "a0", "a1", "a2", "string_args", "stack_id", "link_offset", "link_ts", "link_g"))
    bad = projection.record_violations(raw, projected).unionByName(early).unionByName(ordering.order_violations(ordered)).unionByName(linking.state_violations(kept)).unionByName(linking.bracket_violations(kept, meta)).unionByName(linking.processor_violations(kept)).unionByName(linking.region_violations(kept))
    exits = ordering.exit_repair(ordered).where("rule_id is not null").select("trace_id", "rec_offset", "rule_id", F.lit("system call exit").alias("message"))
    bad = bad.unionByName(exits)
    if strict or sequences:
        bad = bad.unionByName(ordering.sequence_violations(ordered)).unionByName(ordering.tie_violations(projected))
    if strict:
        one = bad.orderBy("trace_id", F.col("rec_offset").asc_nulls_first()).first()
        if one is not None:
            kind = trace_file.EmptyTrace if one.rule_id == "empty" else trace_file.InvalidTrace
            raise kind(f"{one.trace_id}: {one.rule_id}: {one.message} (offset {one.rec_offset})")
    return Trace(ev, strings, stacks, meta, bad)


def goroutines(trace: Trace, compat: bool = False) -> DataFrame:
    """One row per goroutine with its times."""
    return G.goroutines(trace.events, trace.stacks, compat)


def regions(trace: Trace) -> DataFrame:
    """User regions with the times spent in them."""
    return G.region_stats(trace.events)


def tasks(trace: Trace) -> DataFrame:
    """One row per user task."""
    return K.tasks(trace.events, G.regions(trace.events))


def descendants(tasks: DataFrame) -> DataFrame:
    """Each task with all its descendants."""
    return K.all_descendants(tasks)


def related_goroutines(trace: Trace, tasks: DataFrame, depth: int) -> DataFrame:
    """Goroutines of each task and those that woke them, ``depth`` levels deep."""
    return K.related_goroutines(trace.events, tasks, depth)


def overlapping_instants(trace: Trace, tasks: DataFrame) -> DataFrame:
    """Events that happen during a task."""
    return K.overlapping_instants(trace.events, tasks, G.regions(trace.events))


def overlapping_durations(trace: Trace, tasks: DataFrame) -> DataFrame:
    """For how long linked events overlap with a task."""
    own = trace.events.where("link_ts is not null").select("trace_id", "rec_offset", "link_ts", "link_g")
    return K.overlapping_durations(trace.events.drop("link_ts", "link_g"), tasks, G.regions(trace.events), own)


def mutator_util(trace: Trace, stw: bool = False, background: bool = False, assist: bool = False, sweep: bool = False, per_proc: bool = False) -> DataFrame:
    """The mutator utilisation as a step function; without flags all contributions count."""
    return mutator.mutator_utilisation(trace.events, stw, background, assist, sweep, per_proc)


def mmu(series: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Minimum utilisation of windows of the given lengths."""
    return M.mmu(series, windows)


def worst_windows(series: DataFrame, window: int, n: int) -> DataFrame:
    """The ``n`` worst windows that do not overlap."""
    return M.worst_windows(series, window, n)


def mud(series: DataFrame, window: int, quantiles: Sequence[float], compat: bool = False) -> DataFrame:
    """Quantiles of the windowed utilisation."""
    return M.mud(series, window, quantiles, compat)
