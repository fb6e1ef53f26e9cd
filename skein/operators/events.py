"""The event table as the other operators want it, and dictionary joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions.catalog import GC_P, SYSCALL_P, TIMER_P, ID
from skein.functions.scalars import rescaled

COLUMNS = ("trace_id", "rec_offset", "ord", "type_id", "ts", "p", "g", "a0", "a1", "a2", "string_args", "stack_id")


def clean(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per event (trace_id, rec_offset) that has an order, a type and a time; repeated rows are the same event."""
    kept = events.select(*COLUMNS, *extra).where("trace_id is not null and rec_offset is not null and ord is not null and type_id is not null and ts is not null")
    return kept.dropDuplicates(["trace_id", "rec_offset"])


def world(ev: DataFrame) -> DataFrame:
    """``trace_id, world_start, world_end``: first and last time of each trace."""
    return ev.groupBy("trace_id").agg(F.min("ts").alias("world_start"), F.max("ts").alias("world_end"))


def with_catalog(ev: DataFrame, event_types: DataFrame) -> DataFrame:
    """``ev`` with the catalogue's name, first version and stack flag of its type; the catalogue is a fixed small table."""
    named = event_types.select("type_id", F.col("type").alias("type_name"), "min_version", "has_stack")
    return ev.join(F.broadcast(named), "type_id", "left")


def latest(dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """``trace_id, key, value``: of several rows of a key the value of the newest one that is not deleted."""
    alive = dictionary.where("deleted_at is null") if "deleted_at" in dictionary.columns else dictionary
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at") if "loaded_at" in dictionary.columns else F.lit(0)
    return alive.groupBy("trace_id", key).agg(F.max_by(value, order).alias(value))


def with_stacks(ev: DataFrame, stacks: DataFrame) -> DataFrame:
    """``ev`` with ``frames`` of its stack id; 0 and unknown ids have none."""
    known = latest(stacks, "stack_id", "frames").where("stack_id <> 0")
    return ev.join(known, ["trace_id", "stack_id"], "left")


def resolved_frames(stacks: DataFrame, strings: DataFrame) -> DataFrame:
    """Frames whose function and file are string ids (``fn_id, file_id``) with their texts: ``trace_id, stack_id, frames``.

    Unknown ids stay null.
    """
    names = latest(strings, "string_id", "val")
    fn = names.select("trace_id", F.col("string_id").alias("_fn"), F.col("val").alias("fn"))
    file = names.select("trace_id", F.col("string_id").alias("_file"), F.col("val").alias("file"))
    flat = stacks.select("trace_id", "stack_id", F.posexplode_outer("frames").alias("_i", "_x")).select("trace_id", "stack_id", "_i", F.col("_x.pc").alias("pc"), F.col("_x.fn_id").alias("_fn"), F.col("_x.file_id").alias("_file"), F.col("_x.line").alias("line"))
    named = flat.join(fn, ["trace_id", "_fn"], "left").join(file, ["trace_id", "_file"], "left")
    frame = F.struct("_i", "pc", "fn", "file", "line")
    got = named.groupBy("trace_id", "stack_id").agg(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), frame))).alias("_f"))
    return got.select("trace_id", "stack_id", F.transform("_f", lambda f: F.struct(f["pc"].alias("pc"), f["fn"].alias("fn"), f["file"].alias("file"), f["line"].cast("int").alias("line"))).alias("frames"))


def with_world_time(ev: DataFrame, meta: DataFrame) -> DataFrame:
    """``ev`` with ``ns``: its ``ts`` taken as ticks, in nanoseconds since the first event; null without a positive frequency."""
    freq = meta.where("frequency > 0").groupBy("trace_id").agg(F.max("frequency").alias("frequency"))
    first = ev.groupBy("trace_id").agg(F.min("ts").alias("_first")).join(freq, "trace_id")
    return ev.join(first, "trace_id", "left").withColumn("ns", rescaled(F.col("ts"), F.col("_first"), F.col("frequency"))).drop("_first", "frequency")


def with_pseudo_processors(ev: DataFrame, meta: DataFrame) -> DataFrame:
    """``ev`` with ``pseudo_p``: the processor, or the pseudo-processor of timers, system calls or the collector.

    A GoUnblock by a timer goroutine belongs to the timers, a GoSysExit to system calls, a GcStart to the collector.
    """
    timers = meta.select("trace_id", F.explode("timers").alias("g")).where("g is not null").distinct().withColumn("_timer", F.lit(True))
    kind = F.when((F.col("type_id") == ID["GoUnblock"]) & F.col("_timer"), TIMER_P).when(F.col("type_id") == ID["GoSysExit"], SYSCALL_P).when(F.col("type_id") == ID["GcStart"], GC_P)
    return ev.join(timers, ["trace_id", "g"], "left").withColumn("pseudo_p", F.coalesce(kind, F.col("p"))).drop("_timer")
