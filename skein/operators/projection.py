"""From raw records of trace files to events and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions.catalog import ENDS, ID, STARTS, TYPES, YIELDS
from skein.functions.windows import EVENT_BITS, OFFSET_BITS, last_over, sum_over
from skein.operators.linking import BLOCKS
from skein.operators.ordering import renamed

_META = [ID[x] for x in ("Batch", "Frequency", "Stack", "TimerGoroutine", "String")]
_CLEARS = sorted([*ENDS, *YIELDS, *BLOCKS, ID["GoSysBlock"]])
# The reasons for stopping the world, by number.
STW_KINDS = {0: "mark termination", 1: "sweep termination"}


def strings(raw: DataFrame) -> DataFrame:
    """``trace_id, string_id, val``: the string dictionary."""
    return raw.where(F.col("type_id") == ID["String"]).select("trace_id", F.col("args")[0].alias("string_id"), F.col("str_arg").alias("val"))


def stacks(raw: DataFrame) -> DataFrame:
    """``trace_id, stack_id, frames``: of several records of a stack the last one; function and file as string ids.

    Before version 1007 a frame is only its pc.
    """
    rows = raw.where(F.col("type_id") == ID["Stack"])
    i = F.sequence(F.lit(0), F.col("args")[1].cast("int") - 1)
    none = F.lit(None).cast("bigint")
    arg = lambda k: F.try_element_at("args", k.cast("int"))
    new = F.transform(i, lambda k: F.struct(arg(3 + 4 * k).alias("pc"), arg(4 + 4 * k).alias("fn_id"), arg(5 + 4 * k).alias("file_id"), arg(6 + 4 * k).alias("line")))
    old = F.transform(i, lambda k: F.struct(arg(3 + k).alias("pc"), none.alias("fn_id"), none.alias("file_id"), none.alias("line")))
    empty = F.array().cast("array<struct<pc:bigint,fn_id:bigint,file_id:bigint,line:bigint>>")
    frames = F.when(F.col("args")[1] == 0, empty).when(F.col("version") < 1007, old).otherwise(new)
    return rows.groupBy("trace_id", F.col("args")[0].alias("stack_id")).agg(F.max_by(frames, "rec_offset").alias("frames"))


def meta(raw: DataFrame) -> DataFrame:
    """``trace_id, version, frequency, timers``: one row per trace; the last frequency counts, null where there is none."""
    kind = F.col("type_id")
    freq, timer = kind == ID["Frequency"], kind == ID["TimerGoroutine"]
    return raw.where("version is not null").groupBy("trace_id").agg(F.max("version").alias("version"), F.max_by(F.when(freq, F.col("args")[0]), F.when(freq, F.col("rec_offset"))).alias("frequency"), F.array_sort(F.collect_set(F.when(timer, F.col("args")[0]))).alias("timers"))


def running_goroutine(ev: DataFrame, order: list[str], name: str) -> DataFrame:
    """``ev`` with ``name``: the goroutine an event belongs to, 0 for none, carried along each processor in ``order``.

    A start sets it, a stop or block clears it for what follows; some events name theirs, those of the collector have none.
    """
    kind = F.col("type_id")
    begins = kind.isin(*STARTS)
    named = kind.isin(ID["GoSysExit"], ID["GoWaiting"], ID["GoInSyscall"])
    world = kind.isin(ID["GcStart"], ID["GcDone"], ID["GcStwStart"], ID["GcStwDone"])
    ev = last_over(ev, ["trace_id", "p"], order, F.when(begins, F.col("a0")).when(kind.isin(*_CLEARS), F.lit(0)), "_run", bits=EVENT_BITS if order[0] == "ord" else OFFSET_BITS)
    return ev.withColumn(name, F.when(begins | named, F.col("a0")).when(world, 0).otherwise(F.coalesce("_run", F.lit(0)))).drop("_run")


def project(raw: DataFrame) -> DataFrame:
    """Events in file order with their processor, time in ticks, goroutine and arguments.

    Columns: ``trace_id, version, rec_offset, raw_type_id, type_id, ts, seq, p, g, a0, a1, a2, string_args, stack_id``. A batch sets the processor
    and the base of time (and sequence before version 1007) for the differences that follow. The goroutine that runs on a
    processor is carried on from start to stop, over batches. String ids that are unknown give null.
    """
    batch = F.col("type_id") == ID["Batch"]
    rows = raw.where("type_id is not null").where(batch | ~F.col("type_id").isin(*_META))
    rows = sum_over(rows, ["trace_id"], ["rec_offset"], batch.cast("int"), "_batch", bits=OFFSET_BITS)
    old = F.col("version") < 1007
    heads = rows.where(batch).select("trace_id", "_batch", F.col("args")[0].cast("int").alias("p"), F.when(old, F.try_element_at("args", F.lit(3))).otherwise(F.col("args")[1]).alias("_ts"), F.when(old, F.col("args")[1]).alias("_seq"))
    ev = rows.where(~batch)
    first = F.when(old, 2).otherwise(1)  # arguments before an event's own: differences of sequence and time
    ev = ev.withColumn("_dt", F.try_element_at("args", first)).withColumn("_ds", F.when(old, F.col("args")[0]).otherwise(0))
    ev = sum_over(ev, ["trace_id", "_batch"], ["rec_offset"], F.col("_dt"), "_st")
    ev = sum_over(ev, ["trace_id", "_batch"], ["rec_offset"], F.col("_ds"), "_ss")
    ev = ev.join(heads, ["trace_id", "_batch"], "left")
    ev = ev.withColumn("p", F.coalesce("p", F.lit(0))).withColumn("ts", F.coalesce("_ts", F.lit(0)) + F.col("_st")).withColumn("seq", F.when(old, F.coalesce("_seq", F.lit(0)) + F.col("_ss")))
    stacked = F.col("type_id").isin(*(i for i, _, _, stack, *_ in TYPES if stack))
    own = F.slice("args", first + 1, F.greatest(F.size("args") - first - stacked.cast("int"), F.lit(0)))
    ev = ev.withColumn("_own", own).withColumn("stack_id", F.when(stacked, F.element_at("args", -1)).otherwise(0))
    for i in range(3):
        ev = ev.withColumn(f"a{i}", F.coalesce(F.try_element_at("_own", F.lit(i + 1)), F.lit(0)))
    ev = renamed(ev.withColumnRenamed("type_id", "raw_type_id"))
    kind = F.col("type_id")
    ev = running_goroutine(ev, ["rec_offset"], "g")
    key = F.when(kind == ID["UserLog"], F.col("a1")).when(kind.isin(ID["GoStartLabel"], ID["UserTaskCreate"], ID["UserRegion"]), F.col("a2"))
    words = strings(raw).select("trace_id", F.col("string_id").alias("_key"), F.col("val").alias("_word"))
    ev = ev.withColumn("_key", key).join(words, ["trace_id", "_key"], "left")
    stw = F.when(F.col("a0") == 0, STW_KINDS[0]).when(F.col("a0") == 1, STW_KINDS[1])
    texts = F.when(kind == ID["UserLog"], F.array("_word", "str_arg")).when(kind == ID["GcStwStart"], F.array(stw)).when(F.col("_key").isNotNull(), F.array("_word"))
    return ev.withColumn("string_args", texts).select("trace_id", "version", "rec_offset", "raw_type_id", "type_id", "ts", "seq", "p", "g", "a0", "a1", "a2", "string_args", "stack_id")


def record_violations(raw: DataFrame, events: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: corrupt files, traces without frequency or events, unknown strings and kinds."""
    broken = raw.where("corrupt_reason is not null").select("trace_id", "rec_offset", F.lit("format").alias("rule_id"), F.col("corrupt_reason").alias("message"))
    facts = meta(raw)
    none = F.lit(None).cast("bigint").alias("rec_offset")
    mute = facts.where("frequency is null").select("trace_id", none, F.lit("frequency").alias("rule_id"), F.lit("no frequency event").alias("message"))
    empty = facts.join(events.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", none, F.lit("empty").alias("rule_id"), F.lit("trace is empty").alias("message"))
    lost = events.where((F.col("type_id") == ID["GcStwStart"]) & ~F.col("a0").isin(0, 1)).select("trace_id", "rec_offset", F.lit("stw kind").alias("rule_id"), F.lit("unknown kind of stop").alias("message"))
    word = events.where(F.col("type_id").isin(ID["GoStartLabel"], ID["UserTaskCreate"], ID["UserRegion"], ID["UserLog"]) & F.try_element_at("string_args", F.lit(1)).isNull()).select("trace_id", "rec_offset", F.lit("string id").alias("rule_id"), F.lit("unknown string id").alias("message"))
    mode = events.where((F.col("type_id") == ID["UserRegion"]) & ~F.col("a1").isin(0, 1)).select("trace_id", "rec_offset", F.lit("region mode").alias("rule_id"), F.lit("bad region mode").alias("message"))
    return broken.unionByName(mute).unionByName(empty).unionByName(lost).unionByName(word).unionByName(mode)
