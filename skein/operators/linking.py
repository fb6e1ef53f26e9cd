"""Links from events to the events that close them, and checks of the states they imply.

Every state after an event follows from the event's type alone, so "the event before on the same subject" is all that a
link or a check has to see: one lead or lag per subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.catalog import ENDS, ID, SILENT_BLOCKS, STARTS, STOPS, SYNC_BLOCKS, TIMER_P, YIELDS
from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, last_over, lead_over
from skein.operators.brackets import match

BLOCKS = sorted([*SYNC_BLOCKS, *SILENT_BLOCKS, ID["GoBlockNet"]])
_BY_ARGUMENT = [ID["GoCreate"], ID["GoUnblock"]]


def subject(type_id: Column, g: Column, a0: Column) -> Column:
    """The goroutine an event acts on: its first argument for creation and unblocking, else its own."""
    return F.when(type_id.isin(*_BY_ARGUMENT), a0).otherwise(g)


def _pairs(ev: DataFrame, kind: str, keys: list[str], types: list[int], allowed: list[tuple[list[int], list[int]]]) -> DataFrame:
    """Links of one kind: an event to the next one of the same keys among ``types``, where the pair of types is allowed."""
    some = ev.where(F.col("type_id").isin(*types))
    some = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, some)
    # a goroutine or processor may have a large share of all events; cycles and stops of the world are few
    bits = None if kind in ("gc", "stw") else EVENT_BITS
    nxt = lead_over(some, keys, ["ord", "rec_offset"], F.struct("type_id", "rec_offset", "ts", "g"), "_next", bits=bits)
    fits = reduce(lambda c, ab: c | (F.col("type_id").isin(*ab[0]) & F.col("_next.type_id").isin(*ab[1])), allowed, F.lit(False))
    return nxt.where(fits).select("trace_id", "rec_offset", F.lit(kind).alias("kind"), F.col("_next.rec_offset").alias("link_offset"), F.col("_next.ts").alias("link_ts"), F.col("_next.g").alias("link_g"))


def _world_stops(ev: DataFrame, meta: DataFrame) -> DataFrame:
    """Stops of the world with ``_at``: their processor before version 1010, -1 in later traces."""
    old = meta.groupBy("trace_id").agg(F.max("version").alias("_version"))
    stopped = ev.where(F.col("type_id").isin(ID["GcStwStart"], ID["GcStwDone"])).join(old, "trace_id", "left")
    return stopped.withColumn("_at", F.when(F.col("_version") < 1010, F.col("p")).otherwise(F.lit(-1)))


def links(ev: DataFrame, meta: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, kind, link_offset, link_ts, link_g``: each event that is closed by a later one, with that one.

    Kinds: ``run`` (start to stop), ``wake`` (creation, block, yield, unblock, system call to what ends the wait), ``gc``, ``stw`` (by
    processor before version 1010, else by trace), ``sweep`` (by processor), ``assist`` (by goroutine), ``task``. Adjacent events of a
    subject that are no pair give no link.
    """
    acted = ev.withColumn("subject", subject(F.col("type_id"), F.col("g"), F.col("a0"))).where("subject is not null")
    start = STARTS
    exits, unblock, syscall = ID["GoSysExit"], ID["GoUnblock"], ID["GoSysCall"]
    run = _pairs(ev, "run", ["trace_id", "g"], [*start, *STOPS], [(start, STOPS)])
    wake_types = [*_BY_ARGUMENT, *start, *BLOCKS, *YIELDS, *ENDS, ID["GoWaiting"], ID["GoInSyscall"], syscall, ID["GoSysBlock"], exits]
    # a system call that blocks stays pending over its GoSysBlock
    wake = _pairs(
        acted, "wake", ["trace_id", "subject"], [t for t in wake_types if t != ID["GoSysBlock"]],
        [([ID["GoCreate"], *YIELDS, unblock, exits], start), ([ID["GoWaiting"], *BLOCKS], [unblock]), ([syscall], [exits])],
    )
    gc = _pairs(ev, "gc", ["trace_id"], [ID["GcStart"], ID["GcDone"]], [([ID["GcStart"]], [ID["GcDone"]])])
    stopped = _world_stops(ev, meta)
    stw = _pairs(stopped, "stw", ["trace_id", "_at"], [ID["GcStwStart"], ID["GcStwDone"]], [([ID["GcStwStart"]], [ID["GcStwDone"]])])
    sweep = _pairs(ev, "sweep", ["trace_id", "p"], [ID["GcSweepStart"], ID["GcSweepDone"]], [([ID["GcSweepStart"]], [ID["GcSweepDone"]])])
    assist = _pairs(ev, "assist", ["trace_id", "g"], [ID["GcMarkAssistStart"], ID["GcMarkAssistDone"]], [([ID["GcMarkAssistStart"]], [ID["GcMarkAssistDone"]])])
    task = _pairs(ev, "task", ["trace_id", "a0"], [ID["UserTaskCreate"], ID["UserTaskEnd"]], [([ID["UserTaskCreate"]], [ID["UserTaskEnd"]])])
    return reduce(DataFrame.unionByName, [run, wake, gc, stw, sweep, assist, task])


def netpoll_unblocks(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset``: unblocks, not by timers, of goroutines that were blocked on the network."""
    acted = ev.withColumn("_s", subject(F.col("type_id"), F.col("g"), F.col("a0"))).where(F.col("type_id").isin(*BLOCKS, ID["GoUnblock"], ID["GoWaiting"]) & F.col("_s").isNotNull())
    acted = durable(acted.select("trace_id", "_s", "ord", "rec_offset", "type_id", "p"))
    was = last_over(acted, ["trace_id", "_s"], ["ord", "rec_offset"], F.col("type_id"), "_was", bits=EVENT_BITS)
    return was.where((F.col("type_id") == ID["GoUnblock"]) & (F.col("_was") == ID["GoBlockNet"]) & F.coalesce(F.col("p") != TIMER_P, F.lit(True))).select("trace_id", "rec_offset")


# The state of a goroutine that an event needs and the state it leaves.
DEAD, RUNNABLE, RUNNING, WAITING = "dead", "runnable", "running", "waiting"


def _states() -> list[tuple[list[int], str, str]]:
    return [
        ([ID["GoCreate"]], DEAD, RUNNABLE),
        ([ID["GoWaiting"], ID["GoInSyscall"]], RUNNABLE, WAITING),
        (STARTS, RUNNABLE, RUNNING),
        ([*BLOCKS, ID["GoSysBlock"]], RUNNING, WAITING),
        (YIELDS, RUNNING, RUNNABLE),
        ([ID["GoUnblock"], ID["GoSysExit"]], WAITING, RUNNABLE),
        (ENDS, RUNNING, DEAD),
    ]


def state_violations(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: events whose goroutine was not in the state they need.

    Goroutines not seen before are dead, goroutine 0 runs from the start; ``rule_id`` is ``state``.
    """
    table = _states()
    need, leave = F.lit(None).cast("string"), F.lit(None).cast("string")
    for types, before, after in table:
        here = F.col("type_id").isin(*types)
        need, leave = F.when(here, before).otherwise(need), F.when(here, after).otherwise(leave)
    acted = ev.where(F.col("type_id").isin(*(t for types, *_ in table for t in types))).withColumn("subject", subject(F.col("type_id"), F.col("g"), F.col("a0"))).where("subject is not null")
    acted = durable(acted.select("trace_id", "subject", "ord", "rec_offset", "type_id"))
    was = last_over(acted, ["trace_id", "subject"], ["ord", "rec_offset"], leave, "_was", bits=EVENT_BITS)
    start = F.when(F.col("subject") == 0, RUNNING).otherwise(DEAD)
    was = was.withColumn("_was", F.coalesce("_was", start)).withColumn("_need", need)
    return was.where("_was <> _need").select("trace_id", "rec_offset", F.lit("state").alias("rule_id"), F.concat(F.lit("goroutine is "), "_was", F.lit(", not "), "_need").alias("message"))


def bracket_violations(ev: DataFrame, meta: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: nested starts and stray ends of collector cycles, stops of the world, sweeps, processors and tasks.

    Stops of the world are kept by processor before version 1010, later by trace.
    """
    plans = [
        ("gc", ["trace_id"], ID["GcStart"], ID["GcDone"], True),
        ("stw", ["trace_id", "_at"], ID["GcStwStart"], ID["GcStwDone"], True),
        ("sweep", ["trace_id", "p"], ID["GcSweepStart"], ID["GcSweepDone"], True),
        ("assist", ["trace_id", "g"], ID["GcMarkAssistStart"], ID["GcMarkAssistDone"], False),
        ("proc", ["trace_id", "p"], ID["ProcStart"], ID["ProcStop"], True),
        ("task", ["trace_id", "a0"], ID["UserTaskCreate"], ID["UserTaskEnd"], False),
    ]
    parts = []
    for rule, keys, opens, closes, strict in plans:
        of = _world_stops(ev, meta) if rule == "stw" else ev
        some = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, of.where(F.col("type_id").isin(opens, closes)))
        was = last_over(some, keys, ["ord", "rec_offset"], F.col("type_id"), "_was", bits=EVENT_BITS)
        open_, nested = F.col("_was") == opens, F.col("type_id") == opens
        bad = F.when(nested & open_, "started twice")
        if strict:
            bad = bad.when(~nested & ~F.coalesce(open_, F.lit(False)), "ended without a start")
        parts.append(was.select("trace_id", "rec_offset", F.lit(rule).alias("rule_id"), bad.alias("message")).where("message is not null"))
    return reduce(DataFrame.unionByName, parts)


def processor_violations(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: events that a processor cannot have had, given what ran on it.

    A start needs a free processor, as does a ProcStop; creations, stops, system calls and unblocks must come from the
    goroutine that runs there, and only creations and unblocks from goroutine 0. Pseudo-processors run nothing.
    """
    kind = F.col("type_id")
    needs = [ID["GoCreate"], ID["GoSysCall"], ID["GoUnblock"], *STOPS]
    some = ev.where(kind.isin(*needs, *STARTS, ID["ProcStop"]) & F.col("p").isNotNull() & F.col("g").isNotNull() & (F.col("p") < TIMER_P - 1))
    some = durable(some.select("trace_id", "p", "g", "ord", "rec_offset", "type_id"))
    was = last_over(some, ["trace_id", "p"], ["ord", "rec_offset"], F.when(kind.isin(*STARTS), F.col("g")).when(kind.isin(*STOPS), F.lit(0)), "_was", bits=EVENT_BITS).withColumn("_was", F.coalesce("_was", F.lit(0)))
    bad = (
        F.when((kind.isin(*STARTS) | (kind == ID["ProcStop"])) & (F.col("_was") != 0), "processor is busy")
        .when(kind.isin(*needs) & (F.col("_was") != F.col("g")), "goroutine does not run here")
        .when(kind.isin(ID["GoSysCall"], *STOPS) & (F.col("g") == 0), "goroutine 0 did this")
    )
    return was.select("trace_id", "rec_offset", F.lit("processor").alias("rule_id"), bad.alias("message")).where("message is not null")


def region_violations(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: region starts whose end has another name or task."""
    marks = ev.where((F.col("type_id") == ID["UserRegion"]) & F.col("a1").isin(0, 1) & F.col("g").isNotNull()).withColumn("name", F.try_element_at("string_args", F.lit(1)))
    pairs = match(marks, ["trace_id", "g"], ["ord", "rec_offset", "a0", "name"], F.col("a1") == 0)
    odd = ~(F.col("other.a0").eqNullSafe(F.col("a0")) & F.col("other.name").eqNullSafe(F.col("name")))
    return pairs.where(F.col("other").isNotNull() & odd).select("trace_id", "rec_offset", F.lit("region").alias("rule_id"), F.lit("ended by a region of another name or task").alias("message"))


def dictionary_violations(strings: DataFrame) -> DataFrame:
    """``trace_id, string_id, rule_id``: string ids of 0, empty strings, and ids with several different values."""
    by = strings.groupBy("trace_id", "string_id").agg(F.min("val").alias("_a"), F.max("val").alias("_b"), F.max((F.col("val") == "").cast("int")).alias("_empty"))
    rule = F.when(F.col("string_id") == 0, "zero id").when(F.col("_empty") == 1, "empty string").when(F.col("_a") != F.col("_b"), "several values")
    return by.select("trace_id", "string_id", rule.alias("rule_id")).where("rule_id is not null")
