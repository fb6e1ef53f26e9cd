"""Times of goroutines: how long each ran, waited and blocked, with its regions and the state at any instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions.catalog import ENDS, ID, STARTS, STOPS, SYNC_BLOCKS, YIELDS
from skein.functions.stepfn import as_of, integral_at
from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, TIME_BITS, last_over, lead_over, number_over, running, sum_over
from skein.operators.brackets import match
from skein.operators.events import latest, world
from skein.operators.hierarchy import hierarchy
from skein.operators.linking import subject

STATES = ("exec", "sched_wait", "io", "block", "syscall")
PAIRS = {"sweep": (ID["GcSweepStart"], ID["GcSweepDone"]), "assist_mark": (ID["GcMarkAssistStart"], ID["GcMarkAssistDone"])}
TIMES = (*(f"{s}_time" for s in STATES), "gc_time", "sweep_time", "assist_mark_time", "total_time")
_WAITS = [ID["GoCreate"], *YIELDS, ID["GoUnblock"], ID["GoSysExit"]]
_SUBJECTS = sorted({*_WAITS, *STARTS, *STOPS})


def state_intervals(ev: DataFrame) -> DataFrame:
    """``trace_id, g, ord, type_id, ts, state, end_ts, counted``: what each goroutine did from event to event.

    ``state`` is ``exec, sched_wait, io, block, syscall`` or null. An interval is counted if the event that ends it fits: a
    start is ended by a stop, a wait for the scheduler by a start, a block by an unblock, a blocked system call by its
    exit. The goroutine's end closes whatever is open. The last one goes on to the end of the trace (``end_ts`` null).
    """
    acted = ev.where(F.col("type_id").isin(*_SUBJECTS)).select("trace_id", subject(F.col("type_id"), F.col("g"), F.col("a0")).alias("g"), "ord", "rec_offset", "type_id", "ts", "p").where("g is not null")
    kind = F.col("type_id")
    state = F.when(kind.isin(*STARTS), "exec").when(kind.isin(*_WAITS), "sched_wait").when(kind == ID["GoBlockNet"], "io").when(kind.isin(*SYNC_BLOCKS), "block").when(kind == ID["GoSysBlock"], "syscall")
    nxt = lead_over(acted, ["trace_id", "g"], ["ord", "rec_offset"], F.struct("type_id", "ts", "rec_offset"), "_next", bits=EVENT_BITS)
    then = F.col("_next.type_id")
    fits = F.when(F.col("state") == "exec", then.isin(*STOPS)).when(F.col("state") == "sched_wait", then.isin(*STARTS)).when(F.col("state").isin("io", "block"), then == ID["GoUnblock"]).when(F.col("state") == "syscall", then == ID["GoSysExit"]).otherwise(F.lit(False))
    return nxt.withColumn("state", state).select("trace_id", "g", "ord", "rec_offset", "type_id", "ts", "p", "state", F.col("_next.ts").alias("end_ts"), F.col("_next.rec_offset").alias("end_offset"), F.when(then.isNull() | then.isin(*ENDS), F.col("state").isNotNull()).otherwise(fits).alias("counted"))


def pair_intervals(ev: DataFrame, what: str) -> DataFrame:
    """``trace_id, g, ord, ts, end_ts``: sweeps or mark assists of each goroutine; stray ends are ignored, open ones have no end."""
    first, last = PAIRS[what]
    some = ev.where(F.col("type_id").isin(first, last) & F.col("g").isNotNull()).select("trace_id", "g", "ord", "rec_offset", "type_id", "ts")
    nxt = lead_over(some, ["trace_id", "g"], ["ord", "rec_offset"], F.struct("type_id", "ts"), "_next", bits=EVENT_BITS)
    # a start that is followed by another start is overwritten by it
    return nxt.where((F.col("type_id") == first) & (F.col("_next").isNull() | (F.col("_next.type_id") == last))).select("trace_id", "g", "ord", "ts", F.col("_next.ts").alias("end_ts"))


def _stray_ends(ev: DataFrame, what: str) -> DataFrame:
    """What older tools added for ends without a start: the time since the trace began."""
    first, last = PAIRS[what]
    some = ev.where(F.col("type_id").isin(first, last) & F.col("g").isNotNull())
    was = last_over(some, ["trace_id", "g"], ["ord", "rec_offset"], F.col("type_id"), "_was", bits=EVENT_BITS)
    lost = was.where((F.col("type_id") == last) & (F.col("_was").isNull() | (F.col("_was") == last)))
    return lost.groupBy("trace_id", "g").agg(F.sum("ts").alias(f"{what}_time"))


def gc_cycles(ev: DataFrame) -> DataFrame:
    """``trace_id, ts, done_ts``: collector cycles; an unfinished one has no end."""
    first, last = ID["GcStart"], ID["GcDone"]
    some = ev.where(F.col("type_id").isin(first, last)).select("trace_id", "ord", "rec_offset", "type_id", "ts")
    nxt = lead_over(some, ["trace_id"], ["ord", "rec_offset"], F.struct("type_id", "ts"), "_next")
    return nxt.where((F.col("type_id") == first) & (F.col("_next").isNull() | (F.col("_next.type_id") == last))).select("trace_id", "ts", F.col("_next.ts").alias("done_ts"))


def _gc_points(ev: DataFrame) -> DataFrame:
    """The collector as a step function: 1 during a cycle."""
    cycles = gc_cycles(ev)
    ups = cycles.select("trace_id", F.col("ts").alias("time"), F.lit(1).alias("d"))
    downs = cycles.where("done_ts is not null").select("trace_id", F.col("done_ts").alias("time"), F.lit(-1).alias("d"))
    deltas = ups.unionByName(downs).groupBy("trace_id", "time").agg(F.sum("d").alias("d"))
    return sum_over(deltas, ["trace_id"], ["time"], F.col("d"), "running").select("trace_id", "time", F.col("running").cast("bigint").alias("running"))


def lifetimes(ev: DataFrame) -> DataFrame:
    """``trace_id, g, creation_ts, create_stack, start_ts, end_ts``: one row per goroutine that a GoCreate made."""
    made = ev.where((F.col("type_id") == ID["GoCreate"]) & F.col("a0").isNotNull()).groupBy("trace_id", F.col("a0").alias("g")).agg(F.min("ts").alias("creation_ts"), F.min_by("a1", F.struct("ord", "rec_offset")).alias("create_stack"))
    went = ev.where(F.col("type_id").isin(*STARTS, *ENDS)).groupBy("trace_id", "g").agg(F.min(F.when(F.col("type_id").isin(*STARTS), F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("type_id").isin(*ENDS), F.col("ts"))).alias("end_ts"))
    return made.join(went, ["trace_id", "g"], "left")


def goroutines(ev: DataFrame, stacks: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """One row per created goroutine: name, pc, creation, start, end and its nine times.

    Open states count up to the end of the trace. ``gc_time`` is the time collector cycles ran while the goroutine lived. Events of
    goroutines without a GoCreate are left out. Name and pc are those of the first frame of the stack it was created with, once it
    has started. ``compat`` hides end times, keeps only the last cycle's ``gc_time`` and lets stray ends of sweeps and mark
    assists count from the trace's beginning, as older tools did.
    """
    lives = lifetimes(ev)
    ends = world(ev)
    times = state_intervals(ev).where("counted").join(ends, "trace_id").withColumn("_d", F.coalesce("end_ts", "world_end") - F.col("ts"))
    sums = times.groupBy("trace_id", "g").agg(*(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("_d"))), F.lit(0)).alias(f"{s}_time") for s in STATES))
    out = lives.join(ends, "trace_id").join(sums, ["trace_id", "g"], "left")
    upto = F.coalesce("end_ts", "world_end")
    for what in PAIRS:
        stray = _stray_ends(ev, what) if compat else None
        pairs = pair_intervals(ev, what).join(lives.select("trace_id", "g", F.col("end_ts").alias("_end")), ["trace_id", "g"]).join(ends, "trace_id")
        spent = pairs.groupBy("trace_id", "g").agg(F.sum(F.coalesce("end_ts", "_end", "world_end") - F.col("ts")).alias(f"{what}_time"))
        if stray is not None:
            spent = spent.unionByName(stray).groupBy("trace_id", "g").agg(F.sum(f"{what}_time").alias(f"{what}_time"))
        out = out.join(spent, ["trace_id", "g"], "left")
    if compat:
        done = gc_cycles(ev).where("done_ts is not null")
        # the last cycle that ended while the goroutine lived
        probes = out.select("trace_id", "g", "creation_ts", upto.alias("time"))
        last = as_of(done.withColumn("time", F.col("done_ts")), probes, ["trace_id"], "time", F.struct("ts", "done_ts"), "_c", bits=TIME_BITS)
        spent = last.select("trace_id", "g", F.coalesce(F.when(F.col("_c.done_ts") >= F.col("creation_ts"), F.col("_c.done_ts") - F.greatest("_c.ts", "creation_ts")), F.lit(0)).alias("gc_time"))
        out = out.join(spent, ["trace_id", "g"], "left")
    else:
        points = _gc_points(ev)
        probes = out.select("trace_id", "g", F.col("creation_ts").alias("time"), F.lit(-1).alias("_sign")).unionByName(out.select("trace_id", "g", upto.alias("time"), F.lit(1).alias("_sign")))
        spent = integral_at(points, probes, ["trace_id"], "time", "running", "_area", TIME_BITS).groupBy("trace_id", "g").agg(F.sum(F.col("_sign") * F.col("_area")).alias("gc_time"))
        out = out.join(spent, ["trace_id", "g"], "left")
    if stacks is not None:
        top = latest(stacks, "stack_id", "frames").select("trace_id", F.col("stack_id").alias("create_stack"), F.try_element_at("frames", F.lit(1)).alias("_top"))
        out = out.join(top, ["trace_id", "create_stack"], "left")
    else:
        out = out.withColumn("_top", F.lit(None).cast("struct<pc:bigint,fn:string>"))
    started = F.col("start_ts").isNotNull()
    end = F.lit(None).cast("bigint") if compat else F.col("end_ts")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in TIMES if c != "total_time"}
    return out.select("trace_id", "g", F.when(started, F.col("_top.fn")).alias("name"), F.when(started, F.col("_top.pc")).alias("pc"), "creation_ts", "start_ts", end.alias("end_ts"), *(v.alias(c) for c, v in zero.items()), (upto - F.col("creation_ts")).alias("total_time"))


def user_regions(ev: DataFrame) -> DataFrame:
    """``trace_id, task_id, g, name, start_offset, start_ts, start_ord, end_offset, end_ts, end_ord, depth``: what UserRegion events open and close.

    An end closes the inner-most open region, a stray end makes a region without a start, the goroutine's GoEnd closes
    all that are open, and what is open at the end of the trace has no end. Other modes than 0 and 1 are left out.
    """
    end = ID["GoEnd"]
    marks = ev.where(F.col("g").isNotNull() & ((F.col("type_id") == end) | ((F.col("type_id") == ID["UserRegion"]) & F.col("a1").isin(0, 1))))
    marks = sum_over(marks, ["trace_id", "g"], ["ord", "rec_offset"], (F.col("type_id") == end).cast("int"), "_life", inclusive=False, bits=EVENT_BITS)
    ends = marks.where(F.col("type_id") == end).groupBy("trace_id", "g", "_life").agg(F.min(F.struct("ord", F.col("rec_offset").alias("rec_offset"), "ts")).alias("_end"))
    keys = ["trace_id", "g", "_life"]
    matched = match(marks.where(F.col("type_id") != end), keys, ["ord", "rec_offset", "ts"], F.col("a1") == 0).join(ends, keys, "left")
    close = F.coalesce("other", "_end")
    opened = matched.where("a1 = 0").withColumn("_close", close)
    name = F.try_element_at("string_args", F.lit(1)).alias("name")
    whole = opened.select("trace_id", F.col("a0").alias("task_id"), "g", name, F.col("rec_offset").alias("start_offset"), F.col("ts").alias("start_ts"), F.col("ord").alias("start_ord"), F.col("_close.rec_offset").alias("end_offset"), F.col("_close.ts").alias("end_ts"), F.col("_close.ord").alias("end_ord"), "depth")
    none = F.lit(None).cast("bigint")
    stray = matched.where("stray").select("trace_id", F.col("a0").alias("task_id"), "g", name, none.alias("start_offset"), none.alias("start_ts"), none.alias("start_ord"), F.col("rec_offset").alias("end_offset"), F.col("ts").alias("end_ts"), F.col("ord").alias("end_ord"), "depth")
    return whole.unionByName(stray)


def region_frames(regions: DataFrame, ev: DataFrame, stacks: DataFrame) -> DataFrame:
    """``trace_id, g, start_offset, place, fn, pc``: the frame each region was started in, the first of its start's stack, and its place among its goroutine's regions.

    Places go by the start's time, regions without a start first, then by offsets. Frame and pc are null where start, stack or frame are missing.
    """
    timed = durable(regions.select("trace_id", "g", F.coalesce("start_ts", F.lit(-1)).alias("_at"), "start_offset", "end_offset"))
    placed = number_over(timed, ["trace_id", "g"], ["_at", "start_offset", "end_offset"], "place", bits=TIME_BITS).select("trace_id", "g", "start_offset", "place")
    starts = ev.where(F.col("type_id") == ID["UserRegion"]).select("trace_id", F.col("rec_offset").alias("start_offset"), "stack_id")
    top = latest(stacks, "stack_id", "frames").where("stack_id <> 0").select("trace_id", "stack_id", F.try_element_at("frames", F.lit(1)).alias("_top"))
    framed = starts.join(top, ["trace_id", "stack_id"]).select("trace_id", "start_offset", "_top.fn", "_top.pc")
    return placed.join(framed, ["trace_id", "start_offset"], "left").select("trace_id", "g", "start_offset", "place", "fn", "pc")


def _inherited(ev: DataFrame, own: DataFrame) -> DataFrame:
    """The nameless regions goroutines take over from their creators, with the columns of :func:`user_regions`, their ``depth`` 0.

    Such a region starts at the goroutine's creation and lies below all of its ``own`` regions, so the first end that is stray
    among these closes it, or the goroutine's GoEnd, if that comes first. Its task is that of the creator's inner-most open
    region or, where the creator has none of its own open, of the region the creator itself has taken over, as long as
    that is open, and so on up. Task 0 is none.
    """
    rows = own.where("start_ord is not null")
    marks = rows.select("trace_id", "g", F.col("start_ord").alias("ord"), F.col("depth").alias("level"), F.col("task_id").alias("_task"), F.lit(True).alias("_on")).unionByName(rows.where("end_ord is not null").select("trace_id", "g", F.col("end_ord").alias("ord"), (F.col("depth") - 1).alias("level"), F.lit(None).cast("bigint").alias("_task"), F.lit(False).alias("_on")))
    began = last_over(marks, ["trace_id", "g", "level"], ["ord", "_on"], F.when(F.col("_on"), F.struct("_task")), "_began", inclusive=True, bits=EVENT_BITS)
    tops = began.withColumn("_top", F.when(F.col("level") > 0, F.col("_began"))).groupBy("trace_id", "g", "ord").agg(F.min_by("_top", "level").alias("_top"), F.min("level").alias("level"))
    made = ev.where((F.col("type_id") == ID["GoCreate"]) & F.col("g").isNotNull() & F.col("a0").isNotNull()).select("trace_id", "g", F.col("a0").alias("child"), "ord", "rec_offset", "ts")
    seen = as_of(tops, made, ["trace_id", "g"], "ord", F.struct("level", "_top"), "_at", strict=True, bits=EVENT_BITS)
    first = durable(seen.groupBy("trace_id", "child").agg(F.min_by(F.struct(F.col("g"), F.col("ord"), F.col("rec_offset"), F.col("ts"), F.col("_at")), F.struct("ord", "rec_offset")).alias("x")))
    strays = own.where("start_ord is null").select("trace_id", "g", F.struct(F.col("end_ord").alias("ord"), F.col("end_offset").alias("rec_offset"), F.col("end_ts").alias("ts")).alias("_shut"))
    closes = strays.unionByName(ev.where((F.col("type_id") == ID["GoEnd"]) & F.col("g").isNotNull()).select("trace_id", "g", F.struct("ord", "rec_offset", "ts").alias("_shut")))
    born = first.select("trace_id", F.col("child").alias("g"), F.struct("x.ord", "x.rec_offset", "x.ts").alias("_born"))
    shut = durable(closes.join(born, ["trace_id", "g"]).where("_shut > _born").groupBy("trace_id", "g").agg(F.min("_shut").alias("_shut")))
    by = first.join(shut.select("trace_id", F.col("g").alias("_by"), F.col("_shut.ord").alias("_gone")), (first.trace_id == shut.trace_id) & (F.col("x.g") == F.col("_by")), "left").select(first.trace_id, "child", "x", "_gone")
    level = F.coalesce(F.col("x._at.level"), F.lit(0)) > 0
    held = ~level & (F.col("_gone").isNull() | (F.col("_gone") >= F.col("x.ord")))
    links = by.select("trace_id", F.col("child").alias("task_id"), F.when(held, F.col("x.g")).alias("parent_id"), F.when(level, F.col("x._at._top._task")).alias("_own"), "x")
    roots = hierarchy(links.select("trace_id", "task_id", "parent_id"), with_paths=False).where("root_id is not null").select("trace_id", F.col("task_id").alias("g"), "root_id")
    given = links.select("trace_id", F.col("task_id").alias("root_id"), F.col("_own").alias("task_id"))
    got = roots.join(given, ["trace_id", "root_id"]).where("task_id is not null and task_id <> 0")
    at = links.select("trace_id", F.col("task_id").alias("g"), F.col("x.rec_offset").alias("start_offset"), F.col("x.ts").alias("start_ts"), F.col("x.ord").alias("start_ord"))
    whole = got.select("trace_id", "g", "task_id").join(at, ["trace_id", "g"]).join(shut, ["trace_id", "g"], "left")
    return whole.select("trace_id", "task_id", "g", F.lit(None).cast("string").alias("name"), "start_offset", "start_ts", "start_ord", F.col("_shut.rec_offset").alias("end_offset"), F.col("_shut.ts").alias("end_ts"), F.col("_shut.ord").alias("end_ord"), F.lit(0).alias("depth"))


def regions(ev: DataFrame) -> DataFrame:
    """``user_regions`` and the nameless regions goroutines take over from their creators; ends that close one of these are not stray."""
    own = durable(user_regions(ev))
    taken = durable(_inherited(ev, own))
    used = taken.where("end_offset is not null").select("trace_id", "g", "end_offset")
    stray = own.where("start_ord is null").join(used, ["trace_id", "g", "end_offset"], "left_anti")
    return own.where("start_ord is not null").unionByName(stray).unionByName(taken)


def inherited_tasks(ev: DataFrame) -> DataFrame:
    """``trace_id, g, task_id, start_offset, start_ts, start_ord``: the task each goroutine takes over from its creator, if any."""
    return _inherited(ev, durable(user_regions(ev))).select("trace_id", "g", "task_id", "start_offset", "start_ts", "start_ord")


def snapshots(ev: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (``trace_id, g, ord, ts`` and more) with the nine times of the goroutine as they stand at that event.

    The open part of a state counts, whatever ends it later. Times of goroutines without GoCreate are 0.
    """
    spans = state_intervals(ev).withColumn("_d", F.when(F.col("counted"), F.col("end_ts") - F.col("ts")))
    # states, sweeps, assists and probes of a goroutine in one order, so that one pass over its blocks sees them all
    none = F.lit(None)
    held = {"_state": F.struct("ts", "state", "_d"), **{f"_{w}": none.cast("struct<ts:bigint,end_ts:bigint>") for w in PAIRS}}
    rows = spans.select("trace_id", "g", "ord", F.lit(0).alias("_side"), *(v.alias(k) for k, v in held.items()))
    for what in PAIRS:
        pair = {"_state": none.cast("struct<ts:bigint,state:string,_d:bigint>"), **{f"_{w}": F.struct("ts", "end_ts") if w == what else none.cast("struct<ts:bigint,end_ts:bigint>") for w in PAIRS}}
        rows = rows.unionByName(pair_intervals(ev, what).select("trace_id", "g", "ord", F.lit(0).alias("_side"), *(v.alias(k) for k, v in pair.items())))
    merged = durable(rows.unionByName(probes.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    last = {f"_l{k}": ("last", F.col(k)) for k in held}
    sums = {f"{s}_time": ("sum", F.when(F.col("_state.state") == s, F.col("_state._d"))) for s in STATES} | {f"{w}_time": ("sum", F.col(f"_{w}.end_ts") - F.col(f"_{w}.ts")) for w in PAIRS}
    got = running(merged, ["trace_id", "g"], ["ord", "_side"], last | sums, EVENT_BITS).where("_side = 1")
    zero = F.lit(0)
    for s in STATES:  # the last state counts as far as the probe
        got = got.withColumn(f"{s}_time", F.col(f"{s}_time") + F.when(F.col("_l_state.state") == s, F.col("ts") - F.col("_l_state.ts") - F.coalesce("_l_state._d", zero)).otherwise(zero))
    for w in PAIRS:
        whole, upto = F.col(f"_l_{w}.end_ts") - F.col(f"_l_{w}.ts"), F.least(F.coalesce(f"_l_{w}.end_ts", "ts"), F.col("ts")) - F.col(f"_l_{w}.ts")
        got = got.withColumn(f"{w}_time", F.col(f"{w}_time") + F.coalesce(upto - F.coalesce(whole, zero), zero))
    got = got.select(*probes.columns, *sums)
    points = durable(_gc_points(ev))
    born = lifetimes(ev).select("trace_id", "g", F.col("creation_ts").alias("_born"))
    born = integral_at(points, born.withColumn("time", F.col("_born")), ["trace_id"], "time", "running", "_then", TIME_BITS).select("trace_id", "g", "_born", "_then")
    got = integral_at(points, got.withColumn("time", F.col("ts")), ["trace_id"], "time", "running", "_now", TIME_BITS).drop("time")
    got = got.join(born, ["trace_id", "g"], "left")
    got = got.withColumn("gc_time", F.when(F.col("_born").isNotNull(), F.col("_now") - F.col("_then")).otherwise(0)).withColumn("total_time", F.coalesce(F.col("ts") - F.col("_born"), F.lit(0)))
    return got.drop("_now", "_then", "_born")


def region_stats(ev: DataFrame, inherited: bool = True) -> DataFrame:
    """``regions`` with the nine times spent inside each: the snapshot at its end minus that at its start.

    Without a start nothing is subtracted; an open region is measured at the last event of the trace. Without ``inherited``
    those of ``user_regions``.
    """
    spans = durable(regions(ev) if inherited else user_regions(ev))
    keyed = spans.select("trace_id", "g", F.coalesce("start_offset", F.lit(-1)).alias("start_offset"), F.coalesce("end_offset", F.lit(-1)).alias("end_offset"), "start_ord", "start_ts", "end_ord", "end_ts")
    last = ev.groupBy("trace_id").agg(F.max("ord").alias("_ord"), F.max("ts").alias("_ts"))
    ends = keyed.join(last, "trace_id").select("trace_id", "g", "start_offset", "end_offset", F.lit(1).alias("_sign"), F.coalesce("end_ord", "_ord").alias("ord"), F.coalesce("end_ts", "_ts").alias("ts"))
    starts = keyed.where("start_ord is not null").select("trace_id", "g", "start_offset", "end_offset", F.lit(-1).alias("_sign"), F.col("start_ord").alias("ord"), F.col("start_ts").alias("ts"))
    shot = snapshots(ev, starts.unionByName(ends))
    keys = ["trace_id", "g", "start_offset", "end_offset"]
    diff = shot.groupBy(*keys).agg(*(F.sum(F.col("_sign") * F.col(c)).cast("bigint").alias(c) for c in TIMES))
    named = spans.withColumn("_s", F.coalesce("start_offset", F.lit(-1))).withColumn("_e", F.coalesce("end_offset", F.lit(-1)))
    d = diff.select("trace_id", "g", F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e"), *TIMES)
    return named.join(d, ["trace_id", "g", "_s", "_e"]).drop("_s", "_e", "start_ord", "end_ord", "depth")
