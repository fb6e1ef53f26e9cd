"""One order of all events of a trace, and checks of it.

For traces of version 1007 and later the order is by time; events of equal time on several processors are put in an order that
the states and sequence numbers of their goroutines allow. Older traces carry a global sequence number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skein.functions.catalog import ID, STARTS
from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, OFFSET_BITS, last_over, number_over, sum_over
from skein.operators.linking import BLOCKS, YIELDS

# Input-only types and what they stand for.
GARBAGE = -2  # stands for the collector where goroutines are meant
LOCAL = {ID["GoStartLocal"]: ID["GoStart"], ID["GoUnblockLocal"]: ID["GoUnblock"], ID["GoSysExitLocal"]: ID["GoSysExit"]}


def renamed(raw: DataFrame, column: str = "raw_type_id") -> DataFrame:
    """``raw`` with ``type_id``: the raw type, local variants replaced by what they stand for."""
    kind = F.col(column)
    for local, plain in LOCAL.items():
        kind = F.when(F.col(column) == local, plain).otherwise(kind)
    return raw.withColumn("type_id", kind)


def _steps(kind: int, seq: int | None) -> tuple[str, int | None, str, int | None]:
    """State and sequence number an event needs, and the state it leaves; the number follows."""
    if kind == ID["GoCreate"]:
        return "dead", 0, "runnable", 1
    if kind in (ID["GoWaiting"], ID["GoInSyscall"]):
        return "runnable", 1, "waiting", 2
    if kind == ID["GcStart"]:
        return "dead", seq, "dead", None
    if kind in STARTS:
        return "runnable", seq, "running", None
    if kind in BLOCKS or kind == ID["GoSysBlock"]:
        return "running", None, "waiting", None
    if kind in YIELDS:
        return "running", None, "runnable", None
    return "waiting", seq, "runnable", None


def _untie(t: pa.Table) -> pa.Table:
    """Orders events of one time: per processor as they stand, across processors as the needed states and numbers allow.

    The state before the tie is not known here; a goroutine's first event in the tie is taken to be the one with the
    smallest sequence number that needs no state another event of the tie would leave. An event is ready when its goroutine
    is in the state it needs and its number, if it has one, follows the last one of the goroutine in the tie. Where none is
    ready the next one is ``_forced``.
    """
    rows = sorted(t.to_pylist(), key=lambda r: (r["p"], r["rec_offset"]))
    queues: dict[int, list[dict]] = {}
    for r in rows:
        queues.setdefault(r["p"], []).append(r)
    state: dict[int, str] = {}
    seen: dict[int, list[dict]] = {}
    for r in rows:
        if r["subject"] is not None:
            seen.setdefault(r["subject"], []).append(r)
    for s, group in seen.items():
        leaves = {_steps(r["type_id"], r["seq_no"])[2] for r in group}
        first = [r for r in group if _steps(r["type_id"], r["seq_no"])[0] not in leaves] or sorted(group, key=lambda r: (r["seq_no"] is None, r["seq_no"] or 0))[:1]
        state[s] = _steps(first[0]["type_id"], first[0]["seq_no"])[0]
    out, due = [], {}

    def ready(r: dict) -> bool:
        subject = r["subject"]
        if subject is None:
            return True
        fits = _steps(r["type_id"], None)[0] == state[subject]
        return fits and (r["seq_no"] is None or due.get(subject, r["seq_no"]) == r["seq_no"])

    while queues:
        fit = [p for p in sorted(queues) if ready(queues[p][0])]
        # among events that are ready, the smaller sequence number of a goroutine goes first
        p = min(fit or sorted(queues), key=lambda q: (queues[q][0]["seq_no"] or 0, q))
        r = queues[p].pop(0)
        if not queues[p]:
            del queues[p]
        if r["subject"] is not None:
            state[r["subject"]] = _steps(r["type_id"], None)[2]
            if r["seq_no"] is not None:
                due[r["subject"]] = r["seq_no"] + 1
        out.append((r["trace_id"], r["rec_offset"], len(out), not fit))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["trace_id", "rec_offset", "_tie", "_forced"])


def _ties(base: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, _tie, _forced``: the places of events of one time on several processors, where a goroutine has more than one of them."""
    timed = base.where((F.col("version") >= 1007) & F.col("ts").isNotNull())
    ties = timed.groupBy("trace_id", "ts").agg(F.countDistinct("p").alias("_ps"), F.count("subject").alias("_n"), F.countDistinct("subject").alias("_d")).where("_ps > 1 and _n > _d").select("trace_id", "ts")
    tied = timed.join(ties, ["trace_id", "ts"], "left_semi").select("trace_id", "ts", "p", "rec_offset", "type_id", "subject", "seq_no")
    kinds = [("trace_id", T.StringType()), ("rec_offset", T.LongType()), ("_tie", T.LongType()), ("_forced", T.BooleanType())]
    return tied.groupBy("trace_id", "ts").applyInArrow(_untie, T.StructType([T.StructField(*k) for k in kinds]))


def _with_subject(ev: DataFrame) -> DataFrame:
    kind = F.col("type_id")
    ordered = [ID["GoCreate"], ID["GoWaiting"], ID["GoInSyscall"], *STARTS, *BLOCKS, ID["GoSysBlock"], *YIELDS, ID["GoUnblock"], ID["GoSysExit"]]
    who = F.when(kind.isin(ID["GoCreate"], ID["GoUnblock"], ID["GoSysExit"]), F.col("a0")).when(kind.isin(*ordered), F.col("g")).when(kind == ID["GcStart"], F.lit(GARBAGE).cast("bigint"))
    seq = F.when(kind.isin(*STARTS, ID["GoUnblock"], ID["GoSysExit"]) & (F.col("raw_type_id") == kind), F.col("a1")).when(kind == ID["GcStart"], F.col("a0"))
    return ev.withColumn("subject", who).withColumn("seq_no", seq)


def ordered(ev: DataFrame) -> DataFrame:
    """``ev`` with ``ord`` (0, 1, 2 ... per trace) and the repaired time ``ts``.

    Needs ``trace_id, version, rec_offset, raw_type_id, type_id, ts, seq, p, g, a0, a1, a2``. GoSysExit takes its real time from its arguments where
    there is one. Rows of equal time keep their place on their processor.
    """
    old = F.col("version") < 1007
    base = _with_subject(ev)
    places = _ties(base).drop("_forced")
    exits = F.col("type_id") == ID["GoSysExit"]
    local = F.col("raw_type_id") == ID["GoSysExitLocal"]
    given = F.when(local, F.col("a1")).otherwise(F.col("a2"))
    real = F.when(exits & (given != 0), given).otherwise(F.col("ts"))
    got = base.join(places, ["trace_id", "rec_offset"], "left").withColumn("_ts", real)
    got = got.withColumn("_key", F.when(old, F.when(exits, F.col("a1")).otherwise(F.col("seq"))).otherwise(F.col("_ts")))
    got = got.withColumn("_tie", F.coalesce("_tie", F.lit(0)))
    got = got.drop("ord") if "ord" in got.columns else got
    got = number_over(durable(got.where("_key is not null")), ["trace_id"], ["_key", "_tie", "p", "rec_offset"], "_n", bits=34)
    return got.withColumn("ord", F.col("_n") - 1).withColumn("ts", F.col("_ts")).drop("_n", "_key", "_tie", "_ts", "subject", "seq_no")


def order_violations(ev: DataFrame, keys: tuple[str, ...] = ("trace_id",), order: tuple[str, ...] = ("ord", "rec_offset")) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: events earlier than the one before them in the given order."""
    timed = durable(ev.where("ts is not null").select(*keys, *order, *({"rec_offset", "trace_id"} - {*keys, *order}), "ts"))
    was = last_over(timed, list(keys), list(order), F.struct("ts"), "_was", bits=EVENT_BITS if order[0] == "ord" else OFFSET_BITS)
    return was.where(F.col("ts") < F.col("_was.ts")).select("trace_id", "rec_offset", F.lit("time order").alias("rule_id"), F.lit("time stamps out of order").alias("message"))


def tie_violations(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: events of one time on several processors that no state and sequence number of their goroutine allows in any order."""
    forced = _ties(_with_subject(ev)).where("_forced")
    return forced.select("trace_id", "rec_offset", F.lit("tie").alias("rule_id"), F.lit("no consistent ordering of events possible").alias("message"))


def sequence_violations(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, rule_id, message``: events whose sequence number is not how many numbered events their goroutine, or the collector, had before.

    A creation is number 0, a goroutine found waiting or in a system call number 1; starts, unblocks, exits and collector starts carry
    theirs, except the local ones, which count without one. From version 1007 on; needs the columns of :func:`ordered`.
    """
    kind = F.col("type_id")
    found = kind.isin(ID["GoWaiting"], ID["GoInSyscall"])
    counted = kind.isin(ID["GoCreate"], *STARTS, ID["GoUnblock"], ID["GoSysExit"], ID["GcStart"]) | found
    numbered = _with_subject(ev.where((F.col("version") >= 1007) & counted)).where("subject is not null")
    need = F.when(kind == ID["GoCreate"], 0).when(found, 1).otherwise(F.col("seq_no"))
    numbered = durable(numbered.select("trace_id", "subject", "ord", "rec_offset", "type_id", "raw_type_id", "seq_no"))
    got = number_over(numbered, ["trace_id", "subject"], ["ord", "rec_offset"], "_n", bits=EVENT_BITS)
    return got.where(need != F.col("_n") - 1).select("trace_id", "rec_offset", F.lit("sequence").alias("rule_id"), F.lit("no consistent ordering of events possible").alias("message"))


def exit_repair(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, ts, blocked_ts, repaired_ts, rule_id``: system call exits with the time of the block before and the repaired time.

    ``rule_id`` is ``stray exit`` where no block or system call of the goroutine came before, ``exit before block`` where the
    repaired time is earlier than it, else null.
    """
    kind = F.col("type_id")
    some = ev.where(kind.isin(ID["GoSysBlock"], ID["GoInSyscall"], ID["GoSysExit"]) & F.col("g").isNotNull())
    some = durable(some.select("trace_id", "g", "ord", "rec_offset", "type_id", "ts", "a2"))
    was = last_over(some, ["trace_id", "g"], ["ord", "rec_offset"], F.when(kind.isin(ID["GoSysBlock"], ID["GoInSyscall"]), F.col("ts")), "blocked_ts", bits=EVENT_BITS).where(kind == ID["GoSysExit"])
    real = F.when(F.col("a2") != 0, F.col("a2")).otherwise(F.col("ts"))
    rule = F.when(F.col("blocked_ts").isNull(), "stray exit").when(real < F.col("blocked_ts"), "exit before block")
    return was.select("trace_id", "rec_offset", "ts", "blocked_ts", real.alias("repaired_ts"), rule.alias("rule_id"))


def sequence_numbers(ev: DataFrame) -> DataFrame:
    """``trace_id, p, rec_offset, delta, restored``: times as differences along a processor, and restored by running sums."""
    keys, order = ["trace_id", "p"], ["ord", "rec_offset"]
    was = last_over(durable(ev.where("p is not null").select(*keys, *order, "ts")), keys, order, F.col("ts"), "_before", bits=EVENT_BITS)
    restored = sum_over(was.withColumn("delta", F.col("ts") - F.coalesce("_before", F.lit(0))), keys, order, F.col("delta"), "restored", bits=EVENT_BITS)
    return restored.select("trace_id", "p", "rec_offset", "delta", "restored")
