"""Times of goroutines over a stream of events, with the same result as the batch operator.

Events may arrive in any order as long as they arrive before the watermark, which runs ``delay`` behind the newest arrival. The
state of a goroutine is its open interval and the five sums up to its last settled event, and the events that are not settled
yet: those that arrived after the watermark, and what follows one of them in the trace. Every batch gives the result over both,
so it equals the batch result over the events that have come. Memory is bounded by the events of one delay and by the
goroutines that have not ended: a goroutine that has ended is forgotten once the watermark has passed its last arrival.
An event that comes for a place before the settled ones is late: it is counted and has no other effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.catalog import ENDS, ID, STARTS, STOPS, SYNC_BLOCKS
from skein.operators.goroutines import STATES, _SUBJECTS, _WAITS
from skein.operators.linking import subject

_OUT = "trace_id string, g bigint, events bigint, late bigint, ended boolean, " + ", ".join(f"{s}_time bigint" for s in STATES)
_STATE = "kind int, since bigint, last bigint, last_offset bigint, events bigint, late bigint, ended boolean, " + ", ".join(f"{s} bigint" for s in STATES) + ", waiting array<struct<ord:bigint,rec_offset:bigint,type_id:int,ts:bigint,at:bigint>>"
_NONE = -1


def _opens(kind: int) -> int:
    """Which of ``STATES`` an event opens."""
    if kind in STARTS:
        return 0
    if kind in _WAITS:
        return 1
    if kind == ID["GoBlockNet"]:
        return 2
    if kind in SYNC_BLOCKS:
        return 3
    return 4 if kind == ID["GoSysBlock"] else _NONE


def _fits(open_: int, kind: int) -> bool:
    """Whether an event of this type ends the open interval so that it counts."""
    if kind in ENDS:
        return True
    return kind in (STOPS, STARTS, (ID["GoUnblock"],), (ID["GoUnblock"],), (ID["GoSysExit"],))[open_]


class _Times:
    """What is settled of a goroutine."""

    def __init__(self, held: list):
        self.open, self.since, self.last, self.last_offset, self.events, self.late, self.ended = held[:7]
        self.sums = list(held[7 : 7 + len(STATES)])

    def take(self, ord_: int, offset: int, kind: int, ts: int) -> None:
        if self.open != _NONE and _fits(self.open, kind):
            self.sums[self.open] += ts - self.since
        self.open, self.since, self.last, self.last_offset = _opens(kind), ts, ord_, offset
        self.events, self.ended = self.events + 1, kind in ENDS

    def values(self) -> list:
        return [self.open, self.since, self.last, self.last_offset, self.events, self.late, self.ended, *self.sums]


def _fold(delay_ms: int):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [_NONE, 0, -1, -1, 0, 0, False, *[0] * len(STATES), []]
        settled, waiting = _Times(held), {(r[0], r[1]): tuple(r) for r in held[-1]}
        passed = state.getCurrentWatermarkMs()
        for rows in frames:
            for row in zip(*(rows[c].tolist() for c in ("ord", "rec_offset", "type_id", "ts", "at"))):
                if row[:2] <= (settled.last, settled.last_offset):
                    settled.late += row[:2] != (settled.last, settled.last_offset)
                else:
                    waiting.setdefault(row[:2], row)
        order = sorted(waiting.values())
        done = 0
        while done < len(order) and order[done][4] <= passed:
            settled.take(*order[done][:4])
            done += 1
        order = order[done:]
        whole = _Times(settled.values())
        for row in order:
            whole.take(*row[:4])
        if state.hasTimedOut and not order and settled.ended:
            state.remove()
        else:
            state.update((*settled.values(), order))
            newest = max([row[4] for row in order], default=passed)
            state.setTimeoutTimestamp(max(newest, passed) + delay_ms + 1)
        if not state.hasTimedOut:
            yield pd.DataFrame([(*key, whole.events, whole.late, whole.ended, *whole.sums)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return fold


def state_times(events: DataFrame, delay: str = "1 day", arrival: str = "loaded_at") -> DataFrame:
    """A stream of ``trace_id, g, events, late, ended, exec_time, sched_wait_time, io_time, block_time, syscall_time``: each goroutine that a batch touched.

    Only closed intervals count; repeated rows of an event are one. Needs ``trace_id, rec_offset, ord, type_id, ts, g, a0`` and the time of
    ``arrival``; rows that lack one of them but ``g`` or ``a0``, or a goroutine, are left out.
    """
    spark = events.sparkSession
    delay_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {delay}) AS ms").first().ms)
    at = F.col(arrival).cast("timestamp")
    rows = events.where(F.col("type_id").isin(*_SUBJECTS)).select("trace_id", "rec_offset", "ord", "type_id", "ts", subject(F.col("type_id"), F.col("g"), F.col("a0")).alias("g"), at.alias("_at")).dropna()
    timed = rows.withWatermark("_at", delay).withColumn("at", F.unix_millis("_at"))
    return timed.groupBy("trace_id", "g").applyInPandasWithState(_fold(delay_ms), _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def type_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events per type and window of ``loaded_at``; a window closes once the watermark, ``delay`` behind the newest row, has passed it."""
    timed = events.withColumn("_at", F.col("loaded_at").cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", window).alias("window"), "type_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type_id", "n")
