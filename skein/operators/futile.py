"""Removal of futile wake-ups: a goroutine that is woken only to block again at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions.catalog import ID
from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, sum_over

_WAKE = ID["GoUnblock"]
_MARK = ID["FutileWakeup"]
_INNER = [ID["GoStart"], ID["GoPreempt"], _MARK]
_CLOSE = [ID[x] for x in ("GoBlock", "GoBlockRecv", "GoBlockSelect", "GoBlockSync", "GoBlockCond")]


def futile_marks(ev: DataFrame) -> DataFrame:
    """``trace_id, rec_offset``: the events of futile episodes.

    Per goroutine an unblock begins an episode, starts, preemptions and FutileWakeup marks go on, and a block ends it. If the
    last of the marks, starts and preemptions since the block before was FutileWakeup, the block and what the episode
    holds since the last unblock are futile. Blocks on send and labelled starts take no part.
    """
    kind = F.col("type_id")
    keys, order = ["trace_id", "_s"], ["ord", "rec_offset"]
    acted = ev.where(kind.isin(_WAKE, *_INNER, *_CLOSE)).select("trace_id", "rec_offset", "ord", "type_id", F.when(kind == _WAKE, F.col("a0")).otherwise(F.col("g")).alias("_s")).where("_s is not null")
    acted = sum_over(durable(acted), keys, order, kind.isin(*_CLOSE).cast("int"), "_block", inclusive=False, bits=EVENT_BITS)
    acted = sum_over(acted, [*keys, "_block"], order, (kind == _WAKE).cast("int"), "_wake", bits=EVENT_BITS)
    whole = acted.groupBy(*keys, "_block").agg(
        F.max_by((kind == _MARK), F.when(kind.isin(*_INNER), F.struct(*order))).alias("_futile"),
        F.max(F.when(kind.isin(*_CLOSE), F.lit(True))).alias("_closed"),
        F.max("_wake").alias("_last"),
    )
    hit = acted.join(whole.where("_futile and _closed"), [*keys, "_block"])
    return hit.where("_wake = _last").select("trace_id", "rec_offset")


def without_futile(ev: DataFrame) -> DataFrame:
    """``ev`` without the events of futile episodes."""
    return ev.join(futile_marks(ev), ["trace_id", "rec_offset"], "left_anti")
