"""Joins of points with the spans of time that hold them, without pairing a key's points with all its spans.

Time is cut into blocks of several widths, each ``2**STEP`` times the last. A span is laid out with the fewest blocks, wide ones
inside and narrow ones at its ends; a point lies in one block of each width. Keys and blocks are then equal where a point
lies in a span, but for the narrowest blocks at a span's ends, which are checked. So the rows between are about as many
as those of the result. The widths follow from the spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STEP = 4
FINE = 5  # the narrowest blocks are 2**FINE to 2**(FINE + 1) times narrower than spans on average; 0 where there are more spans than points


def widths(spans: DataFrame, lo: str, hi: str, fine: int = FINE) -> list[int]:
    """Block widths in bits, ascending; the widest ones are about as wide as the longest span."""
    length = F.greatest(F.col(hi) - F.col(lo), F.lit(0)).cast("double")
    mean, most = spans.agg(F.avg(length), F.max(length)).first()
    first = max(0, int(mean or 0).bit_length() - 1 - fine)
    top = max(first, int(most or 0).bit_length() - 1)
    return list(range(first, top + STEP, STEP))


def _run(start: Column, stop: Column, level: int) -> Column:
    """The blocks from ``start`` to ``stop`` of one width, none where that is before."""
    empty = F.array().cast("array<struct<level:int,block:bigint>>")
    blocks = F.transform(F.sequence(start, F.greatest(start, stop)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))
    return F.when(start <= stop, blocks).otherwise(empty)


def _cover(lo: Column, hi: Column, bits: Sequence[int]) -> Column:
    """The blocks of a span: at each width what is left at both ends of the whole blocks of the next one."""
    parts = []
    first, last = F.shiftright(lo, bits[0]), F.shiftright(hi, bits[0])
    inside = lo <= hi
    for level in range(len(bits)):
        if level + 1 == len(bits):
            parts.append(F.when(inside, _run(first, last, level)))
            break
        upper, beyond = F.shiftright(first + ((1 << STEP) - 1), STEP), F.shiftright(last + 1, STEP)  # whole blocks of the next width: from, up to
        whole = upper < beyond
        left = _run(first, F.when(whole, F.shiftleft(upper, STEP) - 1).otherwise(last), level)
        right = F.when(whole, _run(F.shiftleft(beyond, STEP), last, level))
        parts += [F.when(inside, left), F.when(inside & whole, right)]
        first, last, inside = upper, beyond - 1, inside & whole
    empty = F.array().cast("array<struct<level:int,block:bigint>>")
    return F.concat(*(F.coalesce(p, empty) for p in parts))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, lo: str, hi: str, fine: int = FINE) -> DataFrame:
    """``points`` with each span of the same keys whose ``lo`` and ``hi`` hold ``time``, both included.

    Columns: those of ``points``, then those of ``spans`` without the keys; no other names may be shared. Rows with a null key or time, and
    spans that end before they start, give nothing. ``spans`` is read twice, for the widths first. Coarser blocks (a smaller ``fine``) lay spans
    out in fewer rows and let more points meet them that they do not hold, still about as many as they do.
    """
    bits = widths(spans, lo, hi, fine)
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(time, b).alias("block")) for i, b in enumerate(bits))))
    p = points.where(F.col(time).isNotNull()).select("*", blocks.alias("_b")).select(*points.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    s = spans.select("*", F.explode(_cover(F.col(lo), F.col(hi), bits)).alias("_b")).select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    rest = [c for c in spans.columns if c not in keys]
    return p.join(s, [*keys, "_level", "_block"]).where(F.col(time).between(F.col(lo), F.col(hi))).select(*points.columns, *rest)
