"""Running windows, plain or cut into blocks of the order so that no task holds a whole group.

Plain windows take one shuffle and one sort, which spills. Where a group may hold a large share of all rows, ``bits`` cuts it
into blocks of ``2**bits`` of the (integer) first column of the order. Each block is one window partition, and a table
with one row per group and block, made by aggregation on the map side, carries on what passes from block to block.
The input is then read twice, so it should be a stored table or little more than a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

EVENT_BITS = 16  # blocks of so many bits of the order of events
OFFSET_BITS = 20  # of offsets in a file, of which an event takes about ten
TIME_BITS = 24  # of nanoseconds

def _cut(df: DataFrame, order: Sequence[str], bits: int) -> DataFrame:
    return df.withColumn("_wblock", F.shiftright(F.col(order[0]).cast("bigint"), bits))


def lead_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, bits: int | None = None) -> DataFrame:
    """``df`` with ``name``: ``value`` of the next row of the same keys, null for the last. With ``bits`` keys are not null."""
    if bits is None:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    cut = _cut(df, order, bits).withColumn("_wv", value)
    here = Window.partitionBy(*keys, "_wblock").orderBy(*order)
    firsts = cut.groupBy(*keys, "_wblock").agg(F.min_by("_wv", F.struct(*order)).alias("_wfirst"))
    after = firsts.select(*keys, "_wblock", F.lead("_wfirst").over(Window.partitionBy(*keys).orderBy("_wblock")).alias("_wafter"))
    inner = cut.withColumn("_wlast", F.lead(F.lit(True)).over(here).isNull()).withColumn("_win", F.lead("_wv").over(here))
    joined = inner.join(after, [*keys, "_wblock"], "left")
    return joined.withColumn(name, F.when(F.col("_wlast"), F.col("_wafter")).otherwise(F.col("_win"))).drop("_wblock", "_wv", "_wlast", "_win", "_wafter")


def last_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = False, bits: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last value that is not null among the rows before (or up to) each row of the same keys."""
    frame = Window.unboundedPreceding, 0 if inclusive else -1
    if bits is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    cut = _cut(df, order, bits).withColumn("_wv", value)
    lasts = cut.groupBy(*keys, "_wblock").agg(F.max_by("_wv", F.when(F.col("_wv").isNotNull(), F.struct(*order))).alias("_wlast"))
    before = Window.partitionBy(*keys).orderBy("_wblock").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_wblock", F.last("_wlast", ignorenulls=True).over(before).alias("_wcarried"))
    inner = cut.withColumn("_win", F.last("_wv", ignorenulls=True).over(Window.partitionBy(*keys, "_wblock").orderBy(*order).rowsBetween(*frame)))
    return inner.join(carried, [*keys, "_wblock"], "left").withColumn(name, F.coalesce("_win", "_wcarried")).drop("_wblock", "_wv", "_win", "_wcarried")


def sum_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = True, bits: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows up to (or before) each row of the same keys, 0 where there is none."""
    frame, zero = (Window.unboundedPreceding, 0 if inclusive else -1), F.lit(0)
    if bits is None:
        return df.withColumn(name, F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)), zero))
    cut = _cut(df, order, bits).withColumn("_wv", value)
    sums = cut.groupBy(*keys, "_wblock").agg(F.sum("_wv").alias("_wsum"))
    before = Window.partitionBy(*keys).orderBy("_wblock").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_wblock", F.sum("_wsum").over(before).alias("_wbase"))
    inner = cut.withColumn("_win", F.sum("_wv").over(Window.partitionBy(*keys, "_wblock").orderBy(*order).rowsBetween(*frame)))
    return inner.join(base, [*keys, "_wblock"], "left").withColumn(name, F.coalesce("_win", zero) + F.coalesce("_wbase", zero)).drop("_wblock", "_wv", "_win", "_wbase")


def min_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = True, bits: int | None = None) -> DataFrame:
    """``df`` with ``name``: the least ``value`` over the rows up to (or before) each row of the same keys, null where there is none."""
    frame = Window.unboundedPreceding, 0 if inclusive else -1
    if bits is None:
        return df.withColumn(name, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    cut = _cut(df, order, bits).withColumn("_wv", value)
    before = Window.partitionBy(*keys).orderBy("_wblock").rowsBetween(Window.unboundedPreceding, -1)
    least = cut.groupBy(*keys, "_wblock").agg(F.min("_wv").alias("_wmin")).select(*keys, "_wblock", F.min("_wmin").over(before).alias("_wleast"))
    inner = cut.withColumn("_win", F.min("_wv").over(Window.partitionBy(*keys, "_wblock").orderBy(*order).rowsBetween(*frame)))
    return inner.join(least, [*keys, "_wblock"], "left").withColumn(name, F.least("_win", "_wleast")).drop("_wblock", "_wv", "_win", "_wleast")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], bits: int) -> DataFrame:
    """``df`` with several running values in one pass over blocks, up to and with each row of the same keys.

    ``values`` gives for each new column ``sum`` (0 where there is nothing), or ``last`` (the last one that is not null, null where there is none)
    and what to take. ``before`` is ``last`` without the row itself.
    """
    cut = _cut(df, order, bits)
    place = F.struct(*order)
    names = {name: (kind, cut_name) for cut_name, (name, (kind, _)) in zip((f"_w{i}" for i in range(len(values))), values.items())}
    cut = cut.select("*", *(value.alias(names[name][1]) for name, (_, value) in values.items()))
    whole = {"sum": lambda c: F.sum(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)), "before": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    earlier = Window.partitionBy(*keys).orderBy("_wblock").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda kind, c: F.sum(c).over(earlier) if kind == "sum" else F.last(c, ignorenulls=True).over(earlier)
    blocks = cut.groupBy(*keys, "_wblock").agg(*(whole[kind](c).alias(c) for kind, c in names.values()))
    carried = blocks.select(*keys, "_wblock", *(ahead(kind, c).alias(f"{c}c") for kind, c in names.values()))
    here = Window.partitionBy(*keys, "_wblock").orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda kind, c: F.sum(c).over(upto) if kind == "sum" else F.last(c, ignorenulls=True).over(upto if kind == "last" else before)
    inner = cut.select("*", *(own(kind, c).alias(f"{c}i") for kind, c in names.values()))
    zero = F.lit(0)
    made = {name: F.coalesce(f"{c}i", zero) + F.coalesce(f"{c}c", zero) if kind == "sum" else F.coalesce(f"{c}i", f"{c}c") for name, (kind, c) in names.items()}
    return inner.join(carried, [*keys, "_wblock"], "left").select(*df.columns, *(c.alias(name) for name, c in made.items()))


def number_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, bits: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... along ``order`` within the same keys."""
    return sum_over(df, keys, order, F.lit(1).cast("bigint"), name, bits=bits)
