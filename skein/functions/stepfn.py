"""Step functions as tables of change points, their integrals, and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.tables import durable
from skein.functions.windows import last_over, sum_over


def as_of(points: DataFrame, probes: DataFrame, keys: Sequence[str], time: str, value: Column, name: str, strict: bool = False, bits: int | None = None) -> DataFrame:
    """``probes`` with ``name``: ``value`` of the last point of the same keys at or before (``strict``: before) the probe's ``time``.

    Both sides are merged into one running window, cut into blocks of the time with ``bits``; there is no join on a range. Probes with a null key or time get null.
    """
    probes = durable(probes) if bits is not None else probes  # read twice, as are the points
    first = 1 if strict else 0  # points before probes of the same time, or after
    p = points.select(*keys, F.col(time), value.alias("_value"), F.lit(first).alias("_side"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns if c not in (*keys, time)))
    q = probes.select("*", F.lit(1 - first).alias("_side"))
    merged = p.unionByName(q, allowMissingColumns=True)
    got = last_over(merged, keys, [time, "_side"], F.when(F.col("_side") == first, F.col("_value")), name, bits=bits)
    return got.where(F.col("_side") == 1 - first).drop("_side", "_value")


def prefix_integral(points: DataFrame, keys: Sequence[str], time: str, value: str, bits: int | None = None) -> DataFrame:
    """``points`` with ``area``: the integral of the step function from its first point to each point."""
    points = points if bits is None else durable(points)
    was = last_over(points, keys, [time], F.struct(F.col(value).alias("v"), F.col(time).alias("t")), "_was", bits=bits)
    return sum_over(was, keys, [time], F.col("_was.v") * (F.col(time) - F.col("_was.t")), "area", bits=bits).drop("_was")


def integral_at(points: DataFrame, probes: DataFrame, keys: Sequence[str], time: str, value: str, name: str, bits: int | None = None) -> DataFrame:
    """``probes`` with ``name``: the integral of each key's step function up to the probe's ``time``; 0 before the first point.

    Points of a key have distinct times; the last value holds on.
    """
    summed = prefix_integral(points.select(*keys, time, value), keys, time, value, bits)
    got = as_of(summed, probes, keys, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col("area").alias("a")), "_p", bits=bits)
    return got.withColumn(name, F.coalesce(F.col("_p.a") + F.col("_p.v") * (F.col(time) - F.col("_p.t")), F.lit(0))).drop("_p")


def change_points(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Only the points whose value differs by ``tolerance`` or more from the point before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    far = F.abs(F.col(value) - F.col("_before"))
    return points.withColumn("_before", before).where(F.col("_before").isNull() | (far >= tolerance if tolerance else far != 0)).drop("_before")
