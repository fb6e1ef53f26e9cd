"""Minimum mutator utilisation, worst windows and quantiles of the windowed utilisation.

The mean over a sliding window is piecewise linear in the window's start, with knots only where an edge of the window
meets a change of the series. So the knots are listed, the mean is taken at each from the integral of the series, and
minimum, worst windows and distribution follow exactly; nothing is searched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skein.functions.tables import durable
from skein.functions.stepfn import as_of, prefix_integral
from skein.functions.windows import TIME_BITS

NEAR = 1e-5
_KEYS = ["trace_id", "series"]


def windowed(series: DataFrame, windows: Sequence[int]) -> DataFrame:
    """``trace_id, series, window, time, util``: the mean utilisation of each window at every knot of its start.

    ``window`` is the wanted length; a longer one than the series is cut to it. Lengths of 0 or less and series without duration
    give no rows.
    """
    summed = durable(prefix_integral(series.select(*_KEYS, "time", "util"), _KEYS, "time", "util", TIME_BITS))  # read four times
    bounds = summed.groupBy(*_KEYS).agg(F.min("time").alias("_t0"), F.max("time").alias("_t1")).where("_t1 > _t0")
    lengths = F.array(*(F.lit(int(w)).cast("bigint") for w in windows if w > 0)) if any(w > 0 for w in windows) else F.array().cast("array<bigint>")
    spans = bounds.select(*_KEYS, "_t0", "_t1", F.explode(lengths).alias("window")).withColumn("_w", F.least("window", F.col("_t1") - F.col("_t0")))
    knots = summed.select(*_KEYS, "time").join(spans, _KEYS).select(*_KEYS, "window", "_w", "_t0", "_t1", F.explode(F.array(F.col("time"), F.col("time") - F.col("_w"), F.col("_t0"), F.col("_t1") - F.col("_w"))).alias("time"))
    knots = knots.where("time >= _t0 and time <= _t1 - _w").select(*_KEYS, "window", "_w", "time").distinct()
    at = F.struct(F.col("time").alias("t"), F.col("util").alias("u"), F.col("area").alias("a"))
    low = as_of(summed, knots, _KEYS, "time", at, "_lo", bits=TIME_BITS)
    low = low.withColumn("_f0", F.col("_lo.a") + F.col("_lo.u") * (F.col("time") - F.col("_lo.t"))).drop("_lo").withColumnRenamed("time", "_start")
    high = as_of(summed, low.withColumn("time", F.col("_start") + F.col("_w")), _KEYS, "time", at, "_hi", bits=TIME_BITS)
    f1 = F.col("_hi.a") + F.col("_hi.u") * (F.col("time") - F.col("_hi.t"))
    return high.select(*_KEYS, "window", F.col("_start").alias("time"), ((f1 - F.col("_f0")) / F.col("_w")).alias("util"))


def mmu(series: DataFrame, windows: Sequence[int]) -> DataFrame:
    """``trace_id, window, mmu``: the least mean utilisation over all windows of a length, of all series of a trace; 0 for lengths of 0 or less."""
    found = windowed(series, windows).groupBy("trace_id", "window").agg(F.min("util").alias("mmu"))
    none = [int(w) for w in windows if w <= 0]
    if none:
        zero = series.select("trace_id").distinct().select("trace_id", F.explode(F.array(*(F.lit(w).cast("bigint") for w in none))).alias("window"), F.lit(0.0).alias("mmu"))
        found = found.unionByName(zero)
    return found


def worst_windows(series: DataFrame, window: int, n: int) -> DataFrame:
    """``trace_id, series, window, time, util``: per trace ``n`` windows of least utilisation that do not overlap in their series.

    Knots are taken in ascending order of utilisation (to nine digits), then time, then series, skipping those that overlap one taken
    before. Windows that only touch do not overlap. Each of the ``n`` is the least of what is left, by one aggregation over all
    knots, so no task sorts a trace.
    """
    means = durable(windowed(series, [window]).select("trace_id", F.col("series").cast("int").alias("series"), "window", "time", "util"))
    taken = means.where("false")
    for _ in range(n):
        t = taken.select(F.col("trace_id").alias("_t"), F.col("series").alias("_s"), F.col("time").alias("_at"))
        free = means.join(t, (means.trace_id == t._t) & (means.series == t._s) & (F.abs(means.time - t._at) < means.window), "left_anti")
        least = F.min(F.struct(F.round("util", 9).alias("_u"), "time", "series", "window", "util")).alias("_x")
        best = durable(free.groupBy("trace_id").agg(least).select("trace_id", "_x.series", "_x.window", "_x.time", "_x.util"))
        if best.isEmpty():
            break
        taken = taken.unionByName(best)
    return taken


def mud(series: DataFrame, window: int, quantiles: Sequence[float], compat: bool = False) -> DataFrame:
    """``trace_id, q, util``: quantiles of the distribution of the windowed utilisation over time.

    Between two knots the mean is spread evenly over its two values, or sits at one where they differ by less than 1e-5. The mass
    is the time for which windows begin. A trace that is not longer than the window has its minimum utilisation throughout, as
    has every trace with ``compat``.
    """
    means = durable(windowed(series, [window]))
    nxt = Window.partitionBy(*_KEYS).orderBy("time")
    parts = means.withColumn("_u2", F.lead("util").over(nxt)).withColumn("_dt", F.lead("time").over(nxt) - F.col("time")).where("_dt > 0")
    lo, hi = F.least("util", "_u2"), F.greatest("util", "_u2")
    flat = hi - lo < NEAR
    none = F.lit(0.0)
    dt = F.col("_dt").cast("double")
    edges = parts.select("trace_id", F.explode(F.when(flat, F.array(F.struct(lo.alias("x"), none.alias("delta"), dt.alias("dirac")))).otherwise(F.array(F.struct(lo.alias("x"), (dt / (hi - lo)).alias("delta"), none.alias("dirac")), F.struct(hi.alias("x"), (-dt / (hi - lo)).alias("delta"), none.alias("dirac"))))).alias("e"))
    edges = edges.groupBy("trace_id", F.col("e.x").alias("x")).agg(F.sum("e.delta").alias("delta"), F.sum("e.dirac").alias("dirac"))
    w = Window.partitionBy("trace_id").orderBy("x")
    run = edges.withColumn("_rate", F.coalesce(F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, -1)), none)).withColumn("_gap", F.coalesce(F.col("x") - F.lag("x").over(w), none))
    run = run.withColumn("_grown", F.sum(F.col("_rate") * F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_jump", F.coalesce(F.sum("dirac").over(w.rowsBetween(Window.unboundedPreceding, -1)), none))
    run = run.withColumn("_cum", F.col("_grown") + F.col("_jump"))  # mass up to x, without what sits at x
    least = means.groupBy("trace_id").agg(F.min("util").alias("mmu"))
    if window <= 0:
        least = mmu(series, [window]).select("trace_id", "mmu")
    if not quantiles:
        return least.where("false").select("trace_id", F.lit(0.0).alias("q"), F.col("mmu").alias("util"))
    mass = parts.groupBy("trace_id").agg(F.sum("_dt").cast("double").alias("_mass"))
    asked = mass.select("trace_id", "_mass", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q")).withColumn("_y", F.col("_mass") * F.col("q"))
    reach = run.join(asked, "trace_id").where(F.col("_cum") + F.col("dirac") >= F.col("_y") * (1 - 1e-12))
    first = reach.groupBy("trace_id", "q").agg(F.min_by(F.struct("x", "_cum", "_rate", "_y"), "x").alias("f"))
    back = F.when((F.col("f._cum") > F.col("f._y")) & (F.col("f._rate") > 1e-9), F.col("f.x") - (F.col("f._cum") - F.col("f._y")) / F.col("f._rate")).otherwise(F.col("f.x"))
    every = least.select("trace_id", "mmu", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q"))
    value = F.col("mmu") if compat else F.coalesce(back, "mmu")
    return every.join(first, ["trace_id", "q"], "left").select("trace_id", "q", value.alias("util"))
