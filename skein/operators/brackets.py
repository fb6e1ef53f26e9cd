"""Matching of opening and closing events by running depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.tables import durable
from skein.functions.windows import EVENT_BITS, lead_over, min_over, sum_over


def match(rows: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """``rows`` with ``depth``, ``level``, ``stray`` and ``other``.

    ``opens`` says whether a row opens (true) or closes (false) a bracket. ``depth`` is the depth after the row, never below 0. A
    closing row with nothing open is ``stray``. ``other`` is a struct of the ``order`` columns of an opening row's partner, null
    where it stays open and for closing rows. A closing row ends the inner-most open one. The first column of ``order`` is the order of
    events, which is cut into blocks; keys are not null.
    """
    run = sum_over(rows.withColumn("_open", opens), keys, order, F.when(F.col("_open"), 1).otherwise(-1), "_s", bits=EVENT_BITS)
    run = min_over(durable(run), keys, order, F.col("_s"), "_low", inclusive=False, bits=EVENT_BITS)
    was = F.least(F.lit(0), "_low")  # nulls do not count
    run = run.withColumn("depth", (F.col("_s") - F.least(was, "_s")).cast("int")).withColumn("stray", ~F.col("_open") & (F.col("_s") < was))
    run = run.withColumn("level", F.when(F.col("_open"), F.col("depth")).otherwise(F.col("depth") + 1))
    nxt = lead_over(run, [*keys, "stray", "level"], order, F.struct("_open", *order), "_n", bits=EVENT_BITS)
    return nxt.withColumn("other", F.when(F.col("_open") & ~F.col("_n._open"), F.struct(*(F.col(f"_n.{c}").alias(c) for c in order)))).drop("_n", "_s", "_open", "_low")
