"""Per-key results where a few keys hold most rows.

Every state here is algebraic (count, minimum, maximum, sum), so the hash tables Spark keeps in each map task
combine all rows of a key before anything is shuffled. Those tables are bounded by the task's memory and spill by
sorting. A key with a third of all rows therefore sends one small partial state per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def combine_by_key(df: DataFrame, keys: Sequence[str], states: Sequence[Column]) -> DataFrame:
    """One row per distinct ``keys`` (null is a key like any other) with the algebraic aggregates ``states``."""
    return df.groupBy(*keys).agg(*states)


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, key_id, n``: how many rows hold each value of each of the integer ``columns``.

    All columns are counted in one scan by grouping sets. Null counts as a value; an empty table gives no row.
    """
    wide = df.select(*(F.col(c).cast("bigint").alias(f"_k{i}") for i, c in enumerate(columns)))
    names = wide.columns
    counted = wide.groupingSets([[c] for c in names], *names).agg(
        F.grouping_id(*names).alias("_set"), F.count(F.lit(1)).alias("n")
    )
    every = (1 << len(names)) - 1
    field, key = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, (c, name) in enumerate(zip(columns, names)):
        here = F.col("_set") == (every ^ (1 << (len(names) - 1 - i)))
        field = F.when(here, F.lit(c)).otherwise(field)
        key = F.when(here, F.col(name)).otherwise(key)
    return counted.select(field.alias("field"), key.alias("key_id"), "n")


def heavy_keys(df: DataFrame, columns: Sequence[str], per: int = 50) -> DataFrame:
    """``field, key_id``: the values, not null, that at least one in ``per`` of all rows hold in that column.

    Repeated rows count, and rows where the column is null count in the total.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        key_counts(df, columns)
        .where(F.col("key_id").isNotNull() & (F.col("n") * per >= total))
        .select("field", "key_id")
    )


def load_by_key(events: DataFrame, *keys: str) -> DataFrame:
    """Load of each value of ``keys`` together (null included) over an event table: events, span, links and their total time.

    Columns: the keys, ``events``, ``first_ts``, ``last_ts``, ``linked`` (events with a link) and ``link_time`` (sum of
    ``link_ts - ts``, null where no event has both). Repeated rows count as often as they stand. A goroutine or processor is
    known only together with its trace.
    """
    return combine_by_key(
        events.select(*keys, "ts", "link_ts"),
        keys,
        [
            F.count(F.lit(1)).alias("events"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count("link_ts").alias("linked"),
            F.sum(F.col("link_ts") - F.col("ts")).alias("link_time"),
        ],
    )
