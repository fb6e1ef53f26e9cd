"""References to records that are missing, deleted or loaded later.

All references of all fields are reduced to distinct foreign keys per (trace, table), combined on the map side, and
held against the parents' keys, reduced likewise. Only keys that fail for some event go on. They are stored, so that their
size is known when they are joined back to the references: few enough ones meet them in the map tasks, and only
references that lead nowhere are shuffled. A key that most events name costs one row in the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skein.functions.tables import durable

#: The table that an event's argument refers to, by the argument's name in the catalogue.
TARGETS = {"g": "goroutines", "stack": "stacks", "taskid": "tasks", "pid": "tasks", "typeid": "strings", "labelid": "strings", "keyid": "strings"}
USER_LOG = 48  # its argument "id" names a task
KEYS = {"goroutines": "g", "stacks": "stack_id", "tasks": "task_id", "strings": "string_id", "trace_events": "rec_offset"}


def references(events: DataFrame, event_types: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, loaded_at, field, target, key``: one row per row of ``events`` and reference in it.

    0 and null refer to nothing, nor do arguments whose name is no reference or whose type is unknown. Rows without trace_id or
    rec_offset are no events and are left out.
    """
    kinds: dict[int, dict[int, str]] = {0: {}, 1: {}, 2: {}}
    for r in event_types.select("type_id", "args").collect():  # the fixed catalogue
        for i, name in enumerate((r.args or [])[:3]):
            target = "tasks" if (r.type_id, name) == (USER_LOG, "id") else TARGETS.get(name)
            if target and r.type_id is not None:
                kinds[i][r.type_id] = target

    def named(i: int):
        by: dict[str, list[int]] = {}
        for type_id, target in kinds[i].items():
            by.setdefault(target, []).append(type_id)
        return reduce(lambda c, x: F.when(F.col("type_id").isin(*sorted(x[1])), F.lit(x[0])).otherwise(c), sorted(by.items()), F.lit(None).cast("string"))

    def one(field: str, target) -> F.Column:
        return F.struct(F.lit(field).alias("field"), target.alias("target"), F.col(field).alias("key"))

    every = F.array(one("stack_id", F.lit("stacks")), one("link_offset", F.lit("trace_events")), *(one(f"a{i}", named(i)) for i in range(3)))
    held = F.filter(every, lambda x: x["target"].isNotNull() & (x["key"] != 0))
    keyed = events.where("trace_id is not null and rec_offset is not null")
    return keyed.select("trace_id", "rec_offset", "loaded_at", F.inline(held))


def parents(tables: dict[str, DataFrame]) -> DataFrame:
    """``trace_id, target, key, alive, since``: per parent key whether a row without ``deleted_at`` is there and its earliest load."""
    parts = []
    for name, df in tables.items():
        gone = F.col("deleted_at").isNotNull() if "deleted_at" in df.columns else F.lit(False)
        parts.append(df.select("trace_id", F.lit(name).alias("target"), F.col(KEYS[name]).alias("key"), (~gone).alias("_alive"), F.when(~gone, F.col("loaded_at")).alias("_since")))
    united = reduce(DataFrame.unionByName, parts).where("key is not null")
    return united.groupBy("trace_id", "target", "key").agg(F.max("_alive").alias("alive"), F.min("_since").alias("since"))


def orphan_references(events: DataFrame, event_types: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``trace_id, rec_offset, field, status, target, loaded_at``: each reference of an event that leads nowhere.

    One row per event, as keyed by (trace_id, rec_offset), and field; repeated rows of an event are one event with the
    earliest of their ``loaded_at``. ``status``: ``missing`` (the target has no row), ``deleted`` (all its rows have a
    ``deleted_at``), ``later`` (the earliest ``loaded_at`` among its rows without ``deleted_at`` is after the event's). A null
    ``loaded_at`` on either side is never later. ``tables`` holds the five target tables by name.
    """
    refs = references(events, event_types)
    key = ["trace_id", "target", "key"]
    foreign = refs.groupBy(*key).agg(F.min("loaded_at").alias("_first"))
    known = parents(tables)
    state = F.when(F.col("alive").isNull(), "missing").when(~F.col("alive"), "deleted").when(F.col("since") > F.col("_first"), "later")
    bad = durable(foreign.join(known, key, "left").select(*key, "since", state.alias("status")).where("status is not null"))
    hit = refs.join(bad, key).where("status <> 'later' or since > loaded_at")
    return hit.groupBy("trace_id", "rec_offset", "field").agg(F.max("status").alias("status"), F.max("target").alias("target"), F.min("loaded_at").alias("loaded_at"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """``target, day, status, n``: orphan references per table they should lead to and day of the event's loading."""
    return orphans.groupBy("target", F.to_date("loaded_at").alias("day"), "status").agg(F.count(F.lit(1)).alias("n"))
