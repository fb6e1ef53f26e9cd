"""User tasks: life, hierarchy, regions, overlaps with events, related goroutines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skein.functions.catalog import GC_P, ID
from skein.functions.scalars import overlap
from skein.functions.spans import points_in_spans
from skein.functions.tables import durable
from skein.operators.events import world
from skein.operators.hierarchy import all_descendants as hierarchy_descendants, closure, hierarchy

ANNOTATIONS = [ID["UserLog"], ID["UserRegion"], ID["UserTaskCreate"], ID["UserTaskEnd"]]


def task_events(ev: DataFrame) -> DataFrame:
    """Events that belong to a task themselves: creations, ends and logs."""
    return ev.where(F.col("type_id").isin(ID["UserTaskCreate"], ID["UserTaskEnd"], ID["UserLog"]) & F.col("a0").isNotNull()).withColumn("task_id", F.col("a0"))


def tasks(ev: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row per task: ``trace_id, task_id, name, parent_id, create_ts, end_ts, completed, first_ts, last_ts, end_or_world_ts, duration, goroutines, children, last_offset``.

    A task is there if an event, a region or a child's creation names it; one known only by name has an empty name. The
    last of several creations or ends counts. ``first_ts`` and ``end_or_world_ts`` fall back to the trace's bounds, ``last_ts`` to
    the end; ``last_offset`` is its own last event. ``goroutines`` and ``children`` are ascending.
    """
    own = task_events(ev)
    order = F.struct("ord", "rec_offset")
    made, done = F.col("type_id") == ID["UserTaskCreate"], F.col("type_id") == ID["UserTaskEnd"]
    facts = own.groupBy("trace_id", "task_id").agg(
        F.max_by(F.when(made, F.struct(F.try_element_at("string_args", F.lit(1)).alias("name"), F.nullif(F.col("a1"), F.lit(0)).alias("parent_id"), "ts")), F.when(made, order)).alias("_c"),
        F.max_by(F.when(done, F.col("ts")), F.when(done, order)).alias("end_ts"),
        F.max_by(F.struct("ts", "rec_offset"), order).alias("_last"),
        F.collect_set("g").alias("_gs"),
    )
    edges = own.where(made & F.col("a1").isNotNull() & (F.col("a1") != 0)).select("trace_id", F.col("a1").alias("task_id"), F.col("a0").alias("child"))
    children = edges.groupBy("trace_id", "task_id").agg(F.array_sort(F.collect_set("child")).alias("children"))
    out = facts.join(children, ["trace_id", "task_id"], "full")
    empty = F.array().cast("array<bigint>")
    if regions is not None:
        by_region = regions.where("task_id is not null and task_id <> 0").groupBy("trace_id", "task_id").agg(F.collect_set("g").alias("_rg"))
        out = out.join(by_region, ["trace_id", "task_id"], "full")
    else:
        out = out.withColumn("_rg", empty)
    out = out.join(world(ev), "trace_id")
    first = F.coalesce("_c.ts", "world_start")
    end = F.coalesce("end_ts", "world_end")
    return out.select(
        "trace_id", "task_id", F.coalesce("_c.name", F.lit("")).alias("name"), F.col("_c.parent_id").alias("parent_id"), F.col("_c.ts").alias("create_ts"), "end_ts",
        (F.col("_c.ts").isNotNull() & F.col("end_ts").isNotNull()).alias("completed"), first.alias("first_ts"), F.coalesce("_last.ts", end).alias("last_ts"), end.alias("end_or_world_ts"), (end - first).alias("duration"),
        F.array_sort(F.array_union(F.coalesce("_gs", empty), F.coalesce("_rg", empty))).alias("goroutines"), F.coalesce("children", empty).alias("children"), F.col("_last.rec_offset").alias("last_offset"),
    )


def _bounded(regions: DataFrame, ev: DataFrame) -> DataFrame:
    """Regions of tasks with ``from_ts`` and ``to_ts``, open ends at the trace's bounds."""
    own = regions.where("task_id is not null and task_id <> 0").join(world(ev), "trace_id")
    return own.withColumn("from_ts", F.coalesce("start_ts", "world_start")).withColumn("to_ts", F.coalesce("end_ts", "world_end")).drop("world_start", "world_end")


def task_regions(regions: DataFrame, ev: DataFrame) -> DataFrame:
    """Regions of tasks with ``from_ts`` and ``to_ts`` (open ends at the trace's bounds) and their ``place`` in the task's order."""
    place = F.row_number().over(Window.partitionBy("trace_id", "task_id").orderBy("from_ts", "to_ts", F.coalesce("start_offset", F.lit(-1)), F.coalesce("end_offset", F.lit(-1))))
    return _bounded(regions, ev).withColumn("place", place)


def descendants(task_table: DataFrame) -> DataFrame:
    """``trace_id, ancestor_id, task_id, distance``: each task with all its descendants, itself at distance 0; none for tasks on or below a cycle (:func:`all_descendants` has them)."""
    return closure(hierarchy(task_table.select("trace_id", "task_id", "parent_id")))


def all_descendants(task_table: DataFrame) -> DataFrame:
    """``descendants`` with those of tasks on and below cycles."""
    return hierarchy_descendants(durable(task_table.select("trace_id", "task_id", "parent_id")))


def overlapping_instants(ev: DataFrame, task_table: DataFrame, regions: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, task_id``: events that happen during a task.

    User annotations count for their own task only. Collector events count while a task lives; other events must fall into a
    region of the task on the same goroutine, closed at both ends.
    """
    lives = durable(task_table.select("trace_id", "task_id", "first_ts", "end_or_world_ts"))
    spans = _bounded(regions, ev).select("trace_id", "g", "task_id", "from_ts", "to_ts").join(lives, ["trace_id", "task_id"])
    spans = spans.select("trace_id", "g", "task_id", F.greatest("from_ts", "first_ts").alias("_from"), F.least("to_ts", "end_or_world_ts").alias("_to")).where("_from <= _to")
    mine = ~F.col("type_id").isin(*ANNOTATIONS) | (F.col("a0") == F.col("task_id"))
    narrow = ev.select("trace_id", "rec_offset", "g", "p", "ts", "type_id", "a0")
    local = points_in_spans(narrow.where((F.col("p") != GC_P) | F.col("p").isNull()), durable(spans), ["trace_id", "g"], "ts", "_from", "_to")
    local = local.where(mine).select("trace_id", "rec_offset", "task_id").distinct()
    collector = points_in_spans(narrow.where(F.col("p") == GC_P), lives, ["trace_id"], "ts", "first_ts", "end_or_world_ts").where(mine)
    return local.unionByName(collector.select("trace_id", "rec_offset", "task_id"))


def _meeting(events: DataFrame, spans: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """``events`` (``ts`` to ``link_ts``) with the ``spans`` of the same keys that share time with them: those that start during the event, and those during which it starts."""
    starting = points_in_spans(spans, events.withColumn("_last", F.col("link_ts") - 1), keys, lo, "ts", "_last", fine=0)
    inner = spans.withColumn("_after", F.col(lo) + 1).withColumn("_before", F.col(hi) - 1)
    running = points_in_spans(events, inner, keys, "ts", "_after", "_before")
    return running.drop("_after", "_before").unionByName(starting.drop("_last"))


def overlapping_durations(ev: DataFrame, task_table: DataFrame, regions: DataFrame, links: DataFrame) -> DataFrame:
    """``trace_id, rec_offset, task_id, overlap``: for how long events that last overlap with a task, where that is above 0.

    An event lasts to the event that closes it; ``links`` has at most one row per event. It overlaps with the task's regions on its own or
    its link's goroutine, taken in order; a region that starts before the end of the last one counted is skipped. Collector
    events overlap with the task's life.
    """
    spans = durable(_bounded(regions, ev).select("trace_id", "task_id", F.col("g").alias("_rg"), "from_ts", "to_ts", F.coalesce("start_offset", F.lit(-1)).alias("_so"), F.coalesce("end_offset", F.lit(-1)).alias("_eo")))
    lives = durable(task_table.select("trace_id", "task_id", "first_ts", "end_or_world_ts"))
    lasting = durable(ev.select("trace_id", "rec_offset", "g", "p", "ts").join(links.select("trace_id", "rec_offset", "link_ts", "link_g"), ["trace_id", "rec_offset"]).where("ts <= link_ts"))
    collector = _meeting(lasting.where(F.col("p") == GC_P).select("trace_id", "rec_offset", "ts", "link_ts"), lives, ["trace_id"], "first_ts", "end_or_world_ts")
    collector = collector.select("trace_id", "rec_offset", "task_id", overlap(F.col("first_ts"), F.col("end_or_world_ts"), F.col("ts"), F.col("link_ts")).alias("overlap"))
    local = lasting.where((F.col("p") != GC_P) | F.col("p").isNull())
    owners = F.array_distinct(F.filter(F.array("g", F.coalesce("link_g", "g")), lambda x: x.isNotNull()))
    each = local.select("trace_id", "rec_offset", "ts", "link_ts", F.explode(owners).alias("_rg"))
    hit = _meeting(each, spans, ["trace_id", "_rg"], "from_ts", "to_ts")
    hit = hit.withColumn("_o", overlap(F.col("from_ts"), F.col("to_ts"), F.col("ts"), F.col("link_ts"))).where("_o > 0")
    listed = hit.groupBy("trace_id", "rec_offset", "task_id").agg(F.array_sort(F.collect_list(F.struct("from_ts", "to_ts", "_so", "_eo", "_o"))).alias("_l"))
    start = F.struct(F.lit(0).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("last"))
    step = lambda acc, x: F.when(x["from_ts"] < acc["last"], acc).otherwise(F.struct((acc["o"] + x["_o"]).alias("o"), x["to_ts"].alias("last")))
    summed = listed.select("trace_id", "rec_offset", "task_id", F.aggregate("_l", start, step, lambda acc: acc["o"]).alias("overlap"))
    return summed.unionByName(collector).where("overlap > 0")


def related_goroutines(ev: DataFrame, task_table: DataFrame, depth: int) -> DataFrame:
    """``trace_id, task_id, g``: the task's goroutines and, per level of ``depth``, those that unblocked one of them while it lived."""
    lives = task_table.select("trace_id", "task_id", "first_ts", "end_or_world_ts")
    found = durable(task_table.select("trace_id", "task_id", F.explode("goroutines").alias("g")).where("g is not null").distinct())
    wakes = durable(ev.where((F.col("type_id") == ID["GoUnblock"]) & F.col("g").isNotNull()).select("trace_id", F.col("a0").alias("_woken"), F.col("g").alias("_by"), "ts"))
    front = found
    for _ in range(depth):
        seeds = durable(front.select("trace_id", "task_id", F.col("g").alias("_woken")).join(lives, ["trace_id", "task_id"]))
        more = points_in_spans(wakes, seeds, ["trace_id", "_woken"], "ts", "first_ts", "end_or_world_ts", fine=0).select("trace_id", "task_id", F.col("_by").alias("g")).distinct()
        front = durable(more.join(found, ["trace_id", "task_id", "g"], "left_anti"))
        found = found.unionByName(front)
    return found
