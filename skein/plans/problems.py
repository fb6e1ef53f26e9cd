"""Queries of the core problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions.tables import durable, table
from skein.operators import features, heavy, hierarchy, intervals, quantiles, references

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "regions"), table(spark, d, "trace_events"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_features(table(spark, d, "trace_events"), table(spark, d, "event_types"))


def p2_features_text(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``p2_features`` with their arrays as text."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",", "-").alias(c)
    return p2_features(spark, d).select("trace_id", "g", text("n"), text("since_last"), text("link_time"))


def p2_feature_names(spark: SparkSession, d: str) -> DataFrame:
    return features.type_list(table(spark, d, "trace_events"), table(spark, d, "event_types"))


def p2_stats(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "trace_events")
    return features.with_recency(features.feature_stats(events.where("g is not null"), table(spark, d, "event_types")), events)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    targets = {name: table(spark, d, name) for name in references.KEYS}
    return references.orphan_references(table(spark, d, "trace_events"), table(spark, d, "event_types"), targets)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("trace_id", "rec_offset", "field", "status")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.endless(hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "tasks")), with_paths=False))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    solved = hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "tasks")))
    return solved.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "tasks"))))


def p4_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Those of tasks on and below cycles too."""
    return hierarchy.all_descendants(durable(hierarchy.parent_links(table(spark, d, "tasks"))))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """One duration per task: that of its newest row. Each row without a task_id is a task of its own."""
    rows = table(spark, d, "tasks")
    newest = F.max_by(F.struct("name", "duration"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "name", "duration"))
    tasks = rows.where("task_id is not null").groupBy("trace_id", "task_id").agg(newest.alias("_x"), F.max("loaded_at").alias("_at"))
    lone = rows.where("task_id is null").select("trace_id", F.to_date("loaded_at").alias("day"), "name", "duration")
    return tasks.select("trace_id", F.to_date("_at").alias("day"), "_x.name", "_x.duration").unionByName(lone)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.sketch(durable(_durations(spark, d)), ["name"], "duration"), ["name"], QUANTILES)


def p5_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch per name and day, added up."""
    days = quantiles.sketch(durable(_durations(spark, d)), ["name", "day"], "duration")
    return quantiles.percentiles(quantiles.merge(days, ["name"]), ["name"], QUANTILES)


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile is within its stated error by exact ranks, and that error at most 0.01."""
    rows = durable(_durations(spark, d))
    found = quantiles.percentiles(quantiles.sketch(rows, ["name"], "duration"), ["name"], QUANTILES)
    return quantiles.checked(rows, ["name"], "duration", found)


def p5_days_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same for percentiles of sketches added up over days."""
    rows = durable(_durations(spark, d))
    days = quantiles.merge(quantiles.sketch(rows, ["name", "day"], "duration"), ["name"])
    return quantiles.checked(rows, ["name"], "duration", quantiles.percentiles(days, ["name"], QUANTILES))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_keys(table(spark, d, "trace_events"), ["g", "p"])


def p6_by_goroutine(spark: SparkSession, d: str) -> DataFrame:
    return heavy.load_by_key(table(spark, d, "trace_events"), "g")


def p6_by_processor(spark: SparkSession, d: str) -> DataFrame:
    return heavy.load_by_key(table(spark, d, "trace_events"), "p")


def p6_by_trace_goroutine(spark: SparkSession, d: str) -> DataFrame:
    """Per goroutine, which its trace and g name together."""
    return heavy.load_by_key(table(spark, d, "trace_events"), "trace_id", "g")


def p6_by_trace_processor(spark: SparkSession, d: str) -> DataFrame:
    return heavy.load_by_key(table(spark, d, "trace_events"), "trace_id", "p")


QUERIES = {f.__name__: f for f in (p1_found, p2_features, p2_features_text, p2_feature_names, p2_stats, p3_found, p3_counts, p4_found, p4_hierarchy, p4_descendants, p4_all_descendants, p5_percentiles, p5_merged_days, p5_checked, p5_days_checked, p6_found, p6_by_goroutine, p6_by_processor, p6_by_trace_goroutine, p6_by_trace_processor)}

_LOAD = "SELECT {key}, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, count(link_ts) AS linked, CAST(sum(link_ts - ts) AS BIGINT) AS link_time FROM trace_events GROUP BY {key}"

_FEATURE = """
  CASE WHEN e.type_id IN (45, 47, 48) AND e.string_args[1] IS NOT NULL
       THEN coalesce(t.type, 'unknown:' || coalesce(CAST(e.type_id AS VARCHAR), 'null')) || ':' || e.string_args[1]
       ELSE coalesce(t.type, 'unknown:' || coalesce(CAST(e.type_id AS VARCHAR), 'null')) END"""

_STATS = f"""
WITH named AS (SELECT trace_id, g, rec_offset, {_FEATURE} AS feature, ts, link_ts FROM trace_events e LEFT JOIN event_types t USING (type_id)),
once AS (SELECT trace_id, g, rec_offset, feature, max(ts) AS ts, max(link_ts) AS link_ts FROM named WHERE g IS NOT NULL GROUP BY ALL),
stat AS (SELECT trace_id, g, feature, count(*) AS n, CAST(coalesce(sum(link_ts - ts), 0) AS BIGINT) AS link_time, max(ts) AS last FROM once GROUP BY trace_id, g, feature),
fin AS (SELECT trace_id, max(ts) AS fin FROM trace_events GROUP BY trace_id)
"""

_ORPHANS = """
WITH ev AS (
  SELECT trace_id, rec_offset, any_value(type_id) AS type_id, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2,
         any_value(stack_id) AS stack_id, any_value(link_offset) AS link_offset, min(loaded_at) AS loaded_at
  FROM trace_events GROUP BY trace_id, rec_offset),
arg AS (
  SELECT type_id, i, CASE WHEN name = 'g' THEN 'goroutines' WHEN name = 'stack' THEN 'stacks'
         WHEN name IN ('taskid', 'pid') OR (name = 'id' AND type = 'UserLog') THEN 'tasks'
         WHEN name IN ('typeid', 'labelid', 'keyid') THEN 'strings' END AS target
  FROM (SELECT type_id, type, unnest(args) AS name, unnest(range(len(args))) AS i FROM event_types)),
ref AS (
  SELECT trace_id, rec_offset, loaded_at, 'stack_id' AS field, 'stacks' AS target, stack_id AS key FROM ev
  UNION ALL SELECT trace_id, rec_offset, loaded_at, 'link_offset', 'trace_events', link_offset FROM ev
  UNION ALL SELECT trace_id, rec_offset, loaded_at, 'a' || i, target, CASE i WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END
            FROM ev JOIN arg USING (type_id) WHERE target IS NOT NULL),
tgt AS (
  SELECT trace_id, 'goroutines' AS target, g AS key, loaded_at, deleted_at FROM goroutines
  UNION ALL SELECT trace_id, 'stacks', stack_id, loaded_at, deleted_at FROM stacks
  UNION ALL SELECT trace_id, 'strings', string_id, loaded_at, deleted_at FROM strings
  UNION ALL SELECT trace_id, 'tasks', task_id, loaded_at, NULL FROM tasks
  UNION ALL SELECT trace_id, 'trace_events', rec_offset, loaded_at, NULL FROM trace_events),
par AS (SELECT trace_id, target, key, bool_or(deleted_at IS NULL) AS alive,
               min(CASE WHEN deleted_at IS NULL THEN loaded_at END) AS since FROM tgt GROUP BY ALL),
orphan AS (
  SELECT trace_id, rec_offset, field, target, ref.loaded_at, CASE WHEN alive IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted'
         WHEN since > ref.loaded_at THEN 'later' END AS status
  FROM ref LEFT JOIN par USING (trace_id, target, key) WHERE key IS NOT NULL AND key <> 0)
"""

_PARENTS = """
WITH RECURSIVE latest AS (
  SELECT trace_id, task_id, nullif(parent_id, 0) AS parent_id, children FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, task_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST, children DESC NULLS LAST) AS k FROM tasks WHERE task_id IS NOT NULL) WHERE k = 1),
named AS (SELECT trace_id, child, min(task_id) AS by_id FROM (SELECT trace_id, task_id, unnest(children) AS child FROM latest) GROUP BY ALL),
link AS (SELECT l.trace_id, l.task_id, coalesce(l.parent_id, n.by_id) AS parent_id FROM latest l LEFT JOIN named n ON n.trace_id = l.trace_id AND n.child = l.task_id),
node AS (SELECT c.trace_id, c.task_id, p.task_id AS parent_id FROM link c LEFT JOIN link p ON p.trace_id = c.trace_id AND p.task_id = c.parent_id),
tree AS (
  SELECT trace_id, task_id, task_id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(task_id AS VARCHAR) AS path FROM node WHERE parent_id IS NULL
  UNION ALL
  SELECT n.trace_id, n.task_id, t.root_id, t.depth + 1, t.path || '/' || n.task_id FROM tree t JOIN node n ON n.trace_id = t.trace_id AND n.parent_id = t.task_id),
lost AS (SELECT n.* FROM node n ANTI JOIN tree t ON t.trace_id = n.trace_id AND t.task_id = n.task_id),
chain AS (
  SELECT trace_id, task_id, parent_id AS at, [parent_id] AS seen FROM lost
  UNION ALL
  SELECT c.trace_id, c.task_id, l.parent_id, list_append(c.seen, l.parent_id) FROM chain c JOIN lost l ON l.trace_id = c.trace_id AND l.task_id = c.at
  WHERE NOT list_contains(c.seen, l.parent_id)),
reach AS (SELECT trace_id, task_id, arg_max(seen, len(seen)) AS seen FROM chain GROUP BY ALL),
own AS (SELECT trace_id, task_id FROM reach WHERE list_contains(seen, task_id)),
cyc AS (
  SELECT r.trace_id, r.task_id, min(o.task_id) AS cycle_id, bool_or(o.task_id = r.task_id) AS is_on
  FROM (SELECT trace_id, task_id, unnest(seen) AS s FROM reach) r JOIN own o ON o.trace_id = r.trace_id AND o.task_id = r.s GROUP BY ALL)
"""

_BELOW_ROOTS = """
SELECT trace_id, CAST(u AS BIGINT) AS ancestor_id, task_id, depth - (i - 1) AS distance
FROM (SELECT trace_id, task_id, depth, unnest(string_split(path, '/')) AS u, unnest(range(1, depth + 2)) AS i FROM tree)"""

_CHECKED = f"""
WITH own AS (
  SELECT name, duration FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, task_id ORDER BY loaded_at DESC NULLS LAST, name DESC NULLS LAST, duration DESC NULLS LAST) AS k FROM tasks WHERE task_id IS NOT NULL) WHERE k = 1
  UNION ALL SELECT name, duration FROM tasks WHERE task_id IS NULL)
SELECT name, q, n, true AS within, true AS small FROM (SELECT name, count(*) AS n FROM own WHERE duration IS NOT NULL GROUP BY name), (SELECT unnest([{', '.join(map(str, QUANTILES))}]::DOUBLE[]) AS q)"""

SQL = {
    "p5_checked": _CHECKED,
    "p5_days_checked": _CHECKED,
    "p1_found": """
WITH bound AS (SELECT trace_id, min(ts) AS lo, max(ts) AS hi FROM trace_events GROUP BY trace_id),
iv AS (SELECT r.trace_id, g, coalesce(start_ts, lo) AS s, coalesce(end_ts, hi) AS e FROM regions r LEFT JOIN bound b ON r.trace_id = b.trace_id WHERE g IS NOT NULL),
ok AS (SELECT DISTINCT * FROM iv WHERE s <= e),
mark AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY trace_id, g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ok),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id, g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM mark),
per AS (SELECT trace_id, g, min(s) AS start_ts, max(e) AS end_ts FROM grp GROUP BY trace_id, g, k)
SELECT trace_id, g, 'period' AS kind, start_ts, end_ts FROM per
UNION ALL
SELECT trace_id, g, 'gap', end_ts, nxt FROM (SELECT *, lead(start_ts) OVER (PARTITION BY trace_id, g ORDER BY start_ts) AS nxt FROM per) WHERE nxt IS NOT NULL""",
    "p2_feature_names": f"SELECT DISTINCT {_FEATURE} AS feature FROM trace_events e LEFT JOIN event_types t USING (type_id) UNION SELECT type FROM event_types",
    "p2_stats": _STATS + "SELECT trace_id, g, feature, n, link_time, fin - last AS since_last FROM stat LEFT JOIN fin USING (trace_id)",
    "p2_features_text": _STATS + """, kind AS (SELECT DISTINCT feature FROM named UNION SELECT type FROM event_types),
key AS (SELECT DISTINCT trace_id, g FROM stat)
SELECT k.trace_id, k.g, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY kind.feature) AS n, string_agg(coalesce(CAST(fin - last AS VARCHAR), '-'), ',' ORDER BY kind.feature) AS since_last,
       string_agg(CAST(coalesce(link_time, 0) AS VARCHAR), ',' ORDER BY kind.feature) AS link_time
FROM key k CROSS JOIN kind LEFT JOIN stat s ON s.trace_id IS NOT DISTINCT FROM k.trace_id AND s.g = k.g AND s.feature = kind.feature LEFT JOIN fin ON fin.trace_id IS NOT DISTINCT FROM k.trace_id
GROUP BY k.trace_id, k.g""",
    "p3_found": _ORPHANS + "SELECT trace_id, rec_offset, field, status FROM orphan WHERE status IS NOT NULL",
    "p3_counts": _ORPHANS + "SELECT target, CAST(loaded_at AS DATE) AS day, status, count(*) AS n FROM orphan WHERE status IS NOT NULL GROUP BY ALL",
    "p4_found": _PARENTS + "SELECT trace_id, task_id, cycle_id, CASE WHEN is_on THEN 'on' ELSE 'below' END AS place FROM cyc",
    "p4_hierarchy": _PARENTS + """
SELECT trace_id, task_id, root_id, depth, CAST(NULL AS BIGINT) AS cycle_id, CAST(NULL AS VARCHAR) AS place, path FROM tree
UNION ALL SELECT trace_id, task_id, NULL, NULL, cycle_id, CASE WHEN is_on THEN 'on' ELSE 'below' END, NULL FROM cyc""",
    "p4_descendants": _PARENTS + _BELOW_ROOTS,
    "p4_all_descendants": _PARENTS + _BELOW_ROOTS + """
UNION ALL SELECT trace_id, task_id, task_id, 0 FROM lost
UNION ALL SELECT trace_id, s, task_id, i FROM (SELECT trace_id, task_id, unnest(seen) AS s, unnest(range(1, len(seen) + 1)) AS i FROM reach) WHERE s <> task_id""",
    "p6_found": """
SELECT field, key_id FROM (
  SELECT 'g' AS field, g AS key_id, count(*) AS n FROM trace_events GROUP BY g
  UNION ALL SELECT 'p', CAST(p AS BIGINT), count(*) FROM trace_events GROUP BY p)
WHERE key_id IS NOT NULL AND n * 50 >= (SELECT count(*) FROM trace_events)""",
    "p6_by_goroutine": _LOAD.format(key="g"),
    "p6_by_processor": _LOAD.format(key="p"),
    "p6_by_trace_goroutine": _LOAD.format(key="trace_id, g"),
    "p6_by_trace_processor": _LOAD.format(key="trace_id, p"),
}
