"""Queries of the binary path: the tables are written as trace files, read back, decoded and ordered; with their SQL.

Each SQL says from the tables what must come back from the files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions.tables import durable, remove_at_exit, shared_folder, table
from skein.operators import events as E, ordering, projection
from skein.sources import trace_file, trace_sink


def _raw(spark: SparkSession, d: str, version: int = 1011, streamed: bool = False) -> DataFrame:
    """The records of the files of all traces, through the reader of Hadoop file systems or through the data source."""
    path = f"{shared_folder(spark)}/skein-traces-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    events = E.clean(table(spark, d, "trace_events"), ("raw_type_id",)).withColumn("seq", F.col("ord"))
    trace_sink.write_traces(events, table(spark, d, "strings"), table(spark, d, "stacks"), table(spark, d, "trace_meta"), path, version)
    if streamed:
        return spark.read.format("exectrace").load(path)
    return trace_file.read_raw(spark, path)


def _text(column: str) -> F.Column:
    return F.array_join(column, "|", "-")


def file_records(spark: SparkSession, d: str) -> DataFrame:
    """Records per trace and type, by the data source."""
    return _raw(spark, d, streamed=True).groupBy("trace_id", "version", "type_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("args")).alias("args")).where(F.col("type_id") >= 4).where(~F.col("type_id").isin(35, 37))


def file_meta(spark: SparkSession, d: str) -> DataFrame:
    """Version, frequency and timers."""
    return projection.meta(_raw(spark, d, streamed=True)).select("trace_id", "version", "frequency", F.array_join(F.col("timers").cast("array<string>"), ",").alias("timers"))


def file_strings(spark: SparkSession, d: str) -> DataFrame:
    """The string dictionary, without the names in frames, whose ids the files alone know."""
    own = table(spark, d, "strings").groupBy("trace_id").agg(F.max("string_id").alias("_top"))
    return projection.strings(_raw(spark, d, streamed=True)).join(own, "trace_id").where("string_id <= _top").select("trace_id", "string_id", "val")


def file_stacks(spark: SparkSession, d: str) -> DataFrame:
    """Stacks with the names of their frames, resolved by the dictionary."""
    raw = durable(_raw(spark, d))
    frames = E.resolved_frames(projection.stacks(raw), projection.strings(raw))
    one = lambda f: F.concat_ws(" ", f["pc"].cast("string"), F.coalesce(f["fn"], F.lit("-")), F.coalesce(f["file"], F.lit("-")), f["line"].cast("string"))
    return frames.select("trace_id", "stack_id", F.array_join(F.transform("frames", one), "|").alias("frames"))


def file_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as decoded: processors and times from batches and differences, goroutines carried along, arguments and texts."""
    ev = projection.project(durable(_raw(spark, d)))
    return ev.select("trace_id", "p", "raw_type_id", "type_id", "ts", "g", "a0", "a1", "a2", "stack_id", _text("string_args").alias("texts"))


def file_old_events(spark: SparkSession, d: str) -> DataFrame:
    """The same of files of the first version, which carry sequence numbers; here the tables' order."""
    ev = projection.project(durable(_raw(spark, d, 1005)))
    return ev.select("trace_id", "p", "type_id", "ts", "seq", "a0", "a1", "stack_id")


def file_order(spark: SparkSession, d: str) -> DataFrame:
    """Places and repaired times in the order of all processors; what ties do among themselves shows in neither."""
    return ordering.ordered(durable(projection.project(durable(_raw(spark, d))))).select("trace_id", "ord", "ts")


def file_old_order(spark: SparkSession, d: str) -> DataFrame:
    """Places by global sequence number."""
    ev = projection.project(durable(_raw(spark, d, 1005)))
    keyed = ordering.ordered(durable(ev)).select("trace_id", "ord", F.when(F.col("type_id") == 29, F.col("a1")).otherwise(F.col("seq")).alias("key"))
    return keyed


def file_violations(spark: SparkSession, d: str) -> DataFrame:
    """What the decoder reports: traces without a frequency, traces without events, texts whose string id is unknown, bad modes and kinds."""
    raw = durable(_raw(spark, d))
    found = projection.record_violations(raw, durable(projection.project(raw)))
    return found.groupBy("trace_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (file_records, file_meta, file_strings, file_stacks, file_events, file_old_events, file_order, file_old_order, file_violations)}

# Fixed values of the SQL, by number: how many arguments an event of a type carries of its own, in the newest version and in the
# first one, the types with a stack, and those the first version does not know.
_ARGS = "CASE WHEN t IN (29, 45, 47) THEN 3 WHEN t IN (21, 41) THEN CASE WHEN t = 41 THEN 3 ELSE 2 END WHEN t IN (12, 13, 14, 40, 48) THEN 2 WHEN t IN (4, 5, 7, 9, 31, 32, 33, 34, 38, 39, 46) THEN 1 ELSE 0 END"
_OLD_ARGS = "CASE WHEN t = 29 THEN 3 WHEN t = 13 THEN 2 WHEN t IN (4, 5, 14, 21, 31, 32, 33, 34) THEN 1 ELSE 0 END"
_STACK = "t IN (4, 7, 11, 13, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 39, 42, 43, 45, 46, 47, 48)"
_STARTS, _STOPPED = "(14, 41)", "(15, 16, 17, 18, 19, 20, 22, 23, 24, 25, 26, 27, 30, 42)"

_EV = f"""WITH src AS (
  SELECT DISTINCT ON (trace_id, rec_offset) *, raw_type_id AS t FROM trace_events
  WHERE trace_id IS NOT NULL AND rec_offset IS NOT NULL AND ord IS NOT NULL AND type_id IS NOT NULL AND ts IS NOT NULL),
word AS (SELECT trace_id, string_id, arg_max(val, struct_pack(a := loaded_at IS NOT NULL, b := loaded_at)) AS val FROM strings WHERE deleted_at IS NULL AND trace_id IS NOT NULL GROUP BY ALL HAVING string_id <> 0 AND val <> ''),
fil AS (
  SELECT src.trace_id, rec_offset, ord, p, t, CASE t WHEN 38 THEN 14 WHEN 39 THEN 21 WHEN 40 THEN 29 ELSE t END AS k, ts, seq, string_args, coalesce(stack_id, 0) AS sid, {_ARGS} AS n, {_OLD_ARGS} AS o, coalesce(a0, 0) AS x0, coalesce(a1, 0) AS x1, coalesce(a2, 0) AS x2
  FROM src JOIN (SELECT DISTINCT trace_id FROM trace_meta) m ON m.trace_id = src.trace_id WHERE p IS NOT NULL AND t >= 4 AND t NOT IN (35, 37)),
dec AS (
  SELECT *, CASE WHEN n > 0 THEN x0 ELSE 0 END AS a0, CASE WHEN n > 1 THEN x1 ELSE 0 END AS a1, CASE WHEN n > 2 THEN x2 ELSE 0 END AS a2, CASE WHEN {_STACK} THEN sid ELSE 0 END AS stack_id FROM fil),
run AS (
  SELECT *, last_value(CASE WHEN k IN {_STARTS} THEN a0 WHEN k IN {_STOPPED} THEN 0 END IGNORE NULLS) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM dec)
"""
_REAL = "CASE WHEN t = 40 AND a1 <> 0 THEN a1 WHEN t = 29 AND a2 <> 0 THEN a2 ELSE ts END"
_OLD = f"""WITH src AS (
  SELECT DISTINCT ON (trace_id, rec_offset) *, raw_type_id AS t FROM trace_events
  WHERE trace_id IS NOT NULL AND rec_offset IS NOT NULL AND ord IS NOT NULL AND type_id IS NOT NULL AND ts IS NOT NULL),
old AS (
  SELECT src.trace_id, p, t, ts, ord AS seq, {_OLD_ARGS} AS o, a0, a1, a2, CASE WHEN {_STACK} THEN coalesce(stack_id, 0) ELSE 0 END AS stack_id
  FROM src JOIN (SELECT DISTINCT trace_id FROM trace_meta) m ON m.trace_id = src.trace_id WHERE p IS NOT NULL AND t BETWEEN 4 AND 36 AND t <> 35)
"""

SQL = {
    "file_records": _EV + f"SELECT trace_id, 1011 AS version, t AS type_id, count(*) AS n, sum(n + 1 + CASE WHEN {_STACK} THEN 1 ELSE 0 END)::BIGINT AS args FROM fil GROUP BY ALL",
    "file_meta": """SELECT trace_id, 1011 AS version, CASE WHEN max(frequency) > 0 THEN max(frequency) END AS frequency,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(any_value(timers), lambda x: x IS NOT NULL))), ','), '') AS timers FROM trace_meta WHERE trace_id IS NOT NULL GROUP BY trace_id""",
    "file_strings": _EV + "SELECT word.* FROM word JOIN (SELECT DISTINCT trace_id FROM trace_meta) USING (trace_id)",
    "file_stacks": """WITH known AS (SELECT trace_id, stack_id, arg_max(frames, struct_pack(a := loaded_at IS NOT NULL, b := loaded_at)) AS frames FROM stacks WHERE deleted_at IS NULL AND trace_id IS NOT NULL GROUP BY ALL)
SELECT known.trace_id, stack_id, array_to_string(list_transform(frames, lambda f: coalesce(f.pc, 0) || ' ' || coalesce(nullif(f.fn, ''), '-') || ' ' || coalesce(nullif(f.file, ''), '-') || ' ' || coalesce(f.line, 0)), '|') AS frames
FROM known JOIN (SELECT DISTINCT trace_id FROM trace_meta) USING (trace_id) WHERE stack_id <> 0 AND len(frames) > 0""",
    "file_events": _EV + f"""SELECT run.trace_id, p, t AS raw_type_id, k AS type_id, ts, CASE WHEN k IN {_STARTS} OR k IN (29, 31, 32) THEN a0 WHEN k IN (7, 8, 9, 10) THEN 0 ELSE coalesce(was, 0) END AS g, a0, a1, a2, stack_id,
  CASE WHEN t = 48 THEN coalesce(val, '-') || '|' || coalesce(string_args[2], '') WHEN t = 9 THEN CASE a0 WHEN 0 THEN 'mark termination' WHEN 1 THEN 'sweep termination' ELSE '-' END WHEN t IN (41, 45, 47) THEN coalesce(val, '-') END AS texts
FROM run LEFT JOIN word ON word.trace_id = run.trace_id AND word.string_id = CASE WHEN t = 48 THEN a1 WHEN t IN (41, 45, 47) THEN a2 END""",
    "file_old_events": _OLD + "SELECT trace_id, p, t AS type_id, ts, seq, CASE WHEN o > 0 THEN coalesce(a0, 0) ELSE 0 END AS a0, CASE WHEN o > 1 THEN coalesce(a1, 0) ELSE 0 END AS a1, stack_id FROM old",
    "file_order": _EV + f"SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY {_REAL}) - 1 AS ord, {_REAL} AS ts FROM dec",
    "file_old_order": _OLD + "SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY key) - 1 AS ord, key FROM (SELECT trace_id, CASE WHEN t = 29 THEN coalesce(a1, 0) ELSE seq END AS key FROM old)",
    "file_violations": _EV + """SELECT trace_id, rule_id, count(*) AS n FROM (
  SELECT trace_id, 'frequency' AS rule_id FROM trace_meta WHERE trace_id IS NOT NULL GROUP BY trace_id HAVING coalesce(max(frequency), 0) <= 0
  UNION ALL SELECT DISTINCT trace_id, 'empty' FROM trace_meta WHERE trace_id IS NOT NULL AND trace_id NOT IN (SELECT trace_id FROM dec)
  UNION ALL SELECT trace_id, 'stw kind' FROM dec WHERE t = 9 AND a0 NOT IN (0, 1)
  UNION ALL SELECT d.trace_id, 'string id' FROM dec d LEFT JOIN word ON word.trace_id = d.trace_id AND word.string_id = CASE WHEN t = 48 THEN a1 ELSE a2 END WHERE t IN (41, 45, 47, 48) AND val IS NULL
  UNION ALL SELECT trace_id, 'region mode' FROM dec WHERE t = 47 AND a1 NOT IN (0, 1)) GROUP BY ALL""",
}
