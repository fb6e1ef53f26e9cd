"""Queries of the trace operators over the event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.functions import catalog, scalars
from skein.functions.catalog import ID
from skein.functions.tables import durable, table
from skein.functions.windows import number_over
from skein.operators import events as E, futile, goroutines as G, linking, mmu as M, mutator as U, ordering, projection, tasks as K

WINDOWS = (1_000_000, 100_000_000, 1_000_000_000)
QUANTILES = (0.0, 0.1, 0.5, 0.9, 1.0)


def _ev(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return E.clean(table(spark, d, "trace_events"), extra)


_NARROW = ("trace_id", "rec_offset", "ord", "type_id", "ts", "p", "g", "a0")  # what states and links need


def _stored(spark: SparkSession, d: str, *extra: str, types: list[int] | None = None) -> DataFrame:
    """Clean events written once, for queries that pass over them several times: the narrow columns, those named, and only some types where these are given."""
    events = table(spark, d, "trace_events")
    events = events if types is None else events.where(F.col("type_id").isin(*types))
    return durable(E.clean(events, tuple(c for c in extra if c not in E.COLUMNS)).select(*_NARROW, *extra))


def event_catalog(spark, d):
    return E.with_catalog(_ev(spark, d), table(spark, d, "event_types")).groupBy("type_id", "type_name", "min_version", "has_stack").agg(F.count(F.lit(1)).alias("n"))


def catalog_table(spark, d):
    """The built-in catalogue."""
    return catalog.event_types(spark).select("type_id", "type", "min_version", "has_stack", F.array_join("args", ",").alias("args"), F.array_join("string_args", ",").alias("string_args"))


def ts_rescale(spark, d):
    return E.with_world_time(_ev(spark, d), table(spark, d, "trace_meta")).select("trace_id", "rec_offset", "ns")


def delta_decode(spark, d):
    return ordering.sequence_numbers(_ev(spark, d))


def carry_forward_g(spark, d):
    return projection.running_goroutine(_ev(spark, d).where("p is not null"), ["ord", "rec_offset"], "running").select("trace_id", "rec_offset", "running")


def pseudo_processors(spark, d):
    return E.with_pseudo_processors(_ev(spark, d), table(spark, d, "trace_meta")).groupBy("trace_id", "pseudo_p").agg(F.count(F.lit(1)).alias("n"))


def local_rename(spark, d):
    return ordering.renamed(_ev(spark, d, "raw_type_id")).groupBy("raw_type_id", "type_id").agg(F.count(F.lit(1)).alias("n"))


def total_order(spark, d):
    return number_over(_ev(spark, d), ["trace_id"], ["ts", "p", "rec_offset"], "place", bits=34).select("trace_id", "rec_offset", "place")


def order_violations(spark, d):
    return ordering.order_violations(_ev(spark, d).where("p is not null"), ("trace_id", "p"))


def exit_repair(spark, d):
    return ordering.exit_repair(_ev(spark, d))


def futile_events(spark, d):
    return futile.futile_marks(_ev(spark, d))


def without_futile(spark, d):
    return futile.without_futile(_ev(spark, d)).select("trace_id", "rec_offset")


def links(spark, d):
    return linking.links(_stored(spark, d), table(spark, d, "trace_meta"))


def netpoll_unblocks(spark, d):
    return linking.netpoll_unblocks(_ev(spark, d))


def state_violations(spark, d):
    return linking.state_violations(_ev(spark, d)).select("trace_id", "rec_offset", "message")


def bracket_violations(spark, d):
    return linking.bracket_violations(_stored(spark, d, types=[ID[x] for x in ("GcStart", "GcDone", "GcStwStart", "GcStwDone", "GcSweepStart", "GcSweepDone", "GcMarkAssistStart", "GcMarkAssistDone", "ProcStart", "ProcStop", "UserTaskCreate", "UserTaskEnd")]), table(spark, d, "trace_meta"))


def processor_violations(spark, d):
    return linking.processor_violations(_ev(spark, d))


def region_violations(spark, d):
    return linking.region_violations(_ev(spark, d))


def string_violations(spark, d):
    return linking.dictionary_violations(table(spark, d, "strings"))


def stack_frames(spark, d):
    ev = E.with_stacks(_ev(spark, d), table(spark, d, "stacks"))
    top = scalars.top_frame(F.col("frames"))
    return ev.select("trace_id", "rec_offset", scalars.frames_text(F.col("frames")).alias("frames"), top["fn"].alias("fn"))


def goroutines(spark, d):
    return G.goroutines(_stored(spark, d, "a1"), table(spark, d, "stacks"))


def goroutine_states(spark, d):
    spans = G.state_intervals(_ev(spark, d)).where("counted and end_ts is not null")
    return spans.groupBy("trace_id", "g", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ts") - F.col("ts")).alias("spent"))


def gc_cycles(spark, d):
    return G.gc_cycles(_ev(spark, d))


def regions(spark, d):
    return G.user_regions(_stored(spark, d, "a1", "string_args", types=[ID["UserRegion"], ID["GoEnd"]])).drop("depth", "start_ord", "end_ord")


def region_times(spark, d):
    return G.region_stats(_stored(spark, d, "a1", "string_args"), inherited=False).select("trace_id", "g", "start_offset", "end_offset", "exec_time", "sched_wait_time", "io_time", "block_time", "syscall_time", "total_time")


def region_stats(spark, d):
    return G.region_stats(_stored(spark, d, "a1", "string_args"))


def region_frames(spark, d):
    ev = _stored(spark, d, "a1", "string_args", "stack_id", types=[ID["UserRegion"], ID["GoEnd"]])
    return G.region_frames(G.user_regions(ev), ev, table(spark, d, "stacks"))


def sequence_violations(spark, d):
    versions = table(spark, d, "trace_meta").groupBy("trace_id").agg(F.max("version").alias("version"))
    return ordering.sequence_violations(_ev(spark, d, "raw_type_id").join(versions, "trace_id")).select("trace_id", "rec_offset", "rule_id")


def inherited_tasks(spark, d):
    return G.inherited_tasks(_stored(spark, d, "a1", "string_args", types=[ID["UserRegion"], ID["GoEnd"], ID["GoCreate"]]))


def tasks(spark, d):
    out = K.tasks(_stored(spark, d, "a1", "string_args"), table(spark, d, "regions"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select(*(c for c in out.columns if c not in ("goroutines", "children")), text("goroutines"), text("children"))


def task_descendants(spark, d):
    return K.descendants(K.tasks(_stored(spark, d, "a1", "string_args"), table(spark, d, "regions")))


def task_all_descendants(spark, d):
    return K.all_descendants(K.tasks(_stored(spark, d, "a1", "string_args"), table(spark, d, "regions")))


def overlap_instants(spark, d):
    ev, reg = _stored(spark, d, "a1", "string_args", "link_ts", "link_g"), table(spark, d, "regions")
    return K.overlapping_instants(ev, K.tasks(ev, reg), reg).groupBy("trace_id", "task_id").agg(F.count(F.lit(1)).alias("n"))


def overlap_durations(spark, d):
    ev, reg = _stored(spark, d, "a1", "string_args", "link_ts", "link_g"), table(spark, d, "regions").distinct()
    own = ev.where("link_ts is not null").select("trace_id", "rec_offset", "link_ts", "link_g")
    return K.overlapping_durations(ev.drop("link_ts", "link_g"), K.tasks(ev, reg), reg, own)


def related_goroutines(spark, d):
    ev = _stored(spark, d, "a1", "string_args")
    return K.related_goroutines(ev, K.tasks(ev, table(spark, d, "regions")), 2)


def mu_contributions(spark, d):
    return U.contributions(_stored(spark, d, "string_args"))


def mu_raw(spark, d):
    return U.raw_utilisation(_stored(spark, d, "string_args")).select("trace_id", "ord", "rec_offset", "time", F.round("util", 9).alias("util"))


def mu_series(spark, d):
    return U.mutator_utilisation(_stored(spark, d, "string_args"))


def mu_series_stw(spark, d):
    """Stops of the world alone."""
    return U.mutator_utilisation(_stored(spark, d, "string_args"), stw=True)


def mu_series_sweep(spark, d):
    return U.mutator_utilisation(_stored(spark, d, "string_args"), sweep=True)


def mu_series_assist(spark, d):
    return U.mutator_utilisation(_stored(spark, d, "string_args"), assist=True)


def mu_series_background(spark, d):
    return U.mutator_utilisation(_stored(spark, d, "string_args"), background=True)


def mu_series_per_proc(spark, d):
    return U.mutator_utilisation(_stored(spark, d, "string_args"), per_proc=True)


def mmu(spark, d):
    return M.mmu(mu_series(spark, d), WINDOWS).select("trace_id", "window", F.round("mmu", 6).alias("mmu"))


def mmu_per_proc(spark, d):
    return M.mmu(mu_series_per_proc(spark, d), WINDOWS).select("trace_id", "window", F.round("mmu", 6).alias("mmu"))


def mmu_windows(spark, d):
    return M.windowed(mu_series(spark, d), WINDOWS).groupBy("trace_id", "window").agg(F.count(F.lit(1)).alias("knots"), F.round(F.max("util"), 6).alias("best"))


def worst_windows(spark, d):
    return M.worst_windows(mu_series(spark, d), WINDOWS[1], 5).withColumn("util", F.round("util", 6))


def mud_quantiles(spark, d):
    return M.mud(mu_series(spark, d), WINDOWS[1], QUANTILES).select("trace_id", "q", F.round("util", 6).alias("util"))


def longest_tasks(spark, d):
    """The three longest tasks of each trace."""
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("duration"), "task_id", F.asc_nulls_last("loaded_at")))
    rows = table(spark, d, "tasks").select("trace_id", "task_id", "duration", "loaded_at").distinct().withColumn("place", rank)
    return rows.where("place <= 3").select("trace_id", "task_id", "duration", F.col("place").cast("bigint").alias("place"))


def named_goroutines(spark, d):
    """Set union of the goroutines that events, regions and tasks name."""
    ev = table(spark, d, "trace_events").select("trace_id", "g")
    reg = table(spark, d, "regions").select("trace_id", "g")
    task = table(spark, d, "tasks").select("trace_id", F.explode("goroutines").alias("g"))
    return ev.union(reg).union(task).distinct()


def unused_strings(spark, d):
    """Anti join: strings that no event names."""
    ev = table(spark, d, "trace_events")
    used = ev.where(F.col("type_id").isin(ID["UserTaskCreate"], ID["UserRegion"], ID["GoStartLabel"])).select("trace_id", F.col("a2").alias("string_id")).union(ev.where(F.col("type_id") == ID["UserLog"]).select("trace_id", "a1")).distinct()
    return table(spark, d, "strings").select("trace_id", "string_id").distinct().join(used, ["trace_id", "string_id"], "left_anti")


def traced_goroutines(spark, d):
    """Semi join: goroutines that have a region."""
    return table(spark, d, "goroutines").select("trace_id", "g").distinct().join(table(spark, d, "regions"), ["trace_id", "g"], "left_semi")


def worker_labels(spark, d):
    """Starts by label: predicates on text, conditional counts."""
    ev = _ev(spark, d).where(F.col("type_id") == ID["GoStartLabel"]).withColumn("label", F.try_element_at("string_args", F.lit(1)))
    return ev.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").startswith("GC ")).alias("collector"), F.count_if(F.col("label") == "GC (idle)").alias("idle"))


_ALL = (
    goroutines, goroutine_states, event_catalog, catalog_table, ts_rescale, delta_decode, carry_forward_g, pseudo_processors, local_rename, total_order, order_violations, exit_repair,
    futile_events, without_futile, links, netpoll_unblocks, state_violations, bracket_violations, processor_violations, region_violations, string_violations, stack_frames, gc_cycles, regions, region_times, region_stats, region_frames, sequence_violations, inherited_tasks,
    tasks, task_descendants, task_all_descendants, overlap_instants, overlap_durations, related_goroutines, mu_contributions, mu_raw, mu_series, mu_series_stw, mu_series_sweep, mu_series_assist, mu_series_background, mu_series_per_proc, mmu, mmu_per_proc, mmu_windows, worst_windows, mud_quantiles,
    longest_tasks, named_goroutines, unused_strings, traced_goroutines, worker_labels,
)
QUERIES = {f.__name__: f for f in _ALL}


def _in(types) -> str:
    return "(" + ", ".join(map(str, sorted(types))) + ")"


def _ids(names: str) -> list[int]:
    return [ID[x] for x in names.split()]


# Fixed values of the SQL, apart from the operators' own: groups of event types, and the states they need and leave.
_START, _YIELD, _END = _ids("GoStart GoStartLabel"), _ids("GoSched GoPreempt"), _ids("GoEnd GoStop")
_SYNC = _ids("GoBlockSend GoBlockRecv GoBlockSelect GoBlockSync GoBlockCond")
_BLOCK = [*_SYNC, *_ids("GoSleep GoBlock GoBlockGc GoBlockNet")]
_STOP = [*_END, *_YIELD, *_BLOCK, ID["GoSysBlock"]]
_WAIT = [*_ids("GoCreate GoUnblock GoSysExit"), *_YIELD]
_NOTES = _ids("UserLog UserRegion UserTaskCreate UserTaskEnd")
_FUTILE_INNER, _FUTILE_CLOSE = _ids("GoStart GoPreempt FutileWakeup"), _ids("GoBlock GoBlockRecv GoBlockSelect GoBlockSync GoBlockCond")
_STATE_SETS = [
    (_ids("GoCreate"), "dead", "runnable"), (_ids("GoWaiting GoInSyscall"), "runnable", "waiting"), (_START, "runnable", "running"), ([*_BLOCK, ID["GoSysBlock"]], "running", "waiting"),
    (_YIELD, "running", "runnable"), (_ids("GoUnblock GoSysExit"), "waiting", "runnable"), (_END, "running", "dead"),
]


_EV = """ev AS (
  SELECT DISTINCT ON (trace_id, rec_offset) * FROM trace_events
  WHERE trace_id IS NOT NULL AND rec_offset IS NOT NULL AND ord IS NOT NULL AND type_id IS NOT NULL AND ts IS NOT NULL)"""
_WITH = f"WITH {_EV}"
_SUBJECT = f"CASE WHEN type_id IN {_in([ID['GoCreate'], ID['GoUnblock']])} THEN a0 ELSE g END"
_CLEARS = _in(_STOP)
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _link_sql() -> str:
    """Union of one lead per kind of link."""
    wake = [ID["GoCreate"], ID["GoUnblock"], *_START, *_BLOCK, *_YIELD, *_END, ID["GoWaiting"], ID["GoInSyscall"], ID["GoSysCall"], ID["GoSysExit"]]
    wake_fit = f"(type_id IN {_in([ID['GoCreate'], *_YIELD, ID['GoUnblock'], ID['GoSysExit']])} AND nt IN {_in(_START)}) OR (type_id IN {_in([ID['GoWaiting'], *_BLOCK])} AND nt = {ID['GoUnblock']}) OR (type_id = {ID['GoSysCall']} AND nt = {ID['GoSysExit']})"
    pair = lambda a, b: f"type_id = {ID[a]} AND nt = {ID[b]}"
    kinds = [
        ("run", "g", [*_START, *_STOP], f"type_id IN {_in(_START)} AND nt IN {_in(_STOP)}"),
        ("wake", _SUBJECT, wake, wake_fit),
        ("gc", "0", [ID["GcStart"], ID["GcDone"]], pair("GcStart", "GcDone")),
        ("stw", "(SELECT CASE WHEN max(version) < 1010 THEN ev.p ELSE -1 END FROM trace_meta m WHERE m.trace_id = ev.trace_id)", [ID["GcStwStart"], ID["GcStwDone"]], pair("GcStwStart", "GcStwDone")),
        ("sweep", "p", [ID["GcSweepStart"], ID["GcSweepDone"]], pair("GcSweepStart", "GcSweepDone")),
        ("assist", "g", [ID["GcMarkAssistStart"], ID["GcMarkAssistDone"]], pair("GcMarkAssistStart", "GcMarkAssistDone")),
        ("task", "a0", [ID["UserTaskCreate"], ID["UserTaskEnd"]], pair("UserTaskCreate", "UserTaskEnd")),
    ]
    parts = []
    for kind, key, types, fit in kinds:
        parts.append(f"""SELECT trace_id, rec_offset, '{kind}' AS kind, no AS link_offset, nts AS link_ts, ng AS link_g FROM (
  SELECT *, lead(type_id) OVER w AS nt, lead(rec_offset) OVER w AS no, lead(ts) OVER w AS nts, lead(g) OVER w AS ng
  FROM (SELECT *, {key} AS k FROM ev WHERE type_id IN {_in(types)}) WHERE k IS NOT NULL WINDOW w AS (PARTITION BY trace_id, k ORDER BY ord, rec_offset)) WHERE {fit}""")
    return _WITH + "\n" + "\nUNION ALL\n".join(parts)


def _state_sql() -> str:
    need, leave = [], []
    for types, before, after in _STATE_SETS:
        need.append(f"WHEN type_id IN {_in(types)} THEN '{before}'")
        leave.append(f"WHEN type_id IN {_in(types)} THEN '{after}'")
    every = [t for types, *_ in _STATE_SETS for t in types]
    return f"""{_WITH},
s AS (SELECT trace_id, rec_offset, ord, {_SUBJECT} AS k, CASE {' '.join(need)} END AS need, CASE {' '.join(leave)} END AS leave FROM ev WHERE type_id IN {_in(every)}),
w AS (SELECT *, coalesce(lag(leave) OVER (PARTITION BY trace_id, k ORDER BY ord, rec_offset), CASE WHEN k = 0 THEN 'running' ELSE 'dead' END) AS was FROM s WHERE k IS NOT NULL)
SELECT trace_id, rec_offset, 'goroutine is ' || was || ', not ' || need AS message FROM w WHERE was <> need"""


def _bracket_sql() -> str:
    plans = [("gc", "0", "GcStart", "GcDone", 1), ("stw", "(SELECT CASE WHEN max(version) < 1010 THEN ev.p ELSE -1 END FROM trace_meta m WHERE m.trace_id = ev.trace_id)", "GcStwStart", "GcStwDone", 1), ("sweep", "p", "GcSweepStart", "GcSweepDone", 1), ("assist", "g", "GcMarkAssistStart", "GcMarkAssistDone", 0), ("proc", "p", "ProcStart", "ProcStop", 1), ("task", "a0", "UserTaskCreate", "UserTaskEnd", 0)]
    parts = []
    for rule, key, a, b, strict in plans:
        stray = f"WHEN type_id = {ID[b]} AND was IS DISTINCT FROM {ID[a]} THEN 'ended without a start'" if strict else ""
        parts.append(f"SELECT * FROM (SELECT trace_id, rec_offset, '{rule}' AS rule_id, CASE WHEN type_id = {ID[a]} AND was = {ID[a]} THEN 'started twice' {stray} END AS message FROM (SELECT *, lag(type_id) OVER (PARTITION BY trace_id, k ORDER BY ord, rec_offset) AS was FROM (SELECT *, {key} AS k FROM ev WHERE type_id IN ({ID[a]}, {ID[b]})) WHERE k IS NOT NULL)) WHERE message IS NOT NULL")
    return _WITH + "\n" + "\nUNION ALL\n".join(parts)


_WAITS = _in(_WAIT)
_SPANS = f"""spans AS (
  SELECT *, CASE WHEN nt IS NULL OR nt IN {_in(_END)} THEN state IS NOT NULL WHEN state = 'exec' THEN nt IN {_in(_STOP)} WHEN state = 'sched_wait' THEN nt IN {_in(_START)}
            WHEN state IN ('io', 'block') THEN nt = {ID['GoUnblock']} WHEN state = 'syscall' THEN nt = {ID['GoSysExit']} ELSE false END AS counted FROM (
    SELECT trace_id, k AS g, ord, rec_offset, type_id, ts, lead(type_id) OVER w AS nt, lead(ts) OVER w AS nts, lead(ord) OVER w AS no,
           CASE WHEN type_id IN {_in(_START)} THEN 'exec' WHEN type_id IN {_WAITS} THEN 'sched_wait' WHEN type_id = {ID['GoBlockNet']} THEN 'io'
                WHEN type_id IN {_in(_SYNC)} THEN 'block' WHEN type_id = {ID['GoSysBlock']} THEN 'syscall' END AS state
    FROM (SELECT *, {_SUBJECT} AS k FROM ev WHERE type_id IN {_in({*_WAIT, *_START, *_STOP})}) WHERE k IS NOT NULL
    WINDOW w AS (PARTITION BY trace_id, k ORDER BY ord, rec_offset)))"""
_WORLD = "world AS (SELECT trace_id, min(ts) AS w0, max(ts) AS w1, max(ord) AS wo FROM ev GROUP BY trace_id)"
_LIVES = f"""made AS (SELECT trace_id, a0 AS g, min(ts) AS creation_ts, arg_min(a1, struct_pack(o := ord, r := rec_offset)) AS create_stack FROM ev WHERE type_id = {ID['GoCreate']} AND a0 IS NOT NULL GROUP BY ALL),
went AS (SELECT trace_id, g, min(ts) FILTER (type_id IN {_in(_START)}) AS start_ts, max(ts) FILTER (type_id IN {_in(_END)}) AS end_ts FROM ev WHERE type_id IN {_in([*_START, *_END])} GROUP BY ALL),
lives AS (SELECT m.*, start_ts, end_ts FROM made m LEFT JOIN went w ON w.trace_id = m.trace_id AND w.g = m.g)"""
_CYCLES = f"""cycles AS (SELECT trace_id, ts, nts AS done_ts FROM (
  SELECT *, lead(type_id) OVER w AS nt, lead(ts) OVER w AS nts FROM ev WHERE type_id IN ({ID['GcStart']}, {ID['GcDone']}) WINDOW w AS (PARTITION BY trace_id ORDER BY ord, rec_offset))
  WHERE type_id = {ID['GcStart']} AND (nt IS NULL OR nt = {ID['GcDone']}))"""


def _pair_cte(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT p.trace_id, p.g, CAST(sum(coalesce(nts, l.end_ts, w1) - p.ts) AS BIGINT) AS t FROM (
  SELECT *, lead(type_id) OVER w AS nt, lead(ts) OVER w AS nts FROM ev WHERE type_id IN ({ID[a]}, {ID[b]}) AND g IS NOT NULL WINDOW w AS (PARTITION BY trace_id, g ORDER BY ord, rec_offset)) p
  JOIN lives l ON l.trace_id = p.trace_id AND l.g = p.g JOIN world ON world.trace_id = p.trace_id WHERE type_id = {ID[a]} AND (nt IS NULL OR nt = {ID[b]}) GROUP BY ALL)"""


_SUMS = ", ".join(f"CAST(coalesce(sum(coalesce(nts, w1) - ts) FILTER (state = '{s}'), 0) AS BIGINT) AS {s}_time" for s in G.STATES)
_STACKS = "known AS (SELECT trace_id, stack_id, arg_max(frames, struct_pack(a := loaded_at IS NOT NULL, b := loaded_at)) AS frames FROM stacks WHERE deleted_at IS NULL GROUP BY ALL)"
_GOROUTINES = f"""{_WITH}, {_SPANS}, {_WORLD}, {_LIVES}, {_CYCLES}, {_STACKS},
{_pair_cte('sweeps', 'GcSweepStart', 'GcSweepDone')}, {_pair_cte('assists', 'GcMarkAssistStart', 'GcMarkAssistDone')},
sums AS (SELECT spans.trace_id, g, {_SUMS} FROM spans JOIN world USING (trace_id) WHERE counted GROUP BY spans.trace_id, g),
gc AS (SELECT l.trace_id, l.g, CAST(sum(greatest(0, least(coalesce(done_ts, w1), coalesce(end_ts, w1)) - greatest(c.ts, creation_ts))) AS BIGINT) AS t
       FROM lives l JOIN cycles c ON c.trace_id = l.trace_id JOIN world ON world.trace_id = l.trace_id GROUP BY ALL)
SELECT l.trace_id, l.g, CASE WHEN start_ts IS NOT NULL THEN frames[1].fn END AS name, CASE WHEN start_ts IS NOT NULL THEN frames[1].pc END AS pc, creation_ts, start_ts, end_ts,
  {', '.join(f'coalesce({s}_time, 0) AS {s}_time' for s in G.STATES)}, coalesce(gc.t, 0) AS gc_time, coalesce(sweeps.t, 0) AS sweep_time, coalesce(assists.t, 0) AS assist_mark_time, coalesce(end_ts, w1) - creation_ts AS total_time
FROM lives l JOIN world USING (trace_id) LEFT JOIN sums s ON s.trace_id = l.trace_id AND s.g = l.g LEFT JOIN gc ON gc.trace_id = l.trace_id AND gc.g = l.g
LEFT JOIN sweeps ON sweeps.trace_id = l.trace_id AND sweeps.g = l.g LEFT JOIN assists ON assists.trace_id = l.trace_id AND assists.g = l.g
LEFT JOIN known k ON k.trace_id = l.trace_id AND k.stack_id = l.create_stack"""

_REGIONS = f"""marks AS (
  SELECT *, coalesce(sum(CASE WHEN type_id = {ID['GoEnd']} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_BEFORE}), 0) AS life
  FROM ev WHERE g IS NOT NULL AND (type_id = {ID['GoEnd']} OR (type_id = {ID['UserRegion']} AND a1 IN (0, 1)))),
fins AS (SELECT trace_id, g, life, arg_min(rec_offset, ord) AS eo, arg_min(ts, ord) AS et, min(ord) AS eord FROM marks WHERE type_id = {ID['GoEnd']} GROUP BY ALL),
runs AS (SELECT *, sum(CASE WHEN a1 = 0 THEN 1 ELSE -1 END) OVER w AS s FROM marks WHERE type_id <> {ID['GoEnd']} WINDOW w AS (PARTITION BY trace_id, g, life ORDER BY ord, rec_offset {_UP})),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY trace_id, g, life ORDER BY ord, rec_offset {_UP})) AS low, least(0, coalesce(min(s) OVER (PARTITION BY trace_id, g, life ORDER BY ord, rec_offset {_BEFORE}), 0)) AS was FROM runs),
levs AS (SELECT *, CASE WHEN a1 = 0 THEN s - low ELSE s - low + 1 END AS lev, a1 = 1 AND s < was AS stray FROM lows),
nxts AS (SELECT *, lead(a1) OVER w AS na, lead(rec_offset) OVER w AS no, lead(ts) OVER w AS nt, lead(ord) OVER w AS nord FROM levs WINDOW w AS (PARTITION BY trace_id, g, life, lev, stray ORDER BY ord, rec_offset)),
reg AS (
  SELECT n.trace_id, a0 AS task_id, n.g, string_args[1] AS name, rec_offset AS start_offset, ts AS start_ts, ord AS start_ord,
         CASE WHEN na = 1 THEN no ELSE eo END AS end_offset, CASE WHEN na = 1 THEN nt ELSE et END AS end_ts, CASE WHEN na = 1 THEN nord ELSE eord END AS end_ord
  FROM nxts n LEFT JOIN fins f ON f.trace_id = n.trace_id AND f.g = n.g AND f.life = n.life WHERE a1 = 0
  UNION ALL SELECT trace_id, a0, g, string_args[1], NULL, NULL, NULL, rec_offset, ts, ord FROM nxts WHERE stray)"""


def _shot(column: str) -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN s.no < r.{column} THEN CASE WHEN s.counted THEN s.nts - s.ts ELSE 0 END ELSE r.at - s.ts END) FILTER (s.state = '{x}'), 0) AS {x}" for x in G.STATES)


_REGION_TIMES = f"""{_WITH}, {_SPANS}, {_WORLD}, {_LIVES}, {_REGIONS},
keyed AS (SELECT reg.*, row_number() OVER () AS id, coalesce(end_ord, wo) AS eord, coalesce(end_ts, w1) AS ets FROM reg JOIN world USING (trace_id)),
a AS (SELECT r.id, {_shot('start_ord')} FROM (SELECT *, start_ts AS at FROM keyed) r JOIN spans s ON s.trace_id = r.trace_id AND s.g = r.g AND s.ord < r.start_ord GROUP BY r.id),
b AS (SELECT r.id, {_shot('eord')} FROM (SELECT *, ets AS at FROM keyed) r JOIN spans s ON s.trace_id = r.trace_id AND s.g = r.g AND s.ord <= r.eord GROUP BY r.id)
SELECT k.trace_id, k.g, start_offset, end_offset, {', '.join(f'CAST(coalesce(b.{s}, 0) - coalesce(a.{s}, 0) AS BIGINT) AS {s}_time' for s in G.STATES)},
  coalesce(ets - creation_ts, 0) - CASE WHEN k.start_ts IS NULL THEN 0 ELSE coalesce(k.start_ts - creation_ts, 0) END AS total_time
FROM keyed k LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN lives l ON l.trace_id = k.trace_id AND l.g = k.g"""

_TASKS = f"""{_WORLD},
own AS (SELECT *, a0 AS task_id, struct_pack(o := ord, r := rec_offset) AS k FROM ev WHERE type_id IN {_in([ID['UserTaskCreate'], ID['UserTaskEnd'], ID['UserLog']])} AND a0 IS NOT NULL),
facts AS (SELECT trace_id, task_id, arg_max(struct_pack(name := string_args[1], parent_id := nullif(a1, 0), ts := ts), k) FILTER (type_id = {ID['UserTaskCreate']}) AS c,
                 arg_max(ts, k) FILTER (type_id = {ID['UserTaskEnd']}) AS end_ts, arg_max(ts, k) AS last, arg_max(rec_offset, k) AS last_offset FROM own GROUP BY ALL),
edge AS (SELECT DISTINCT trace_id, a1 AS task_id, a0 AS child FROM own WHERE type_id = {ID['UserTaskCreate']} AND a1 <> 0),
kids AS (SELECT trace_id, task_id, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM edge GROUP BY ALL),
gs AS (SELECT DISTINCT trace_id, task_id, g FROM (SELECT trace_id, task_id, g FROM own UNION ALL SELECT trace_id, task_id, g FROM regions WHERE task_id <> 0) WHERE g IS NOT NULL),
gl AS (SELECT trace_id, task_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY g) AS goroutines FROM gs GROUP BY ALL),
ids AS (SELECT trace_id, task_id FROM facts UNION SELECT trace_id, task_id FROM kids UNION SELECT trace_id, task_id FROM regions WHERE task_id <> 0),
task AS (
  SELECT i.trace_id, i.task_id, coalesce(c.name, '') AS name, c.parent_id AS parent_id, c.ts AS create_ts, f.end_ts, c.ts IS NOT NULL AND f.end_ts IS NOT NULL AS completed,
         coalesce(c.ts, w0) AS first_ts, coalesce(f.last, f.end_ts, w1) AS last_ts, coalesce(f.end_ts, w1) AS end_or_world_ts, coalesce(f.end_ts, w1) - coalesce(c.ts, w0) AS duration,
         coalesce(goroutines, '') AS goroutines, coalesce(children, '') AS children, f.last_offset
  FROM ids i JOIN world USING (trace_id) LEFT JOIN facts f ON f.trace_id = i.trace_id AND f.task_id = i.task_id
  LEFT JOIN kids k ON k.trace_id = i.trace_id AND k.task_id = i.task_id LEFT JOIN gl ON gl.trace_id = i.trace_id AND gl.task_id = i.task_id)"""

_GC_LABEL = "starts_with({0}, 'GC ') AND {0} NOT IN ({1})"


def _going_sql(sweep: bool = True, assist: bool = True, background: bool = True, idle: str = "'GC (idle)'") -> str:
    at = f"CASE WHEN type_id IN {_in(_STOP)} THEN run.p ELSE p END"
    own, held = _GC_LABEL.format("string_args[1]", idle), _GC_LABEL.format("run.label", idle)
    parts = ["SELECT trace_id, ord, rec_offset, ts, p, NULL::INTEGER AS d FROM ev WHERE false"]
    if sweep:
        parts.append(f"SELECT trace_id, ord, rec_offset, ts, p, CASE type_id WHEN {ID['GcSweepStart']} THEN 1 WHEN {ID['GcSweepDone']} THEN -1 END FROM ev")
    if assist:
        parts.append(f"""SELECT trace_id, ord, rec_offset, ts, {at},
    CASE WHEN type_id IN {_in(_START)} AND depth > 0 THEN 1 WHEN type_id IN {_in(_STOP)} AND depth > 0 AND run.running THEN -1 WHEN type_id = {ID['GcMarkAssistStart']} THEN 1 WHEN type_id = {ID['GcMarkAssistDone']} THEN -1 END FROM going""")
    if background:
        parts.append(f"""SELECT trace_id, ord, rec_offset, ts, {at},
    CASE WHEN type_id = {ID['GoStartLabel']} AND {own} THEN 1
         WHEN type_id IN {_in(_STOP)} AND run.running AND run.type_id = {ID['GoStartLabel']} AND {held} THEN -1 END FROM going""")
    union = "\n  UNION ALL ".join(parts)
    return f"""going AS (
  SELECT *, last_value(CASE WHEN type_id IN {_in(_START)} THEN struct_pack(running := true, p := p, label := string_args[1], type_id := type_id)
                            WHEN type_id IN {_in(_STOP)} THEN struct_pack(running := false, p := p, label := NULL, type_id := type_id) END IGNORE NULLS) OVER w AS run,
    coalesce(sum(CASE WHEN type_id = {ID['GcMarkAssistStart']} THEN 1 WHEN type_id = {ID['GcMarkAssistDone']} THEN -1 END) OVER w, 0) AS depth
  FROM ev WHERE type_id IN {_in([*_START, *_STOP, ID['GcMarkAssistStart'], ID['GcMarkAssistDone']])} AND g IS NOT NULL
  WINDOW w AS (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_BEFORE})),
parts AS (
  {union}),
contrib AS (SELECT trace_id, ord, rec_offset, ts, p, CAST(sum(d) AS INTEGER) AS d FROM parts WHERE d IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""


def _raw_sql(stw: bool = True) -> str:
    stops = f"CASE type_id WHEN {ID['GcStwStart']} THEN 1 WHEN {ID['GcStwDone']} THEN -1 ELSE 0 END" if stw else "0"
    types = _in([ID["Gomaxprocs"], ID["GcStwStart"], ID["GcStwDone"]] if stw else [ID["Gomaxprocs"]])
    return f"""cnt AS (SELECT *, sum(d) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset {_UP}) AS c FROM contrib),
bus AS (SELECT *, CASE WHEN c > 0 THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN c > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset), 0) AS ch FROM cnt),
mix AS (SELECT trace_id, ord, rec_offset, ts, ch, 0 AS stw, NULL::BIGINT AS n FROM bus
  UNION ALL SELECT trace_id, ord, rec_offset, ts, 0, {stops}, CASE WHEN type_id = {ID['Gomaxprocs']} THEN a0 END FROM ev WHERE type_id IN {types}),
one AS (SELECT trace_id, ord, rec_offset, ts, sum(ch) AS ch, sum(stw) AS stw, max(n) AS n FROM mix GROUP BY ALL),
acc AS (SELECT trace_id, ord, rec_offset, ts, sum(ch) OVER w AS b, sum(stw) OVER w AS s, last_value(n IGNORE NULLS) OVER w AS n FROM one WINDOW w AS (PARTITION BY trace_id ORDER BY ord, rec_offset {_UP})),
pts AS (SELECT trace_id, ord, rec_offset, ts AS time, 1.0::DOUBLE - CASE WHEN s > 0 THEN n ELSE b END::DOUBLE / n AS util FROM acc WHERE n > 0),
raw AS (SELECT * FROM pts UNION ALL
  SELECT trace_id, max(ord) + 1, 0, arg_max(ts, struct_pack(o := ord, r := rec_offset)), 0.0 FROM ev WHERE trace_id IN (SELECT trace_id FROM pts) GROUP BY trace_id)"""


_GOING, _RAW = _going_sql(), _raw_sql()
# one series per processor; trace and series are one key in what follows
_PER_PROC = _going_sql(idle="'GC (idle)', 'GC (dedicated)'") + f""",
nnn AS (SELECT trace_id, ord, rec_offset, ts, a0 AS n, coalesce(lag(a0) OVER (PARTITION BY trace_id ORDER BY ord, rec_offset), 0) AS was FROM ev WHERE type_id = {ID['Gomaxprocs']} AND a0 IS NOT NULL),
come AS (SELECT trace_id, ord, rec_offset, ts, unnest(range(was, n)) AS p, 1.0::DOUBLE AS util FROM nnn WHERE n > was),
gone AS (SELECT trace_id, ord, rec_offset, ts, unnest(range(n, was)) AS p, 0.0::DOUBLE AS util FROM nnn WHERE n < was),
alld AS (SELECT trace_id, ord, rec_offset, ts, p, d, 0 AS reset FROM contrib UNION ALL SELECT trace_id, ord, rec_offset, ts, p, 0, 1 FROM gone),
epo AS (SELECT *, sum(reset) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset {_UP}) AS epoch FROM alld),
bzy AS (SELECT *, CASE WHEN sum(d) OVER (PARTITION BY trace_id, p, epoch ORDER BY ord, rec_offset {_UP}) > 0 THEN 1 ELSE 0 END AS busy FROM epo),
liv AS (SELECT trace_id, p, min(ord) AS f FROM (SELECT * FROM come UNION ALL SELECT * FROM gone) GROUP BY ALL),
stw AS (SELECT trace_id, ord, rec_offset, ts, sum(CASE type_id WHEN {ID['GcStwStart']} THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id ORDER BY ord, rec_offset {_UP}) AS stopped FROM ev WHERE type_id IN ({ID['GcStwStart']}, {ID['GcStwDone']})),
rws AS (SELECT trace_id, p, ord, rec_offset, ts, busy, NULL::BIGINT AS stopped FROM bzy
  UNION ALL SELECT s.trace_id, l.p, s.ord, s.rec_offset, s.ts, NULL, s.stopped FROM stw s JOIN liv l ON l.trace_id = s.trace_id AND s.ord > l.f),
car AS (SELECT *, last_value(busy IGNORE NULLS) OVER w AS b, last_value(stopped IGNORE NULLS) OVER w AS st FROM rws WINDOW w AS (PARTITION BY trace_id, p ORDER BY ord, rec_offset {_UP})),
lim AS (SELECT c.*, k.n FROM car c ASOF JOIN nnn k ON k.trace_id = c.trace_id AND k.ord <= c.ord),
ppp AS (SELECT trace_id, p, ord, rec_offset, ts, CASE WHEN coalesce(b, 0) > 0 OR coalesce(st, 0) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS util FROM lim WHERE p < n
  UNION ALL SELECT trace_id, p, ord, rec_offset, ts, util FROM come UNION ALL SELECT trace_id, p, ord, rec_offset, ts, util FROM gone),
ppe AS (SELECT * FROM ppp UNION ALL
  SELECT e.trace_id, unnest(range(0, n)), e.o, 0, e.t, 0.0 FROM (SELECT trace_id, max(ord) + 1 AS o, arg_max(ts, struct_pack(o := ord, r := rec_offset)) AS t FROM ev WHERE trace_id IN (SELECT trace_id FROM ppp) GROUP BY trace_id) e
  JOIN (SELECT trace_id, arg_max(n, struct_pack(o := ord, r := rec_offset)) AS n FROM nnn GROUP BY trace_id) k ON k.trace_id = e.trace_id),
raw AS (SELECT trace_id || '#' || p AS trace_id, ord, rec_offset, ts AS time, util FROM ppe)"""
_WINDOWED = f"""stp AS (SELECT trace_id, time, min(util) AS util FROM raw GROUP BY ALL),
arr AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY trace_id ORDER BY time), 0) AS area FROM (SELECT *, lag(util) OVER v * (time - lag(time) OVER v) AS x FROM stp WINDOW v AS (PARTITION BY trace_id ORDER BY time))),
spn AS (SELECT trace_id, min(time) AS t0, max(time) AS t1 FROM stp GROUP BY trace_id HAVING max(time) > min(time)),
wnd AS (SELECT *, least(w, t1 - t0) AS len FROM spn, (SELECT unnest([{', '.join(map(str, WINDOWS))}]) AS w)),
kno AS (SELECT DISTINCT trace_id, w, len, t FROM (
  SELECT wnd.*, unnest([time, time - len, t0, t1 - len]) AS t FROM stp JOIN wnd USING (trace_id)) WHERE t BETWEEN t0 AND t1 - len),
lo AS (SELECT k.*, a.area + a.util * (k.t - a.time) AS f0 FROM kno k ASOF JOIN arr a ON a.trace_id = k.trace_id AND a.time <= k.t),
win AS (SELECT k.trace_id, k.w, k.t, (a.area + a.util * (k.t + k.len - a.time) - k.f0) / k.len AS util FROM lo k ASOF JOIN arr a ON a.trace_id = k.trace_id AND a.time <= k.t + k.len)"""

_FOLDED = """num AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ord, rec_offset) AS rn FROM raw),
fold AS (
  SELECT trace_id, rn, time AS t, util AS u, NULL::BIGINT AS et, NULL::DOUBLE AS eu FROM num WHERE rn = 1
  UNION ALL
  SELECT f.trace_id, n.rn, CASE WHEN abs(u - util) < 1e-5 THEN t ELSE time END, CASE WHEN abs(u - util) < 1e-5 THEN u WHEN t = time THEN least(u, util) ELSE util END,
         CASE WHEN abs(u - util) >= 1e-5 AND t <> time THEN t END, CASE WHEN abs(u - util) >= 1e-5 AND t <> time THEN u END
  FROM fold f JOIN num n ON n.trace_id = f.trace_id AND n.rn = f.rn + 1),
folded AS (SELECT trace_id, et AS time, eu AS util FROM fold WHERE et IS NOT NULL UNION ALL SELECT trace_id, arg_max(t, rn), arg_max(u, rn) FROM fold GROUP BY trace_id)"""
_RECURSIVE = _WITH.replace("WITH", "WITH RECURSIVE")
_MUD = f"""par AS (SELECT trace_id, util, lead(util) OVER v AS u2, lead(t) OVER v - t AS dt FROM win WHERE w = {WINDOWS[1]} WINDOW v AS (PARTITION BY trace_id ORDER BY t)),
seg AS (SELECT trace_id, least(util, u2) AS lo, greatest(util, u2) AS hi, dt::DOUBLE AS dt FROM par WHERE dt > 0),
edg AS (SELECT trace_id, lo AS x, 0.0::DOUBLE AS delta, dt AS dirac FROM seg WHERE hi - lo < 1e-5
  UNION ALL SELECT trace_id, lo, dt / (hi - lo), 0.0 FROM seg WHERE hi - lo >= 1e-5 UNION ALL SELECT trace_id, hi, -dt / (hi - lo), 0.0 FROM seg WHERE hi - lo >= 1e-5),
edx AS (SELECT trace_id, x, sum(delta) AS delta, sum(dirac) AS dirac FROM edg GROUP BY ALL),
rat AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY trace_id ORDER BY x {_BEFORE}), 0) AS rate, coalesce(x - lag(x) OVER (PARTITION BY trace_id ORDER BY x), 0) AS gap, coalesce(sum(dirac) OVER (PARTITION BY trace_id ORDER BY x {_BEFORE}), 0) AS jump FROM edx),
cum AS (SELECT *, sum(rate * gap) OVER (PARTITION BY trace_id ORDER BY x {_UP}) + jump AS c FROM rat),
ask AS (SELECT trace_id, m.mass * q AS y, q, low FROM (SELECT trace_id, min(util) AS low FROM win WHERE w = {WINDOWS[1]} GROUP BY trace_id) LEFT JOIN (SELECT trace_id, sum(dt) AS mass FROM seg GROUP BY trace_id) m USING (trace_id), (SELECT unnest([{', '.join(map(str, QUANTILES))}]::DOUBLE[]) AS q)),
hit AS (SELECT a.trace_id, q, arg_min(struct_pack(x := x, c := c, rate := rate, y := y), x) AS f FROM ask a JOIN cum k ON k.trace_id = a.trace_id AND c + dirac >= y * (1 - 1e-12) GROUP BY ALL)
SELECT a.trace_id, a.q, round(coalesce(CASE WHEN f.c > f.y AND f.rate > 1e-9 THEN f.x - (f.c - f.y) / f.rate ELSE f.x END, low), 6) AS util FROM ask a LEFT JOIN hit h ON h.trace_id = a.trace_id AND h.q = a.q"""

_STEPS_OF = "SELECT trace_id, time, min(util) AS util FROM raw GROUP BY ALL"
_FOLDED_WINDOWS = _WINDOWED.replace(_STEPS_OF, "SELECT * FROM folded")
_WORST = f"""rnk AS (SELECT trace_id, t, util, row_number() OVER (PARTITION BY trace_id ORDER BY round(util, 9), t) AS k FROM win WHERE w = {WINDOWS[1]}),
pck AS (
  SELECT trace_id, k, [t] AS taken, t AS got, util FROM rnk WHERE k = 1
  UNION ALL
  SELECT p.trace_id, r.k, CASE WHEN fits THEN list_append(taken, r.t) ELSE taken END, CASE WHEN fits THEN r.t END, r.util
  FROM (SELECT p.*, r.t AS rt, r.k AS rk, r.util AS ru, len(list_filter(p.taken, lambda x: abs(x - r.t) < {WINDOWS[1]})) = 0 AS fits FROM pck p JOIN rnk r ON r.trace_id = p.trace_id AND r.k = p.k + 1 WHERE len(p.taken) < 5) p, LATERAL (SELECT p.rt AS t, p.rk AS k, p.ru AS util) r)
SELECT trace_id, 0 AS series, CAST({WINDOWS[1]} AS BIGINT) AS window, got AS time, round(util, 6) AS util FROM pck WHERE got IS NOT NULL"""


def _series_sql(stw=False, sweep=False, assist=False, background=False) -> str:
    return f"{_RECURSIVE}, {_going_sql(sweep, assist, background)}, {_raw_sql(stw)}, {_FOLDED} SELECT trace_id, 0 AS series, time, util FROM folded"


_INHERITED = f"""fst AS (
  SELECT trace_id, child, f.g AS creator, f.ord AS ord, f.rec_offset AS rec_offset, f.ts AS ts FROM (
    SELECT trace_id, a0 AS child, arg_min(struct_pack(g := g, ord := ord, rec_offset := rec_offset, ts := ts), struct_pack(o := ord, r := rec_offset)) AS f
    FROM ev WHERE type_id = {ID['GoCreate']} AND g IS NOT NULL AND a0 IS NOT NULL GROUP BY ALL)),
opn AS (SELECT f.trace_id, f.child, arg_max(struct_pack(t := r.task_id), r.start_ord) AS top FROM fst f JOIN reg r ON r.trace_id = f.trace_id AND r.g = f.creator AND r.start_ord < f.ord AND (r.end_ord IS NULL OR r.end_ord > f.ord) GROUP BY ALL),
sht AS (SELECT f.trace_id, f.child, min(struct_pack(o := c.o, r := c.r, t := c.t)) AS shut FROM fst f JOIN (
    SELECT trace_id, g, end_ord AS o, end_offset AS r, end_ts AS t FROM reg WHERE start_ord IS NULL
    UNION ALL SELECT trace_id, g, ord, rec_offset, ts FROM ev WHERE type_id = {ID['GoEnd']} AND g IS NOT NULL) c ON c.trace_id = f.trace_id AND c.g = f.child AND (c.o > f.ord OR (c.o = f.ord AND c.r > f.rec_offset)) GROUP BY ALL),
inh AS (
  SELECT trace_id, child, top.t AS task FROM opn
  UNION ALL
  SELECT f.trace_id, f.child, i.task FROM inh i JOIN fst f ON f.trace_id = i.trace_id AND f.creator = i.child
    LEFT JOIN opn o ON o.trace_id = f.trace_id AND o.child = f.child LEFT JOIN sht s ON s.trace_id = f.trace_id AND s.child = f.creator
  WHERE o.child IS NULL AND (s.shut IS NULL OR s.shut.o >= f.ord)),
tkn AS (
  SELECT i.trace_id, i.task AS task_id, i.child AS g, NULL::VARCHAR AS name, f.rec_offset AS start_offset, f.ts AS start_ts, f.ord AS start_ord, s.shut.r AS end_offset, s.shut.t AS end_ts, s.shut.o AS end_ord
  FROM inh i JOIN fst f ON f.trace_id = i.trace_id AND f.child = i.child LEFT JOIN sht s ON s.trace_id = i.trace_id AND s.child = i.child WHERE i.task IS NOT NULL AND i.task <> 0)"""


def _pairs_sql(name: str, a: str, b: str) -> str:
    """Sweeps or mark assists of a goroutine, with the sum of those before and the next one's place."""
    return f"""{name} AS (SELECT *, coalesce(sum(nts - ts) OVER (PARTITION BY trace_id, g ORDER BY ord {_BEFORE}), 0) AS before FROM (
  SELECT *, lead(type_id) OVER w AS nt, lead(ts) OVER w AS nts FROM ev WHERE type_id IN ({ID[a]}, {ID[b]}) AND g IS NOT NULL WINDOW w AS (PARTITION BY trace_id, g ORDER BY ord, rec_offset))
  WHERE type_id = {ID[a]} AND (nt IS NULL OR nt = {ID[b]}))"""


_REGION_STATS = f"""{_RECURSIVE}, {_SPANS}, {_WORLD}, {_LIVES}, {_REGIONS}, {_CYCLES}, {_INHERITED},
{_pairs_sql('swp', 'GcSweepStart', 'GcSweepDone')}, {_pairs_sql('ast', 'GcMarkAssistStart', 'GcMarkAssistDone')},
evr AS (SELECT * FROM reg r WHERE start_ord IS NOT NULL OR NOT EXISTS (SELECT 1 FROM tkn t WHERE t.trace_id = r.trace_id AND t.g = r.g AND t.end_offset = r.end_offset) UNION ALL SELECT * FROM tkn),
keyed AS (SELECT evr.*, row_number() OVER () AS id, coalesce(end_ord, wo) AS eord, coalesce(end_ts, w1) AS ets FROM evr JOIN world USING (trace_id)),
prb AS (SELECT id, trace_id, g, -1 AS sign, start_ord AS po, start_ts AS pt FROM keyed WHERE start_ord IS NOT NULL UNION ALL SELECT id, trace_id, g, 1, eord, ets FROM keyed),
cum AS (SELECT *, {', '.join(f"coalesce(sum(CASE WHEN counted AND state = '{x}' THEN nts - ts END) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_BEFORE}), 0) AS c_{x}" for x in G.STATES)} FROM spans),
sp1 AS (SELECT p.*, {', '.join(f"coalesce(s.c_{x} + CASE WHEN s.state = '{x}' THEN p.pt - s.ts ELSE 0 END, 0) AS {x}" for x in G.STATES)} FROM prb p ASOF LEFT JOIN cum s ON s.trace_id = p.trace_id AND s.g = p.g AND s.ord <= p.po),
sp2 AS (SELECT p.*, coalesce(s.before + least(coalesce(s.nts, p.pt), p.pt) - s.ts, 0) AS sweep FROM sp1 p ASOF LEFT JOIN swp s ON s.trace_id = p.trace_id AND s.g = p.g AND s.ord <= p.po),
sp3 AS (SELECT p.*, coalesce(s.before + least(coalesce(s.nts, p.pt), p.pt) - s.ts, 0) AS assist FROM sp2 p ASOF LEFT JOIN ast s ON s.trace_id = p.trace_id AND s.g = p.g AND s.ord <= p.po),
sp4 AS (SELECT p.*, coalesce(p.pt - l.creation_ts, 0) AS total,
  CASE WHEN l.creation_ts IS NULL THEN 0 ELSE coalesce((SELECT sum(greatest(0, least(coalesce(done_ts, p.pt), p.pt) - c.ts) - greatest(0, least(coalesce(done_ts, l.creation_ts), l.creation_ts) - c.ts)) FROM cycles c WHERE c.trace_id = p.trace_id), 0) END AS gc
  FROM sp3 p LEFT JOIN lives l ON l.trace_id = p.trace_id AND l.g = p.g),
dif AS (SELECT id, {', '.join(f'CAST(sum(sign * {x}) AS BIGINT) AS {y}_time' for x, y in [*((s, s) for s in G.STATES), ('gc', 'gc'), ('sweep', 'sweep'), ('assist', 'assist_mark'), ('total', 'total')])} FROM sp4 GROUP BY id)
SELECT k.trace_id, k.task_id, k.g, k.name, k.start_offset, k.start_ts, k.end_offset, k.end_ts, {', '.join(f'd.{c}' for c in G.TIMES)} FROM keyed k JOIN dif d USING (id)"""

_TREE = f"""{_RECURSIVE}, {_TASKS},
up AS (SELECT c.trace_id, c.task_id, p.task_id AS parent_id FROM task c LEFT JOIN task p ON p.trace_id = c.trace_id AND p.task_id = c.parent_id),
tre AS (SELECT trace_id, task_id, [task_id] AS path FROM up WHERE parent_id IS NULL
  UNION ALL SELECT u.trace_id, u.task_id, list_append(t.path, u.task_id) FROM tre t JOIN up u ON u.trace_id = t.trace_id AND u.parent_id = t.task_id),
lst AS (SELECT up.* FROM up ANTI JOIN tre ON tre.trace_id = up.trace_id AND tre.task_id = up.task_id),
chn AS (SELECT trace_id, task_id, parent_id AS at, [parent_id] AS seen FROM lst
  UNION ALL SELECT c.trace_id, c.task_id, l.parent_id, list_append(c.seen, l.parent_id) FROM chn c JOIN lst l ON l.trace_id = c.trace_id AND l.task_id = c.at WHERE NOT list_contains(c.seen, l.parent_id)),
rch AS (SELECT trace_id, task_id, arg_max(seen, len(seen)) AS seen FROM chn GROUP BY ALL)
SELECT trace_id, a AS ancestor_id, task_id, n - i AS distance FROM (SELECT trace_id, task_id, len(path) AS n, unnest(path) AS a, unnest(range(1, len(path) + 1)) AS i FROM tre)"""

_COUNTED = _in([ID["GoCreate"], *_START, ID["GoUnblock"], ID["GoSysExit"], ID["GcStart"], ID["GoWaiting"], ID["GoInSyscall"]])

SQL = {
    "mu_series_stw": _series_sql(stw=True),
    "mu_series_sweep": _series_sql(sweep=True),
    "mu_series_assist": _series_sql(assist=True),
    "mu_series_background": _series_sql(background=True),
    "mu_series_per_proc": f"{_RECURSIVE}, {_PER_PROC}, {_FOLDED} SELECT string_split(trace_id, '#')[1] AS trace_id, CAST(string_split(trace_id, '#')[2] AS INTEGER) AS series, time, util FROM folded",
    "mmu_per_proc": f"{_RECURSIVE}, {_PER_PROC}, {_FOLDED}, {_FOLDED_WINDOWS} SELECT string_split(trace_id, '#')[1] AS trace_id, CAST(w AS BIGINT) AS window, round(min(util), 6) AS mmu FROM win GROUP BY string_split(trace_id, '#')[1], w",
    "worst_windows": f"{_RECURSIVE}, {_GOING}, {_RAW}, {_FOLDED}, {_FOLDED_WINDOWS}, {_WORST}",
    "inherited_tasks": f"{_RECURSIVE}, {_REGIONS}, {_INHERITED} SELECT trace_id, g, task_id, start_offset, start_ts, start_ord FROM tkn",
    "region_stats": _REGION_STATS,
    "region_frames": f"""{_WITH}, {_REGIONS}, {_STACKS}
SELECT r.trace_id, r.g, start_offset, row_number() OVER (PARTITION BY r.trace_id, r.g ORDER BY start_ts NULLS FIRST, start_offset NULLS FIRST, end_offset NULLS FIRST) AS place, frames[1].fn AS fn, frames[1].pc AS pc
FROM reg r LEFT JOIN ev e ON e.trace_id = r.trace_id AND e.rec_offset = r.start_offset LEFT JOIN known k ON k.trace_id = r.trace_id AND k.stack_id = e.stack_id AND k.stack_id <> 0""",
    "sequence_violations": f"""{_WITH},
num AS (SELECT ev.trace_id, rec_offset, ord, CASE WHEN type_id IN {_in([ID['GoCreate'], ID['GoUnblock'], ID['GoSysExit']])} THEN a0 WHEN type_id = {ID['GcStart']} THEN -2 ELSE g END AS k,
  CASE WHEN type_id = {ID['GoCreate']} THEN 0 WHEN type_id IN {_in([ID['GoWaiting'], ID['GoInSyscall']])} THEN 1 WHEN type_id = {ID['GcStart']} THEN a0 WHEN raw_type_id = type_id THEN a1 END AS need
  FROM ev JOIN (SELECT trace_id, max(version) AS v FROM trace_meta GROUP BY trace_id) m ON m.trace_id = ev.trace_id WHERE v >= 1007 AND type_id IN {_COUNTED})
SELECT trace_id, rec_offset, 'sequence' AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, k ORDER BY ord, rec_offset) - 1 AS had FROM num WHERE k IS NOT NULL) WHERE need <> had""",
    "mu_series": f"{_RECURSIVE}, {_GOING}, {_RAW}, {_FOLDED} SELECT trace_id, 0 AS series, time, util FROM folded",
    "mud_quantiles": f"{_RECURSIVE}, {_GOING}, {_RAW}, {_FOLDED}, {_FOLDED_WINDOWS}, {_MUD}",
    "event_catalog": f"{_WITH} SELECT type_id, t.type AS type_name, min_version, has_stack, count(*) AS n FROM ev LEFT JOIN event_types t USING (type_id) GROUP BY ALL",
    "catalog_table": "SELECT type_id, type, min_version, has_stack, array_to_string(args, ',') AS args, coalesce(array_to_string(string_args, ','), '') AS string_args FROM event_types",
    "ts_rescale": f"{_WITH}, f AS (SELECT trace_id, max(frequency) AS freq FROM trace_meta WHERE frequency > 0 GROUP BY trace_id) SELECT trace_id, rec_offset, CAST(trunc((1e9 / freq) * (ts - min(ts) OVER (PARTITION BY trace_id))) AS BIGINT) AS ns FROM ev LEFT JOIN f USING (trace_id)",
    "delta_decode": f"{_WITH} SELECT trace_id, p, rec_offset, ts - coalesce(lag(ts) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset), 0) AS delta, ts AS restored FROM ev WHERE p IS NOT NULL",
    "carry_forward_g": f"""{_WITH}, c AS (SELECT *, last_value(CASE WHEN type_id IN {_in(_START)} THEN a0 WHEN type_id IN {_CLEARS} THEN 0 END IGNORE NULLS) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset {_BEFORE}) AS was FROM ev WHERE p IS NOT NULL)
SELECT trace_id, rec_offset, CASE WHEN type_id IN {_in([*_START, ID['GoSysExit'], ID['GoWaiting'], ID['GoInSyscall']])} THEN a0 WHEN type_id IN {_in([ID['GcStart'], ID['GcDone'], ID['GcStwStart'], ID['GcStwDone']])} THEN 0 ELSE coalesce(was, 0) END AS running FROM c""",
    "pseudo_processors": f"""{_WITH}, t AS (SELECT DISTINCT trace_id, unnest(timers) AS g FROM trace_meta)
SELECT ev.trace_id, CASE WHEN type_id = {ID['GoUnblock']} AND t.g IS NOT NULL THEN 1000001 WHEN type_id = {ID['GoSysExit']} THEN 1000003 WHEN type_id = {ID['GcStart']} THEN 1000004 ELSE p END AS pseudo_p, count(*) AS n
FROM ev LEFT JOIN t ON t.trace_id = ev.trace_id AND t.g = ev.g GROUP BY ALL""",
    "local_rename": f"{_WITH} SELECT raw_type_id, CASE raw_type_id WHEN 38 THEN 14 WHEN 39 THEN 21 WHEN 40 THEN 29 ELSE raw_type_id END AS type_id, count(*) AS n FROM ev GROUP BY ALL",
    "total_order": f"{_WITH} SELECT trace_id, rec_offset, row_number() OVER (PARTITION BY trace_id ORDER BY ts, p NULLS FIRST, rec_offset) AS place FROM ev",
    "order_violations": f"{_WITH} SELECT trace_id, rec_offset, 'time order' AS rule_id, 'time stamps out of order' AS message FROM (SELECT *, lag(ts) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset) AS was FROM ev WHERE p IS NOT NULL) WHERE ts < was",
    "exit_repair": f"""{_WITH}, b AS (SELECT *, last_value(CASE WHEN type_id IN {_in([ID['GoSysBlock'], ID['GoInSyscall']])} THEN ts END IGNORE NULLS) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_BEFORE}) AS blocked_ts,
  CASE WHEN a2 <> 0 THEN a2 ELSE ts END AS repaired_ts FROM ev WHERE type_id IN {_in([ID['GoSysBlock'], ID['GoInSyscall'], ID['GoSysExit']])} AND g IS NOT NULL)
SELECT trace_id, rec_offset, ts, blocked_ts, repaired_ts, CASE WHEN blocked_ts IS NULL THEN 'stray exit' WHEN repaired_ts < blocked_ts THEN 'exit before block' END AS rule_id FROM b WHERE type_id = {ID['GoSysExit']}""",
    "links": _link_sql(),
    "netpoll_unblocks": f"""{_WITH}, s AS (SELECT *, {_SUBJECT} AS k FROM ev WHERE type_id IN {_in([*_BLOCK, ID['GoUnblock'], ID['GoWaiting']])})
SELECT trace_id, rec_offset FROM (SELECT *, lag(type_id) OVER (PARTITION BY trace_id, k ORDER BY ord, rec_offset) AS was FROM s WHERE k IS NOT NULL) WHERE type_id = {ID['GoUnblock']} AND was = {ID['GoBlockNet']} AND p IS DISTINCT FROM 1000001""",
    "state_violations": _state_sql(),
    "bracket_violations": _bracket_sql(),
    "processor_violations": f"""{_WITH},
w AS (SELECT *, coalesce(last_value(CASE WHEN type_id IN {_in(_START)} THEN g WHEN type_id IN {_in(_STOP)} THEN 0 END IGNORE NULLS) OVER (PARTITION BY trace_id, p ORDER BY ord, rec_offset {_BEFORE}), 0) AS was
      FROM ev WHERE type_id IN {_in([*_START, *_STOP, ID['GoCreate'], ID['GoSysCall'], ID['GoUnblock'], ID['ProcStop']])} AND p IS NOT NULL AND g IS NOT NULL AND p < 1000000)
SELECT * FROM (SELECT trace_id, rec_offset, 'processor' AS rule_id, CASE WHEN type_id IN {_in([*_START, ID['ProcStop']])} AND was <> 0 THEN 'processor is busy'
  WHEN type_id IN {_in([*_STOP, ID['GoCreate'], ID['GoSysCall'], ID['GoUnblock']])} AND was <> g THEN 'goroutine does not run here' WHEN type_id IN {_in([*_STOP, ID['GoSysCall']])} AND g = 0 THEN 'goroutine 0 did this' END AS message FROM w) WHERE message IS NOT NULL""",
    "region_violations": f"""{_WITH},
m AS (SELECT *, sum(CASE WHEN a1 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_UP}) AS s FROM ev WHERE type_id = {ID['UserRegion']} AND a1 IN (0, 1) AND g IS NOT NULL),
l AS (SELECT *, least(0, min(s) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_UP})) AS low, least(0, coalesce(min(s) OVER (PARTITION BY trace_id, g ORDER BY ord, rec_offset {_BEFORE}), 0)) AS was FROM m),
v AS (SELECT *, s - low + CASE WHEN a1 = 0 THEN 0 ELSE 1 END AS lev FROM l WHERE NOT (a1 = 1 AND s < was)),
n AS (SELECT *, lead(a1) OVER w AS na, lead(a0) OVER w AS nt, lead(string_args[1]) OVER w AS nn FROM v WINDOW w AS (PARTITION BY trace_id, g, lev ORDER BY ord, rec_offset))
SELECT trace_id, rec_offset, 'region' AS rule_id, 'ended by a region of another name or task' AS message FROM n WHERE a1 = 0 AND na = 1 AND (nt IS DISTINCT FROM a0 OR nn IS DISTINCT FROM string_args[1])""",
    "task_descendants": _TREE,
    "task_all_descendants": _TREE + """
UNION ALL SELECT trace_id, task_id, task_id, 0 FROM lst
UNION ALL SELECT trace_id, a, task_id, i FROM (SELECT trace_id, task_id, unnest(seen) AS a, unnest(range(1, len(seen) + 1)) AS i FROM rch) WHERE a <> task_id""",
    "string_violations": """SELECT trace_id, string_id, rule_id FROM (
  SELECT trace_id, string_id, CASE WHEN string_id = 0 THEN 'zero id' WHEN bool_or(val = '') THEN 'empty string' WHEN min(val) <> max(val) THEN 'several values' END AS rule_id FROM strings GROUP BY trace_id, string_id) WHERE rule_id IS NOT NULL""",
    "stack_frames": f"""{_WITH}, {_STACKS}
SELECT trace_id, rec_offset, array_to_string(list_transform(list_filter(frames, lambda f: f IS NOT NULL), lambda f: coalesce(f.fn, '') || ' ' || coalesce(f.file, '') || ':' || coalesce(CAST(f.line AS VARCHAR), '')), chr(10)) AS frames, frames[1].fn AS fn
FROM ev LEFT JOIN known USING (trace_id, stack_id)""",
    "goroutines": _GOROUTINES,
    "goroutine_states": f"{_WITH}, {_SPANS} SELECT trace_id, g, state, count(*) AS n, CAST(sum(nts - ts) AS BIGINT) AS spent FROM spans WHERE counted AND nts IS NOT NULL GROUP BY ALL",
    "gc_cycles": f"{_WITH}, {_CYCLES} SELECT * FROM cycles",
    "regions": f"{_WITH}, {_REGIONS} SELECT trace_id, task_id, g, name, start_offset, start_ts, end_offset, end_ts FROM reg",
    "region_times": _REGION_TIMES,
    "tasks": f"{_WITH}, {_TASKS} SELECT * FROM task",
    "overlap_instants": f"""{_WITH}, {_TASKS},
spn AS (SELECT r.trace_id, g, task_id, coalesce(start_ts, w0) AS a, coalesce(end_ts, w1) AS b FROM regions r JOIN world USING (trace_id) WHERE task_id <> 0),
hit AS (
  SELECT DISTINCT e.trace_id, e.rec_offset, t.task_id FROM ev e JOIN spn s ON s.trace_id = e.trace_id AND s.g = e.g AND e.ts BETWEEN a AND b JOIN task t ON t.trace_id = s.trace_id AND t.task_id = s.task_id
  WHERE e.p IS DISTINCT FROM 1000004 AND e.ts BETWEEN first_ts AND end_or_world_ts AND (type_id NOT IN {_in(_NOTES)} OR a0 = t.task_id)
  UNION ALL
  SELECT e.trace_id, e.rec_offset, t.task_id FROM ev e JOIN task t ON t.trace_id = e.trace_id AND e.ts BETWEEN first_ts AND end_or_world_ts WHERE e.p = 1000004 AND (type_id NOT IN {_in(_NOTES)} OR a0 = t.task_id))
SELECT trace_id, task_id, count(*) AS n FROM hit GROUP BY ALL""",
    "overlap_durations": f"""{_WITH}, {_TASKS},
spn AS (SELECT *, row_number() OVER (PARTITION BY trace_id, task_id ORDER BY a, b, coalesce(start_offset, -1), coalesce(end_offset, -1)) AS place FROM (
  SELECT DISTINCT r.trace_id, g, task_id, start_offset, end_offset, name, coalesce(start_ts, w0) AS a, coalesce(end_ts, w1) AS b FROM regions r JOIN world USING (trace_id) WHERE task_id <> 0)),
lst AS (SELECT * FROM ev WHERE link_ts IS NOT NULL AND ts <= link_ts),
hit AS (SELECT e.trace_id, e.rec_offset, s.task_id, list(struct_pack(f := a, t := b, o := least(b, link_ts) - greatest(a, ts)) ORDER BY place) AS l
  FROM lst e JOIN spn s ON s.trace_id = e.trace_id AND (s.g = e.g OR s.g = coalesce(e.link_g, e.g)) AND a < link_ts AND ts < b WHERE p IS DISTINCT FROM 1000004 AND least(b, link_ts) - greatest(a, ts) > 0 GROUP BY ALL),
red AS (SELECT trace_id, rec_offset, task_id, list_reduce(l, lambda acc, x: CASE WHEN x.f < acc.t THEN acc ELSE struct_pack(f := x.f, t := x.t, o := acc.o + x.o) END, struct_pack(f := 0::BIGINT, t := 0::BIGINT, o := 0::BIGINT)).o AS overlap FROM hit)
SELECT * FROM red WHERE overlap > 0
UNION ALL SELECT * FROM (SELECT e.trace_id, e.rec_offset, t.task_id, greatest(0, least(end_or_world_ts, link_ts) - greatest(first_ts, ts)) AS overlap FROM lst e JOIN task t ON t.trace_id = e.trace_id WHERE p = 1000004) WHERE overlap > 0""",
    "related_goroutines": f"""{_WITH}, {_TASKS},
g0 AS (SELECT trace_id, task_id, g FROM gs),
wk AS (SELECT trace_id, a0, g, ts FROM ev WHERE type_id = {ID['GoUnblock']} AND g IS NOT NULL),
g1 AS (SELECT * FROM g0 UNION SELECT s.trace_id, s.task_id, w.g FROM g0 s JOIN task t USING (trace_id, task_id) JOIN wk w ON w.trace_id = s.trace_id AND w.a0 = s.g AND w.ts BETWEEN first_ts AND end_or_world_ts)
SELECT * FROM g1 UNION SELECT s.trace_id, s.task_id, w.g FROM g1 s JOIN task t USING (trace_id, task_id) JOIN wk w ON w.trace_id = s.trace_id AND w.a0 = s.g AND w.ts BETWEEN first_ts AND end_or_world_ts""",
    "mu_contributions": f"{_WITH}, {_GOING} SELECT * FROM contrib",
    "mu_raw": f"{_WITH}, {_GOING}, {_RAW} SELECT trace_id, ord, rec_offset, time, round(util, 9) AS util FROM raw",
    "mmu": f"{_RECURSIVE}, {_GOING}, {_RAW}, {_FOLDED}, {_FOLDED_WINDOWS} SELECT trace_id, CAST(w AS BIGINT) AS window, round(min(util), 6) AS mmu FROM win GROUP BY ALL",
    "mmu_windows": f"{_RECURSIVE}, {_GOING}, {_RAW}, {_FOLDED}, {_FOLDED_WINDOWS} SELECT trace_id, CAST(w AS BIGINT) AS window, count(*) AS knots, round(max(util), 6) AS best FROM win GROUP BY ALL",
    "longest_tasks": "SELECT trace_id, task_id, duration, place FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY duration DESC NULLS LAST, task_id, loaded_at NULLS LAST) AS place FROM (SELECT DISTINCT trace_id, task_id, duration, loaded_at FROM tasks)) WHERE place <= 3",
    "named_goroutines": "SELECT trace_id, g FROM trace_events UNION SELECT trace_id, g FROM regions UNION SELECT trace_id, unnest(goroutines) FROM tasks",
    "unused_strings": "SELECT DISTINCT trace_id, string_id FROM strings s ANTI JOIN (SELECT trace_id, a2 AS k FROM trace_events WHERE type_id IN (41, 45, 47) UNION SELECT trace_id, a1 FROM trace_events WHERE type_id = 48) u ON u.trace_id = s.trace_id AND u.k = s.string_id",
    "traced_goroutines": "SELECT DISTINCT trace_id, g FROM goroutines o SEMI JOIN regions r ON r.trace_id = o.trace_id AND r.g = o.g",
    "worker_labels": f"{_WITH} SELECT trace_id, count(*) AS n, count(*) FILTER (starts_with(string_args[1], 'GC ')) AS collector, count(*) FILTER (string_args[1] = 'GC (idle)') AS idle FROM ev WHERE type_id = 41 GROUP BY ALL",
}


def _futile_sql(select: str) -> str:
    inner, close = _in(_FUTILE_INNER), _in(_FUTILE_CLOSE)
    return f"""{_WITH},
act AS (SELECT trace_id, rec_offset, ord, type_id, CASE WHEN type_id = {ID['GoUnblock']} THEN a0 ELSE g END AS s FROM ev WHERE type_id IN {_in([ID['GoUnblock'], *_FUTILE_INNER, *_FUTILE_CLOSE])}),
blk AS (SELECT *, coalesce(sum(CASE WHEN type_id IN {close} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, s ORDER BY ord, rec_offset {_BEFORE}), 0) AS b FROM act WHERE s IS NOT NULL),
wak AS (SELECT *, sum(CASE WHEN type_id = {ID['GoUnblock']} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, s, b ORDER BY ord, rec_offset {_UP}) AS w FROM blk),
epi AS (SELECT trace_id, s, b, arg_max(type_id, struct_pack(o := ord, r := rec_offset)) FILTER (type_id IN {inner}) AS lst, bool_or(type_id IN {close}) AS fin, max(w) AS mw FROM wak GROUP BY ALL),
bad AS (SELECT a.trace_id, a.rec_offset FROM wak a JOIN epi e ON e.trace_id = a.trace_id AND e.s = a.s AND e.b = a.b WHERE lst = {ID['FutileWakeup']} AND fin AND w = mw)
{select}"""


SQL["futile_events"] = _futile_sql("SELECT * FROM bad")
SQL["without_futile"] = _futile_sql("SELECT trace_id, rec_offset FROM ev ANTI JOIN bad USING (trace_id, rec_offset)")
