"""The trace operators on small hand-made traces; the expected values were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from skein.functions.catalog import GC_P, ID
from skein.operators import events as E, futile, goroutines as G, linking, mmu as M, mutator as U, ordering, tasks as K
from traces import event as e, table

META = "trace_id string, version int, frequency long, timers array<long>"


def meta(spark, n=1, version=1011, timers=()):
    return spark.createDataFrame([(f"t{i}", version, 10**9, list(timers)) for i in range(n)], META)


C1 = [
    e(0, "Gomaxprocs", a=(1,)), e(0, "ProcStart"), e(10, "GoCreate", a=(1,)), e(30, "GoStart", g=1, a=(1, 1)), e(70, "GoBlockRecv", g=1),
    e(100, "GoUnblock", a=(1,)), e(120, "GoStart", g=1, a=(1,)), e(150, "GoEnd", g=1),
]
C2 = [
    *C1[:4], e(40, "UserRegion", g=1, a=(1, 0), s=["r"]), *C1[4:7], e(130, "UserRegion", g=1, a=(1, 1), s=["r"]), C1[7],
]
C13 = [e(10, "GoCreate", a=(3,)), e(11, "GoWaiting", g=3, a=(3,)), e(50, "GoUnblock", a=(3,)), e(60, "GoStart", g=3, a=(3,)), e(100, "HeapAlloc")]
C5 = [e(10, "GoCreate", a=(1,)), e(100, "GcStart"), e(110, "GoCreate", a=(2,)), e(130, "GcDone"), e(200, "GcStart"), e(250, "GcDone"), e(300, "HeapAlloc")]
SWEEP = [e(10, "GoCreate", a=(1,)), e(12, "GoStart", g=1), e(15, "GcSweepDone", g=1), e(20, "GcSweepStart", g=1), e(29, "GcSweepDone", g=1), e(40, "GcMarkAssistStart", g=1), e(100, "HeapAlloc")]


def test_goroutine_times(spark):
    ev = table(spark, C1, C13, C5, SWEEP).cache()
    got = {(r.trace_id, r.g): r for r in G.goroutines(ev).collect()}
    r = got["t0", 1]
    assert (r.exec_time, r.sched_wait_time, r.block_time, r.io_time, r.syscall_time, r.total_time, r.creation_ts, r.start_ts, r.end_ts) == (70, 40, 30, 0, 0, 140, 10, 30, 150)
    assert (got["t1", 3].sched_wait_time, got["t1", 3].exec_time) == (10, 40)
    assert (got["t2", 1].gc_time, got["t2", 2].gc_time) == (80, 70)
    assert (got["t3", 1].sweep_time, got["t3", 1].assist_mark_time) == (9, 60)
    old = {(r.trace_id, r.g): r for r in G.goroutines(ev, compat=True).collect()}
    assert (old["t3", 1].sweep_time, got["t3", 1].sweep_time) == (24, 9)
    assert old["t0", 1].end_ts is None and (old["t2", 1].gc_time, old["t2", 2].gc_time) == (50, 50)


def test_empty_event_table(spark):
    ev = table(spark, [e(0, "GoCreate", a=(1,))]).where("false")
    assert G.goroutines(ev).count() == 0 and G.region_stats(ev).count() == 0 and K.tasks(ev).count() == 0
    assert U.mutator_utilisation(ev).count() == 0 and linking.links(ev, meta(spark)).count() == 0


def test_links(spark):
    ev = table(spark, C1)
    at = {r.rec_offset: r.ts for r in ev.collect()}
    got = sorted((at[r.rec_offset], r.kind, r.link_ts) for r in linking.links(ev, meta(spark)).collect())
    assert got == [(10, "wake", 30), (30, "run", 70), (70, "wake", 100), (100, "wake", 120), (120, "run", 150)]


def test_syscall_links_only_to_its_exit(spark):
    base = [e(0, "GoCreate", a=(1,)), e(1, "GoStart", g=1), e(2, "GoSysCall", g=1)]
    blocked = [*base, e(3, "GoSysBlock", g=1), e(9, "GoSysExit", g=1, a=(1,))]
    again = [*base, e(3, "GoSched", g=1), e(4, "GoStart", g=1), e(5, "GoSysBlock", g=1), e(9, "GoSysExit", g=1, a=(1,))]
    ev = table(spark, blocked, again)
    got = {(r.trace_id, r.link_ts) for r in linking.links(ev, meta(spark, 2)).where("kind = 'wake'").collect()}
    assert ("t0", 9) in got and ("t1", 9) not in got


def test_region_stat(spark):
    ev = table(spark, C2)
    r = G.region_stats(ev).collect()
    assert [(x.name, x.task_id, x.exec_time, x.sched_wait_time, x.block_time, x.total_time, x.gc_time) for x in r] == [("r", 1, 40, 20, 30, 90, 0)]


def test_regions_stray_open_and_ended(spark):
    rows = [
        e(1, "UserRegion", g=1, a=(7, 1), s=["stray"]), e(2, "UserRegion", g=1, a=(7, 0), s=["a"]), e(3, "UserRegion", g=1, a=(7, 0), s=["b"]),
        e(4, "UserRegion", g=1, a=(7, 1), s=["b"]), e(9, "GoEnd", g=1), e(10, "UserRegion", g=2, a=(8, 0), s=["open"]), e(11, "UserRegion", g=2, a=(8, 5), s=["odd"]),
    ]
    got = sorted((r.name, r.start_ts, r.end_ts) for r in G.regions(table(spark, rows)).collect())
    assert got == [("a", 2, 9), ("b", 3, 4), ("open", 10, None), ("stray", None, 1)]


def test_inherited_tasks(spark):
    rows = [
        e(0, "GoCreate", a=(1,)), e(1, "UserRegion", g=1, a=(7, 0), s=["a"]), e(2, "UserRegion", g=1, a=(8, 0), s=["b"]), e(3, "GoCreate", g=1, a=(2,)),
        e(4, "UserRegion", g=1, a=(8, 1), s=["b"]), e(5, "GoCreate", g=1, a=(3,)), e(6, "UserRegion", g=1, a=(7, 1), s=["a"]), e(7, "GoCreate", g=1, a=(4,)),
        e(8, "GoCreate", g=2, a=(5,)), e(9, "GoCreate", g=5, a=(6,)), e(10, "UserRegion", g=5, a=(0, 0), s=["none"]), e(11, "GoCreate", g=5, a=(9,)),
    ]
    assert {(r.g, r.task_id) for r in G.inherited_tasks(table(spark, rows)).collect()} == {(2, 8), (3, 7), (5, 8), (6, 8)}


def test_inherited_regions_take_part(spark):
    rows = [
        e(0, "GoCreate", a=(1,)), e(1, "GoStart", g=1), e(2, "UserRegion", g=1, a=(7, 0), s=["a"]), e(3, "GoCreate", g=1, a=(2,)), e(4, "GoCreate", g=1, a=(3,)), e(5, "GoCreate", g=1, a=(4,)),
        e(6, "UserRegion", g=1, a=(7, 1), s=["a"]), e(10, "GoStart", g=2, p=1), e(12, "UserRegion", g=2, a=(0, 0), s=["b"]), e(14, "UserRegion", g=2, a=(0, 1), s=["b"]), e(15, "GoCreate", g=2, a=(5,), p=1),
        e(20, "UserRegion", g=2, a=(9, 1), s=["stray"]), e(21, "GoCreate", g=2, a=(6,), p=1), e(22, "UserRegion", g=2, a=(9, 1), s=["again"]), e(30, "GoStart", g=3, p=2), e(33, "GoEnd", g=3, p=2), e(40, "GoSched", g=2, p=1),
    ]
    ev = table(spark, rows)
    got = {(r.g, r.task_id, r.name, r.start_ts, r.end_ts) for r in G.regions(ev).collect()}
    assert got == {(1, 7, "a", 2, 6), (2, 7, None, 3, 20), (3, 7, None, 4, 33), (4, 7, None, 5, None), (5, 7, None, 15, None), (2, 0, "b", 12, 14), (2, 9, "again", None, 22)}
    times = {r.g: (r.exec_time, r.sched_wait_time, r.total_time) for r in G.region_stats(ev).where("name is null").collect()}
    assert times == {2: (10, 7, 17), 3: (3, 26, 29), 4: (0, 35, 35), 5: (0, 25, 25)}
    tasks = K.tasks(ev, G.regions(ev))
    assert {r.task_id: r.goroutines for r in tasks.collect()} == {7: [1, 2, 3, 4, 5], 9: [2]}
    assert {r.g for r in K.related_goroutines(ev, tasks, 0).where("task_id = 7").collect()} == {1, 2, 3, 4, 5}
    hits = K.overlapping_instants(ev, tasks, G.regions(ev)).where("task_id = 7").join(ev, ["trace_id", "rec_offset"])
    assert {(r.g, r.ts) for r in hits.collect()} >= {(2, 10), (2, 15), (3, 30), (3, 33)}
    links = spark.createDataFrame([("t0", 10 + 14, 33, 3)], "trace_id string, rec_offset long, link_ts long, link_g long")
    assert [(r.task_id, r.overlap) for r in K.overlapping_durations(ev, tasks, G.regions(ev), links).collect()] == [(7, 3)]
    assert {(r.g, r.task_id) for r in G.inherited_tasks(ev).collect()} == {(2, 7), (3, 7), (4, 7), (5, 7)}



def test_sequence_violations(spark):
    def life(second, unblock=3, gc=1):
        return [
            e(0, "GoCreate", a=(1,)), e(1, "GcStart", a=(0,)), e(2, "GoStart", g=1, a=(1, 1)), e(3, "GoBlockRecv", g=1), e(4, "GoCreate", a=(2,)), e(5, "GoWaiting", g=2),
            e(6, "GoUnblock", a=(2, 2)), e(7, "GoUnblock", a=(1, second)), e(8, "GoStart", g=1, a=(1, unblock)), e(9, "GcStart", a=(gc,)),
        ]

    ev = table(spark, life(2), life(5), life(2, 4), life(2, 3, 7))
    # the states fit equally well in all four
    assert len({tuple(sorted(r.rec_offset for r in rows)) for rows in ([r for r in linking.state_violations(ev).collect() if r.trace_id == f"t{n}"] for n in range(4))}) == 1
    got = sorted((r.trace_id, r.rec_offset - 10, r.rule_id) for r in ordering.sequence_violations(ev).collect())
    assert got == [("t1", 7, "sequence"), ("t2", 8, "sequence"), ("t3", 9, "sequence")]
    local = ev.withColumn("raw_type_id", F.when(F.col("type_id") == ID["GoStart"], ID["GoStartLocal"]).otherwise(F.col("type_id")))
    assert {r.trace_id for r in ordering.sequence_violations(local).collect()} == {"t1", "t3"}
    assert ordering.sequence_violations(ev.withColumn("version", F.lit(1005))).count() == 0


C6 = [
    e(1, "GoCreate", a=(1,)), e(2, "GoStart", g=1), e(3, "GoBlockRecv", g=1), e(4, "GoUnblock", a=(1,)), e(5, "GoStart", g=1), e(6, "FutileWakeup", g=1),
    e(7, "GoBlockRecv", g=1), e(8, "GoUnblock", a=(1,)), e(9, "GoStart", g=1),
]


def test_futile(spark):
    sent = [x if x["ts"] != 7 else e(7, "GoBlockSend", g=1) for x in C6]
    ev = table(spark, C6, sent)
    gone = ev.join(futile.futile_marks(ev), ["trace_id", "rec_offset"]).select("trace_id", "ts").collect()
    assert sorted(map(tuple, gone)) == [("t0", 4), ("t0", 5), ("t0", 6), ("t0", 7)]
    assert futile.without_futile(ev).count() == 14


STW = [e(0, "Gomaxprocs", a=(2,)), e(100, "GcStwStart"), e(150, "GcStwDone"), e(1000, "ProcStop")]
ONE_SWEEP = [e(0, "Gomaxprocs", a=(2,)), e(100, "GcSweepStart", g=5, p=1), e(160, "GcSweepDone", g=5, p=1), e(500, "HeapAlloc")]
ASSIST = [
    e(0, "Gomaxprocs", a=(2,)), e(50, "GoStart", g=5), e(100, "GcMarkAssistStart", g=5), e(120, "GoSched", g=5), e(150, "GoStart", g=5, p=1),
    e(180, "GcMarkAssistDone", g=5, p=1), e(200, "HeapAlloc"),
]


def series(df):
    out = {}
    for r in df.orderBy("trace_id", "series", "time").collect():
        out.setdefault((r.trace_id, r.series), []).append((r.time, r.util))
    return out


def test_utilisation_series(spark):
    ev = table(spark, STW, ONE_SWEEP, ASSIST)
    whole = series(U.mutator_utilisation(ev))
    assert whole["t0", 0] == [(0, 1), (100, 0), (150, 1), (1000, 0)]
    assert whole["t1", 0] == [(0, 1), (100, 0.5), (160, 1), (500, 0)]
    assert whole["t2", 0] == [(0, 1), (100, 0.5), (120, 1), (150, 0.5), (180, 1), (200, 0)]
    assert series(U.mutator_utilisation(ev, sweep=True))["t0", 0] == [(0, 1), (1000, 0)]
    each = series(U.mutator_utilisation(ev, per_proc=True))
    assert each["t1", 0] == [(0, 1), (500, 0)] and each["t1", 1] == [(0, 1), (100, 0), (160, 1), (500, 0)]
    assert each["t0", 0] == each["t0", 1] == [(0, 1), (100, 0), (150, 1), (1000, 0)]


@pytest.mark.parametrize("label,whole,each", [("GC (idle)", False, False), ("GC (dedicated)", True, False), ("GC (fractional)", True, True), ("other", False, False)])
def test_background_labels(spark, label, whole, each):
    ev = table(spark, [e(0, "Gomaxprocs", a=(2,)), e(10, "GoStartLabel", g=3, a=(3, 1, 9), s=[label]), e(30, "GoBlock", g=3), e(50, "HeapAlloc")])
    low = [(0, 1), (10, 0.5), (30, 1), (50, 0)]
    assert (series(U.mutator_utilisation(ev))["t0", 0] == low) is whole
    assert ((10, 0) in series(U.mutator_utilisation(ev, per_proc=True))["t0", 0]) is each


def test_processors_that_go_lose_their_work(spark):
    rows = [e(0, "Gomaxprocs", a=(2,)), e(10, "GcSweepStart", g=1, p=1), e(20, "Gomaxprocs", a=(1,)), e(30, "Gomaxprocs", a=(2,)), e(40, "HeapAlloc")]
    assert series(U.mutator_utilisation(table(spark, rows)))["t0", 0] == [(0, 1), (10, 0.5), (20, 1), (40, 0)]


def test_mmu(spark):
    ev = table(spark, STW)
    s = U.mutator_utilisation(ev, stw=True).cache()
    got = {r.window: round(r.mmu, 9) for r in M.mmu(s, [0, 50, 100, 200, 1000, 2000]).collect()}
    assert got == {0: 0, 50: 0, 100: 0.5, 200: 0.75, 1000: 0.95, 2000: 0.95}
    each = U.mutator_utilisation(table(spark, ONE_SWEEP), sweep=True, per_proc=True)
    assert {r.window: round(r.mmu, 9) for r in M.mmu(each, [60, 120, 500]).collect()} == {60: 0, 120: 0.5, 500: 0.88}
    quantiles = [0, 0.05, 0.1, 0.15, 0.25, 1]
    assert [round(r.util, 6) for r in M.mud(s, 100, quantiles).orderBy("q").collect()] == [0.5, 0.5, 0.7, 0.925, 1, 1]
    assert {round(r.util, 6) for r in M.mud(s, 100, quantiles, compat=True).collect()} == {0.5}
    assert {round(r.util, 6) for r in M.mud(s, 5000, [0.5]).collect()} == {0.95}
    assert M.mud(s, 100, []).count() == 0
    worst = [(r.time, round(r.util, 6)) for r in M.worst_windows(s, 100, 3).orderBy("util", "time").collect()]
    assert worst[0] == (50, 0.5) and len(worst) == 3 and all(abs(a[0] - b[0]) >= 100 for i, a in enumerate(worst) for b in worst[i + 1 :])


def test_mmu_against_dense_windows(spark):
    import random

    rng = random.Random(3)
    rows, model = [], {}
    for n in range(12):
        t, points = 0, []
        for _ in range(rng.randint(2, 9)):
            points.append((t, rng.choice([0.0, 0.25, 0.5, 1.0])))
            t += rng.randint(1, 9)
        rows += [(f"s{n}", 0, a, u) for a, u in points]
        model[f"s{n}"] = points
    s = spark.createDataFrame(rows, "trace_id string, series int, time long, util double")
    got = {(r.trace_id, r.window): r.mmu for r in M.mmu(s, [1, 3, 7, 100]).collect()}
    for name, points in model.items():
        end = points[-1][0]
        dense = [next(u for a, u in reversed(points) if a <= x) for x in range(end)]
        for w in (1, 3, 7, 100):
            k = min(w, end)
            want = min(sum(dense[i : i + k]) / k for i in range(end - k + 1))
            assert abs(got[name, w] - want) < 1e-9


C10 = [
    e(0, "HeapAlloc"), e(10, "UserTaskCreate", g=5, a=(1, 0), s=["a"]), e(20, "UserTaskCreate", g=5, a=(2, 1), s=["b"]), e(40, "UserTaskEnd", g=5, a=(2,)),
    e(50, "UserLog", g=6, a=(1,), s=["k", "v"]), e(60, "UserTaskCreate", g=7, a=(4, 3), s=["c"]), e(100, "HeapAlloc"),
]


def test_tasks(spark):
    got = {r.task_id: r for r in K.tasks(table(spark, C10)).collect()}
    a, b = got[1], got[2]
    assert (a.completed, a.first_ts, a.last_ts, a.end_or_world_ts, a.duration, a.goroutines, a.children) == (False, 10, 50, 100, 90, [5, 6], [2])
    assert (b.completed, b.first_ts, b.last_ts, b.duration, b.parent_id, b.name) == (True, 20, 40, 20, 1, "b")
    assert (got[3].name, got[3].children, got[3].first_ts, got[3].parent_id) == ("", [4], 0, None)


def test_overlaps(spark):
    ev = table(spark, [e(0, "HeapAlloc"), e(10, "UserTaskCreate", g=9, a=(1,), s=["a"]), e(25, "GoStart", g=5), e(65, "HeapAlloc", g=5), e(75, "HeapAlloc", g=5), e(75, "HeapAlloc", g=6), e(80, "GcStart", p=GC_P), e(100, "HeapAlloc")])
    reg = spark.createDataFrame([("t0", 1, 5, "x", i, a, i + 1, b) for i, (a, b) in enumerate([(20, 40), (30, 60), (70, 80)])], "trace_id string, task_id long, g long, name string, start_offset long, start_ts long, end_offset long, end_ts long")
    t = K.tasks(ev, reg)
    at = {r.rec_offset: (r.g, r.ts) for r in ev.collect()}
    assert {at[r.rec_offset] for r in K.overlapping_instants(ev, t, reg).collect()} == {(5, 25), (5, 75), (0, 80)}
    link = spark.createDataFrame([("t0", 12, 75, 5), ("t0", 16, 90, 0)], "trace_id string, rec_offset long, link_ts long, link_g long")
    assert sorted((at[r.rec_offset], r.overlap) for r in K.overlapping_durations(ev, t, reg, link).collect()) == [((0, 80), 10), ((5, 25), 20)]


def test_related_goroutines(spark):
    rows = [e(1, "UserTaskCreate", g=1, a=(1,), s=["a"]), e(2, "GoUnblock", g=2, a=(1,)), e(3, "GoUnblock", g=3, a=(2,)), e(4, "UserTaskEnd", g=1, a=(1,)), e(5, "GoUnblock", g=4, a=(1,))]
    ev = table(spark, rows)
    t = K.tasks(ev)
    assert [sorted(r.g for r in K.related_goroutines(ev, t, d).collect()) for d in (0, 1, 2)] == [[1], [1, 2], [1, 2, 3]]


def test_order_and_ties(spark):
    # at 50 the unblock on processor 1 must come before the start it causes on processor 0
    rows = [e(0, "GoCreate", a=(1,)), e(1, "GoStart", g=1, a=(1, 1)), e(2, "GoBlock", g=1), e(50, "GoStart", g=1, p=0, a=(1, 4)), e(50, "GoUnblock", g=2, p=1, a=(1, 3))]
    got = ordering.ordered(table(spark, rows)).orderBy("ord").collect()
    assert [(r.type_id, r.ord) for r in got] == [(13, 0), (14, 1), (20, 2), (21, 3), (14, 4)]
    ev = table(spark, [e(5, "HeapAlloc"), e(4, "HeapAlloc"), e(6, "HeapAlloc")])
    assert [r.rec_offset for r in ordering.order_violations(ev).collect()] == [11]
    raw = spark.createDataFrame([(38,), (39,), (40,), (14,)], "raw_type_id int")
    assert sorted(r.type_id for r in ordering.renamed(raw).collect()) == [14, 14, 21, 29]


def test_exit_repair(spark):
    rows = [e(1, "GoSysBlock", g=1), e(9, "GoSysExit", g=1, a=(1, 0, 5)), e(10, "GoSysExit", g=2, a=(2, 0, 0)), e(12, "GoSysBlock", g=3), e(13, "GoSysExit", g=3, a=(3, 0, 11))]
    assert sorted((r.ts, r.blocked_ts, r.repaired_ts, r.rule_id) for r in ordering.exit_repair(table(spark, rows)).collect()) == [(9, 1, 5, None), (10, None, 10, "stray exit"), (13, 12, 11, "exit before block")]


@pytest.mark.parametrize(
    "rows,rule",
    [
        ([e(1, "ProcStart"), e(2, "ProcStart")], "proc"), ([e(1, "ProcStop")], "proc"), ([e(1, "GcStart"), e(2, "GcStart")], "gc"), ([e(1, "GcDone")], "gc"),
        ([e(1, "GcStwStart"), e(2, "GcStwStart")], "stw"), ([e(1, "GcStwDone")], "stw"), ([e(1, "GcSweepStart"), e(2, "GcSweepStart")], "sweep"), ([e(1, "GcSweepDone")], "sweep"),
        ([e(1, "GcMarkAssistStart"), e(2, "GcMarkAssistStart")], "assist"), ([e(1, "UserTaskCreate", a=(1,), s=["x"]), e(2, "UserTaskCreate", a=(1,), s=["x"])], "task"),
    ],
)
def test_bracket_violations(spark, rows, rule):
    assert [r.rule_id for r in linking.bracket_violations(table(spark, rows), meta(spark)).collect()] == [rule]


def test_stops_of_the_world_by_processor_before_1010(spark):
    rows = [e(1, "GcStwStart", p=0), e(2, "GcStwStart", p=1), e(3, "GcStwDone", p=0), e(4, "GcStwDone", p=1)]
    got = lambda version: [r.rec_offset for r in linking.bracket_violations(table(spark, rows), meta(spark, version=version)).collect()]
    assert got(1009) == [] and sorted(got(1010)) == [11, 13]


def test_region_frames(spark):
    rows = [e(5, "UserRegion", g=1, a=(1, 0), s=["b"], stack=3), e(6, "UserRegion", g=1, a=(1, 1), s=["b"]), e(7, "UserRegion", g=1, a=(1, 1), s=["x"]), e(9, "UserRegion", g=1, a=(1, 0), s=["c"], stack=9)]
    ev = table(spark, rows)
    stacks = spark.createDataFrame([("t0", 3, [(16, "f", "a.go", 1)])], "trace_id string, stack_id long, frames array<struct<pc:long,fn:string,file:string,line:int>>")
    got = sorted(tuple(r)[2:] for r in G.region_frames(G.user_regions(ev), ev, stacks).collect() if r.start_offset)
    assert got == [(10, 2, "f", 16), (13, 3, None, None)] and G.region_frames(G.user_regions(ev), ev, stacks).where("start_offset is null and place = 1").count() == 1

def test_state_violations(spark):
    bad = {
        "exists": [e(1, "GoCreate", a=(1,)), e(2, "GoCreate", a=(1,))], "start": [e(1, "GoStart", g=1)], "wait": [e(1, "GoWaiting", g=1)], "unblock": [e(1, "GoCreate", a=(1,)), e(2, "GoUnblock", a=(1,))],
        "exit": [e(1, "GoCreate", a=(1,)), e(2, "GoSysExit", g=1, a=(1,))], "ok": C1,
    }
    got = {r.trace_id for r in linking.state_violations(table(spark, *bad.values())).collect()}
    assert got == {f"t{i}" for i, k in enumerate(bad) if k != "ok"}
    strings = spark.createDataFrame([("t", 0, "x"), ("t", 1, ""), ("t", 2, "a"), ("t", 2, "b"), ("t", 3, "c"), ("t", 3, "c")], "trace_id string, string_id long, val string")
    assert {(r.string_id, r.rule_id) for r in linking.dictionary_violations(strings).collect()} == {(0, "zero id"), (1, "empty string"), (2, "several values")}


def test_processor_and_region_violations(spark):
    bad = [
        [e(1, "GoStart", g=1), e(2, "GoStart", g=2)], [e(1, "GoStart", g=1), e(2, "ProcStop")], [e(1, "GoStart", g=1), e(2, "GoSched", g=2)], [e(1, "GoSched", g=0)],
        [e(1, "GoStart", g=1), e(2, "GoUnblock", g=3, a=(9,))], [e(1, "GoStart", g=1), e(2, "GoUnblock", g=3, p=1000001, a=(9,)), e(3, "GoEnd", g=1), e(4, "GoCreate", a=(5,)), e(5, "ProcStop")],
    ]
    got = [(r.trace_id, r.rec_offset) for r in linking.processor_violations(table(spark, *bad)).collect()]
    assert sorted(got) == [("t0", 11), ("t1", 11), ("t2", 11), ("t3", 10), ("t4", 11)]
    region = lambda ts, mode, task, name: e(ts, "UserRegion", g=1, a=(task, mode), s=[name])
    rows = [[region(1, 0, 1, "a"), region(2, 1, 1, "a")], [region(1, 0, 1, "a"), region(2, 1, 2, "a")], [region(1, 0, 1, "a"), region(2, 1, 1, "b")], [region(1, 1, 1, "x"), region(2, 0, 1, "a")]]
    assert sorted(r.trace_id for r in linking.region_violations(table(spark, *rows)).collect()) == ["t1", "t2"]


def test_task_descendants(spark):
    got = {(r.ancestor_id, r.task_id, r.distance) for r in K.descendants(K.tasks(table(spark, C10))).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (2, 2, 0), (3, 3, 0), (3, 4, 1), (4, 4, 0)}


def test_dictionaries_and_pseudo_processors(spark):
    ev = table(spark, [e(1, "GoUnblock", g=7, a=(1,), stack=4), e(2, "GoSysExit", g=1, a=(1,)), e(3, "GcStart", stack=5), e(4, "GoUnblock", g=8, a=(1,))])
    got = E.with_pseudo_processors(ev, meta(spark, timers=[7])).orderBy("ord").collect()
    assert [r.pseudo_p for r in got] == [1000001, 1000003, 1000004, 0]
    stacks = spark.createDataFrame([("t0", 4, [{"pc": 1, "fn": "f", "file": "x", "line": 2}, None])], "trace_id string, stack_id long, frames array<struct<pc:long,fn:string,file:string,line:int>>")
    from skein.functions.scalars import frames_text, unsigned_text

    shown = E.with_stacks(ev, stacks).orderBy("ord").select(frames_text(F.col("frames")).alias("t")).collect()
    assert [r.t for r in shown] == ["f x:2", None, None, None]
    assert spark.range(1).select(unsigned_text(F.lit(-1).cast("long")).alias("x")).first().x == str(2**64 - 1)
    blocked = table(spark, [e(1, "GoBlockNet", g=1), e(2, "GoUnblock", a=(1,)), e(3, "GoBlock", g=1), e(4, "GoUnblock", a=(1,))])
    assert [r.rec_offset for r in linking.netpoll_unblocks(blocked).collect()] == [11]


def test_ties_that_nothing_orders(spark):
    made = [e(0, "GoCreate", p=0, a=(1, 0)), e(5, "GoStart", p=0, g=1, a=(1, 1))]
    fits = [*made, e(9, "GoSched", p=0, g=1), e(9, "GoStart", p=1, g=1, a=(1, 2))]
    twice = [*made, e(9, "GoSched", p=0, g=1), e(9, "GoStart", p=1, g=1, a=(1, 2)), e(9, "GoStart", p=2, g=1, a=(1, 3)), e(9, "GoStart", p=3, g=1, a=(1, 4))]
    number = [*made, e(9, "GoSched", p=0, g=1), e(9, "GoStart", p=1, g=1, a=(1, 2)), e(9, "GoSched", p=2, g=1), e(9, "GoStart", p=3, g=1, a=(1, 7))]
    ev = table(spark, fits, twice, number)
    got = [(r.trace_id, r.rec_offset - 10) for r in ordering.tie_violations(ev).collect()]
    # three starts with one stop between them; a number that no other event of the tie leads to, and the stop that waits for it
    assert sorted(got) == [("t1", 5), ("t2", 4), ("t2", 5)]
    assert ordering.tie_violations(ev.where("false")).count() == 0
    assert ordering.ordered(ev.drop("ord")).count() == ev.count()
