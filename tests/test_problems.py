"""The core operators for training data on small tables, with the cases that dirt makes."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import catalog
from skein.operators import features, heavy, hierarchy, intervals, quantiles, references
from skein.plans import problems

INTERVALS = "trace_id string, g long, start_ts long, end_ts long"
EVENTS = "trace_id string, ts long"


def brute_periods(rows, bounds):
    by = {}
    for t, g, s, e in rows:
        s = bounds.get(t, (None, None))[0] if s is None else s
        e = bounds.get(t, (None, None))[1] if e is None else e
        if g is not None and s is not None and e is not None and s <= e:
            by.setdefault((t, g), []).append((s, e))
    out = set()
    for key, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "period", *m) for m in merged} | {(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("bits", [1, 4, 32, None])
def test_periods_and_gaps(spark, bits):
    rng = random.Random(bits or 7)
    rows = []
    for _ in range(500):
        s = rng.randint(-50, 2000)
        rows.append((rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 3, 3, 3]), s, s + rng.choice([-3, 0, 1, 2, 5, 8, 90])))
    rows += [("a", 5, None, 7), ("a", 5, 9, None), ("b", 6, None, None), ("c", 7, None, 3), ("a", 8, 1, 2), ("a", 8, 3, 4), ("a", 8, 1, 2), ("a", 9, None, -999)]
    bounds = {"a": (-60, 2100), "b": (5, 900)}
    df = spark.createDataFrame(rows, INTERVALS)
    ev = spark.createDataFrame([(t, x) for t, b in bounds.items() for x in b] + [("a", None), (None, None)], EVENTS)
    got = [tuple(r) for r in intervals.periods_and_gaps(df, ev, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows, bounds)


def test_bitmaps_of_a_hot_key_are_united(spark):
    rng = random.Random(2)
    rows = [("a", 1, s, s + rng.randint(0, 40)) for s in (rng.randint(0, 400_000) for _ in range(30_000))] + [("b", 2, 5, 6)]
    df = spark.createDataFrame(rows, INTERVALS).repartition(8)
    ev = spark.createDataFrame([("a", 0)], EVENTS)
    widths = {r.trace_id: r.bits for r in intervals.shard_widths(df).collect()}
    assert 400_040 >> widths["a"] >= 15 and widths["b"] <= 2
    for bits in (None, 40):
        got = [tuple(r) for r in intervals.periods_and_gaps(df, ev, bits).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_periods(rows, {})


def test_periods_of_clashing_and_empty_tables(spark):
    ev = spark.createDataFrame([("a", 0), ("a", 9)], EVENTS).withColumn("shard", F.lit(1)).withColumn("g", F.lit("x"))
    df = spark.createDataFrame([("a", 1, 2, None)], INTERVALS)
    for c in ("shard", "runs", "lo", "hi", "kind", "_kind", "pos", "whole", "x", "_first", "width", "bits", "_b"):
        df = df.withColumn(c, F.lit("clash"))
    assert [tuple(r) for r in intervals.periods_and_gaps(df, ev).collect()] == [("a", 1, "period", 2, 9)]
    assert intervals.periods_and_gaps(df.where("false"), ev).count() == 0
    assert intervals.periods_and_gaps(df, ev.where("false")).count() == 0


FEATURES = "trace_id string, g long, rec_offset long, type_id int, string_args array<string>, ts long, link_ts long"


def feature_rows():
    return [
        ("t", 1, 10, 13, None, 5, 9), ("t", 1, 10, 13, None, 5, 9), ("t", 1, 20, 13, None, 8, None), ("t", 1, 1 << 19, 47, ["r"], 50, 60), ("t", 1, 30, 47, ["s"], None, 60),
        ("t", 1, 40, 47, [], 51, None), ("t", 1, 50, 48, None, 52, None), ("t", 1, 60, None, None, 53, None), ("t", 1, 70, 99, ["z"], 54, None), ("t", None, 80, 13, None, 100, None),
        ("t", 2, None, 14, None, 7, 6), ("u", 1, 10, 13, None, None, None), (None, 1, 10, 13, None, 3, None),
    ]


def test_features(spark):
    types = catalog.event_types(spark)
    ev = spark.createDataFrame(feature_rows(), FEATURES).withColumn("feature", F.lit(1)).withColumn("_salt", F.lit(1)).withColumn("n", F.lit("x")).withColumn("_end", F.lit(0))
    names = sorted(r.feature for r in features.type_list(ev, types).collect())
    assert set(names) >= {"GoCreate", "UserRegion:r", "UserRegion:s", "UserRegion", "UserLog", "unknown:null", "unknown:99"} and len(names) == len(set(names)) == 49 + 4
    got = {(r.trace_id, r.g): {f: (n, s, x) for f, n, s, x in zip(names, r.n, r.since_last, r.link_time)} for r in features.entity_features(ev, types).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    one = got["t", 1]
    assert one["GoCreate"] == (2, 92, 4) and one["UserRegion:r"] == (1, 50, 10) and one["UserRegion:s"] == (1, None, 0) and one["UserRegion"] == (1, 49, 0)
    assert one["unknown:null"][0] == one["unknown:99"][0] == one["UserLog"][0] == 1 and one["GoStart"] == (0, None, 0)
    assert got["t", 2]["GoStart"] == (1, 93, -1) and got["u", 1]["GoCreate"] == (1, None, 0) and got[None, 1]["GoCreate"] == (1, 0, 0)
    for per in (1, 3, 10**6):
        again = features.feature_stats(ev, types, per=per).where("trace_id = 't' and g = 1 and feature = 'GoCreate'").first()
        assert (again.n, again.last_ts, again.link_time) == (2, 8, 4)
    assert features.entity_features(ev.where("false"), types).count() == 0
    with pytest.raises(ValueError):
        features.entity_features(ev, types, max_features=10)


def test_heavy_groups_are_spread(spark):
    rows = [("t", 1, i, 13, None, i, None) for i in range(600)] * 2 + [("t", g, 1, 14, None, 1, 2) for g in range(300)]
    ev, types = spark.createDataFrame(rows, FEATURES), catalog.event_types(spark)
    heavy = features.heavy_groups(ev, ("trace_id", "g"), 100).collect()
    assert [(r.g, r.type_id, r.salts) for r in heavy] == [(1, 13, 80)]
    got = {r.g: r.n for r in features.feature_stats(ev, types, per=100).where("feature = 'GoCreate'").collect()}
    assert got == {1: 600}


def test_references(spark):
    types = catalog.event_types(spark)
    ev = "trace_id string, rec_offset long, type_id int, a0 long, a1 long, a2 long, stack_id long, link_offset long, loaded_at timestamp_ntz"
    day = "2026-01-0{} 00:00:00".format
    rows = [
        ("t", 1, 13, 5, 7, None, 3, 2, 2), ("t", 1, 13, 5, 7, None, 3, 2, 3), ("t", 2, 14, 6, 0, 0, 0, 99, 2), ("t", 3, 48, 4, 8, 5, None, None, 2), ("t", 4, None, 5, 5, 5, 0, 0, 2),
        ("t", 5, 14, 9, 1, 1, 4, None, None), ("u", 6, 14, 5, 1, 1, 0, 1, 2), (None, 7, 14, 5, 0, 0, 3, 1, 2), ("t", None, 14, 77, 0, 0, 3, 1, 2), ("t", 8, 45, 4, 12, 8, 0, 5, 1),
    ]
    events = spark.createDataFrame([(*r[:-1], str(r[-1])) for r in rows], ev.replace("timestamp_ntz", "string")).withColumn("loaded_at", F.expr("to_timestamp_ntz(case when loaded_at <> 'None' then concat('2026-01-0', loaded_at) end, 'yyyy-MM-dd')"))
    events = events.withColumn("key", F.lit(1)).withColumn("target", F.lit("x")).withColumn("status", F.lit(0)).withColumn("since", F.lit(0))

    def parent(name, *rows):
        df = spark.createDataFrame([("t", k, a, d) for k, a, d in rows], f"trace_id string, {name} long, a string, d string")
        return df.selectExpr("trace_id", name, "to_timestamp_ntz(a) as loaded_at", "to_timestamp_ntz(d) as deleted_at", "1 as alive")

    tables = {
        "goroutines": parent("g", (5, day(1), None), (6, day(4), None), (6, day(1), day(2)), (9, day(9), None)),
        "stacks": parent("stack_id", (3, day(1), day(2)), (7, day(1), None), (7, day(9), day(9)), (4, None, None)),
        "tasks": parent("task_id", (4, day(1), None)).drop("deleted_at"),
        "strings": parent("string_id", (8, day(2), None)),
        "trace_events": events,
    }
    got = {(r.trace_id, r.rec_offset, r.field): r.status for r in references.orphan_references(events, types, tables).collect()}
    assert got == {
        ("t", 1, "stack_id"): "deleted", ("t", 2, "a0"): "later", ("t", 2, "link_offset"): "missing", ("u", 6, "a0"): "missing", ("u", 6, "link_offset"): "missing",
        ("t", 8, "a1"): "missing", ("t", 8, "a2"): "later",
    }
    counts = {(r.target, str(r.day), r.status): r.n for r in references.orphan_counts(references.orphan_references(events, types, tables)).collect()}
    assert counts["trace_events", "2026-01-02", "missing"] == 2 and counts["stacks", "2026-01-02", "deleted"] == 1
    assert references.orphan_references(events.where("false"), types, tables).count() == 0


def solve(parents, t, i):
    seen, at = [], i
    while True:
        seen.append(at)
        up = parents[t, at]
        if up is None or (t, up) not in parents:
            return seen[-1], len(seen) - 1, None, None, tuple(reversed(seen))
        if up in seen:
            cycle = seen[seen.index(up) :]
            return None, None, min(cycle), "on" if i in cycle else "below", None
        at = up


@pytest.mark.parametrize("rows", [3, 40, 50_000])
def test_hierarchy(spark, rows):
    rng = random.Random(rows)
    parents = {}
    for t in ("a", None):
        for i in range(1, 150):
            near = rng.choice([i + 1, i - 1, max(1, i - 9), i + 7, i])
            parents[t, i * 3] = None if rng.random() < 0.05 else 3 * (rng.randint(1, 170) if rng.random() < 0.4 else near)
    df = spark.createDataFrame([(t, i, p) for (t, i), p in parents.items()], "trace_id string, task_id long, parent_id long")
    for c in ("id", "up", "low", "top", "cycle", "_block", "path"):
        df = df.withColumn(c, F.lit("clash"))
    got = {(r.trace_id, r.task_id): (r.root_id, r.depth, r.cycle_id, r.place, None if r.path is None else tuple(r.path)) for r in hierarchy.hierarchy(df, fragment_rows=rows).collect()}
    assert got == {k: solve(parents, *k) for k in parents}
    short = {(r.trace_id, r.task_id): (r.cycle_id, r.place) for r in hierarchy.endless(hierarchy.hierarchy(df, False, rows)).collect()}
    assert short == {k: v[2:4] for k, v in got.items() if v[2] is not None}
    if rows == 40:
        pairs = {(r.trace_id, r.ancestor_id, r.task_id, r.distance) for r in hierarchy.closure(hierarchy.hierarchy(df, fragment_rows=rows)).collect()}
        assert pairs == {(t, a, i, len(v[4]) - 1 - k) for (t, i), v in got.items() if v[4] for k, a in enumerate(v[4])}


@pytest.mark.parametrize("shape", ["chain", "tree", "cycle"])
def test_fragments_are_bounded_whatever_the_ids(spark, monkeypatch, shape):
    n, most = 6_000, 500
    rng = random.Random(5)
    ids = list(range(1, n + 1))
    rng.shuffle(ids)
    up = {"chain": lambda k: ids[k - 1], "tree": lambda k: ids[rng.randrange(k)], "cycle": lambda k: ids[k - 1]}[shape]
    parents = {("t", ids[k]): up(k) if k else (ids[-1] if shape == "cycle" else None) for k in range(n)}
    sizes, kept = [], hierarchy.durable

    def noted(made):
        table = kept(made)
        if "fragment" in table.columns and "steps" in table.columns:
            sizes.extend(r["count"] for r in table.where("fragment is not null").groupBy("fragment").count().collect())
        return table

    monkeypatch.setattr(hierarchy, "durable", noted)
    df = spark.createDataFrame([(t, i, p) for (t, i), p in parents.items()], "trace_id string, task_id long, parent_id long")
    got = {r.task_id: (r.root_id, r.depth, r.cycle_id, r.place) for r in hierarchy.hierarchy(df, False, most).collect()}
    if shape == "cycle":
        assert set(got.values()) == {(None, None, 1, "on")} and len(got) == n
    else:
        depth = {ids[0]: 0}
        for k in range(1, n):
            depth[ids[k]] = depth[parents["t", ids[k]]] + 1
        assert got == {i: (ids[0], d, None, None) for i, d in depth.items()}
    assert max(sizes) <= most and sum(sizes) >= n


def climbed(parents, t, i):
    """Each distinct ancestor of a node and its least distance."""
    found, at = {}, i
    while at is not None and (t, at) in parents and at not in found:
        found[at] = len(found)
        at = parents[t, at]
    return found


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_on_and_below_cycles(spark, seed):
    rng = random.Random(seed)
    parents = {("c", 1): 2, ("c", 2): 3, ("c", 3): 1, ("c", 4): 2, ("c", 5): 4, ("c", 6): 6, ("c", 7): 6, ("c", 8): None, ("c", 9): 8, ("c", 10): 77}
    for t in ("a", None):
        for i in range(1, 90):
            parents[t, i] = None if rng.random() < 0.03 else rng.randint(1, 95)
    df = spark.createDataFrame([(t, i, p) for (t, i), p in parents.items()], "trace_id string, task_id long, parent_id long")
    rows = [tuple(r) for r in hierarchy.all_descendants(df).select("trace_id", "ancestor_id", "task_id", "distance").collect()]
    want = {(t, a, i, n) for t, i in parents for a, n in climbed(parents, t, i).items()}
    assert len(rows) == len(want) and set(rows) == want
    assert {x[1:] for x in want if x[0] == "c" and x[2] == 5} == {(5, 5, 0), (4, 5, 1), (2, 5, 2), (3, 5, 3), (1, 5, 4)}
    ended = {tuple(r) for r in hierarchy.closure(hierarchy.hierarchy(df)).select("trace_id", "ancestor_id", "task_id", "distance").collect()}
    assert ended == {x for x in want if solve(parents, x[0], x[2])[0] is not None} and len(ended) < len(want)
    assert hierarchy.all_descendants(df.where("false")).count() == 0


def test_parent_links(spark):
    rows = [
        ("t", 1, None, [2, 3], "1"), ("t", 2, 0, None, "1"), ("t", 3, 2, [None], "1"), ("t", 3, 1, None, "2"), ("t", 4, None, [2], None), ("t", 5, 77, None, "1"), ("t", 5, 77, None, "1"),
        ("t", None, 1, [5], "1"), ("t", 6, None, [6], "1"), (None, 7, None, [8], "1"), (None, 8, None, None, None),
    ]
    df = spark.createDataFrame(rows, "trace_id string, task_id long, parent_id long, children array<long>, loaded_at string")
    got = {(r.trace_id, r.task_id): r.parent_id for r in hierarchy.parent_links(df).collect()}
    assert got == {("t", 1): None, ("t", 2): 1, ("t", 3): 1, ("t", 4): None, ("t", 5): 77, ("t", 6): 6, (None, 7): None, (None, 8): 7}
    empty = hierarchy.hierarchy(hierarchy.parent_links(df.where("false")))
    assert empty.count() == 0 and "path" in empty.columns


def test_percentiles(spark):
    rng = random.Random(1)
    rows = []
    for name, n in (("heavy", 6000), ("", 50), (None, 3), ("one", 1), ("same", 200)):
        for i in range(n):
            v = 7 if name == "same" else int(rng.paretovariate(0.4) * 1000) * rng.choice([1, 1, 1, 1, -1])
            rows.append((name, i % 3, v))
    rows += [("one", 0, None), ("gone", 0, 5), ("nothing", 0, None)]
    df = spark.createDataFrame(rows, "name string, day int, v long").withColumn("_code", F.lit("x")).withColumn("level", F.lit("x"))
    qs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    cells = quantiles.sketch(df, ["name"], "v")
    minus = quantiles.sketch(df.where("name = 'gone'"), ["name"], "v", F.lit(-1))
    both = quantiles.merge(cells.unionByName(minus), ["name"])
    got = {(r.name, r.q): r for r in quantiles.percentiles(both, ["name"], qs).collect()}
    assert {k[0] for k in got} == {"heavy", "", None, "one", "same"}
    for (name, q), r in got.items():
        values = sorted(v for n, _, v in rows if n == name and v is not None)
        assert r.n == len(values)
        rank = max(1, -(-int(q * len(values) * 10**9) // 10**9))
        slack = r.rank_error * len(values)
        # the rank the value has among the group's, up to the code's own error, is the one wanted up to the stated error
        width = abs(r.value) * 2.0**-quantiles.MANTISSA
        below, upto = sum(v < r.value - width for v in values), sum(v <= r.value + width for v in values)
        assert below - slack < rank <= upto + slack
        assert r.rank_error <= 0.01
    checked = quantiles.checked(df.where("name is null or name <> 'gone'"), ["name"], "v", quantiles.percentiles(both, ["name"], qs)).collect()
    assert len(checked) == len(got) and all(r.within and r.small for r in checked)
    days = quantiles.merge(quantiles.sketch(df.where("name <> 'gone'"), ["name", "day"], "v"), ["name"])
    again = {(r.name, r.q): r.value for r in quantiles.percentiles(days, ["name"], qs).collect()}
    assert again == {k: r.value for k, r in got.items() if k[0] is not None}
    assert quantiles.percentiles(quantiles.sketch(df.where("false"), ["name"], "v"), ["name"], qs).count() == 0


def test_a_heavy_group_is_sketched_in_several_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("g"), F.col("id").cast("string"))).otherwise("hot").alias("name"), (F.col("id") % 5).alias("_code"), (F.col("id") * 7919 % 20_011).alias("v"))
    assert [(r.name, r._salts) for r in quantiles.heavy_groups(df, ["name"]).collect()] == [("hot", 254)]
    got = quantiles.percentiles(quantiles.sketch(df, ["name"], "v"), ["name"], [0.5])
    assert got.count() == 201
    found = got.where("name = 'hot'").first()
    assert found.n == 19_800 and found.rank_error <= 0.01 and abs(found.value - 10_005) <= 0.01 * 20_011
    whole = quantiles.percentiles(quantiles.sketch(df, [], "v"), [], [0.25, 0.5]).collect()
    assert [r.n for r in whole] == [20_000] * 2 and all(abs(r.value - r.q * 20_011) <= 200 for r in whole)


def test_codes_keep_order_and_decode(spark):
    values = sorted({0, 1, -1, 1023, 1024, 1025, 2047, 2048, 2**31, 2**62, 2**63 - 1, -(2**63), -(2**63) + 1, *(s * int(1.7**k) for k in range(1, 80) for s in (1, -1))})
    codes = [r.c for r in spark.createDataFrame([(v,) for v in values], "v long").select(quantiles.encode(F.col("v")).alias("c"), "v").orderBy("v").collect()]
    assert codes == sorted(codes) and 0 <= codes[0] and codes[-1] < 2**quantiles.BITS
    for v, c in zip(values, codes):
        assert abs(quantiles.decode(c) - v) <= abs(v) * 2.0 ** -(quantiles.MANTISSA)


def test_heavy_keys(spark):
    rows = [(1, 1)] * 50 + [(2, None)] * 2 + [(None, 3)] * 3 + [(i, 9) for i in range(100, 145)]
    df = spark.createDataFrame(rows, "g long, p int").withColumn("n", F.lit("x")).withColumn("field", F.lit("x")).withColumn("_k0", F.lit(0))
    assert {tuple(r) for r in heavy.heavy_keys(df, ["g", "p"]).collect()} == {("g", 1), ("g", 2), ("p", 1), ("p", 3), ("p", 9)}
    assert heavy.heavy_keys(df.where("false"), ["g", "p"]).count() == 0
    counts = {(r.field, r.key_id): r.n for r in heavy.key_counts(df, ["g", "p"]).collect()}
    assert counts["g", None] == 3 and counts["p", None] == 2 and counts["p", 9] == 45
    ev = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (1, None, 7), (None, 1, None)], "g long, ts long, link_ts long")
    got = {r.g: tuple(r)[1:] for r in heavy.load_by_key(ev, "g").collect()}
    assert got == {1: (3, 5, 5, 3, 8), None: (1, 1, 1, 0, None)}


def test_load_of_goroutines_of_several_traces(spark):
    rows = [("a", 1, 5, 9), ("a", 1, 7, None), ("b", 1, 1, 2), ("b", 1, 1, 2), ("b", None, 3, None), (None, 1, 4, 5), ("a", None, None, 5)]
    ev = spark.createDataFrame(rows, "trace_id string, g long, ts long, link_ts long")
    got = {(r.trace_id, r.g): tuple(r)[2:] for r in heavy.load_by_key(ev, "trace_id", "g").collect()}
    assert got == {("a", 1): (2, 5, 7, 1, 4), ("b", 1): (2, 1, 1, 2, 2), ("b", None): (1, 3, 3, 0, None), (None, 1): (1, 4, 4, 1, 1), ("a", None): (1, None, None, 1, None)}


@pytest.mark.parametrize("name,key", [("p6_by_trace_goroutine", "g"), ("p6_by_trace_processor", "p")])
def test_loads_by_trace(spark, tmp_path, name, key):
    rows = [("a", 1, 5, 9), ("a", 1, 7, None), ("b", 1, 1, 2), ("b", 2, 6, None)]
    spark.createDataFrame(rows, f"trace_id string, {key} long, ts long, link_ts long").write.parquet(f"{tmp_path}/trace_events.parquet")
    got = {(r.trace_id, r[key]): (r.events, r.first_ts, r.last_ts) for r in problems.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {("a", 1): (2, 5, 7), ("b", 1): (1, 1, 1), ("b", 2): (1, 6, 6)}


def test_rows_without_a_key_are_records_of_their_own(spark, tmp_path):
    rows = [("t", 1, 10, 13, None, 5, 9), ("t", 1, 10, 13, None, 5, 9), ("t", 1, None, 13, None, 5, 9), ("t", 1, None, 13, None, 5, 9), ("t", 1, None, 13, None, 8, 9), ("t", 1, None, 13, None, 20, None), ("t", 1, None, 13, None, None, 90)]
    ev, types = spark.createDataFrame(rows, FEATURES), catalog.event_types(spark)
    got = features.feature_stats(ev, types).collect()
    assert [(r.feature, r.n, r.last_ts, r.link_time) for r in got] == [("GoCreate", 6, 20, 4 + 4 + 4 + 1)]
    wide, at = features.entity_features(ev, types).first(), sorted(r.feature for r in features.type_list(ev, types).collect()).index("GoCreate")
    assert (wide.n[at], wide.since_last[at], wide.link_time[at]) == (6, 0, 13)
    tasks = [("t", 1, "x", 5, "2026-01-01"), ("t", 1, "x", 7, "2026-01-02"), *(("t", None, "x", n, "2026-01-01") for n in (100, 100, 300)), ("t", None, "y", 9, None)]
    spark.createDataFrame(tasks, "trace_id string, task_id long, name string, duration long, at string").selectExpr("trace_id", "task_id", "name", "duration", "to_timestamp_ntz(at) as loaded_at").write.parquet(f"{tmp_path}/tasks.parquet")
    for name in ("p5_percentiles", "p5_merged_days"):
        assert {r.name: r.n for r in problems.QUERIES[name](spark, str(tmp_path)).collect()} == {"x": 4, "y": 1}
