"""Windows cut into blocks against plain ones; as-of lookups and integrals against loops."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import spans, stepfn, windows
from skein.operators.brackets import match


def rows(spark, n=400):
    rng = random.Random(4)
    return spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 300), i, rng.choice([None, 1, 2, 5])) for i in range(n)], "k string, t long, i long, v long").cache()


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_blocked_windows(spark, bits):
    df, keys, order = rows(spark), ["k"], ["t", "i"]
    for f, extra in ((windows.lead_over, {}), (windows.last_over, {}), (windows.last_over, {"inclusive": True}), (windows.sum_over, {}), (windows.sum_over, {"inclusive": False})):
        plain = f(df, keys, order, F.col("v"), "x", **extra).select("i", "x").collect()
        cut = f(df, keys, order, F.col("v"), "x", bits=bits, **extra)
        assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, cut.select("i", "x").collect()), key=str)
        assert cut.columns == [*df.columns, "x"]
    numbered = windows.number_over(df, keys, order, "n", bits=bits).where("k = 'a'").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, len(numbered) + 1)) and [r.t for r in numbered] == sorted(r.t for r in numbered)


def test_blocked_minimum(spark):
    df, keys, order = rows(spark), ["k"], ["t", "i"]
    for extra in ({}, {"inclusive": False}):
        plain = windows.min_over(df, keys, order, F.col("v"), "x", **extra).select("i", "x").collect()
        for bits in (0, 3, 20):
            cut = windows.min_over(df, keys, order, F.col("v"), "x", bits=bits, **extra)
            assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, cut.select("i", "x").collect()), key=str)


@pytest.mark.parametrize("longest", [0, 3, 60, 5000])
def test_points_in_spans(spark, longest):
    rng = random.Random(longest)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *(rng.randint(-3000, 6000) for _ in range(40))]), i) for i in range(400)]
    made = [(rng.choice(["a", "b", None]), s, s + rng.choice([-1, 0, rng.randint(0, longest), rng.randint(0, longest)]), 1000 + i) for i, s in enumerate(rng.randint(-3000, 6000) for _ in range(150))]
    p, s = spark.createDataFrame(points, "k string, t long, i long"), spark.createDataFrame(made, "k string, a long, b long, j long")
    got = [(r.i, r.j) for r in spans.points_in_spans(p, s, ["k"], "t", "a", "b").collect()]
    assert sorted(got) == sorted((r.i, r.j) for r in spans.points_in_spans(p, s, ["k"], "t", "a", "b", fine=0).collect())
    want = {(i, j) for k, t, i in points for m, a, b, j in made if k == m and k is not None and t is not None and a <= t <= b}
    assert len(got) == len(set(got)) and set(got) == want
    assert spans.points_in_spans(p.where("false"), s, ["k"], "t", "a", "b").count() == spans.points_in_spans(p, s.where("false"), ["k"], "t", "a", "b").count() == 0


def test_span_joins_do_not_pair_all(spark):
    """Rows that meet by their blocks are in proportion to those of the result, however many spans a key has."""
    rng = random.Random(9)
    for n in (500, 2000):
        p = spark.createDataFrame([("a", rng.randint(0, 10**6)) for _ in range(n)], "k string, t long")
        s = spark.createDataFrame([("a", x, x + rng.randint(0, 4 * 10**6 // n)) for x in (rng.randint(0, 10**6) for _ in range(n))], "k string, a long, b long")
        bits = spans.widths(s, "a", "b")
        level = lambda c: F.struct(F.col(f"{c}.level"), F.col(f"{c}.block"))
        cover = s.select(F.explode(spans._cover(F.col("a"), F.col("b"), bits)).alias("x")).select(level("x").alias("x"))
        assert cover.count() <= n * 2 * (1 << spans.STEP) * len(bits)
        at = p.select(F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("t", b).alias("block")) for i, b in enumerate(bits)))).alias("x"))
        met, found = at.join(cover, "x").count(), spans.points_in_spans(p, s, ["k"], "t", "a", "b").count()
        assert found <= met <= 1.3 * found + n and met < n * n / 20


def test_as_of_and_integral(spark):
    rng = random.Random(5)
    points = {("a", t): rng.randint(0, 5) for t in rng.sample(range(5, 90), 20)} | {("b", 3): 2}
    probes = [(k, t, i) for i, (k, t) in enumerate((rng.choice("abc"), rng.randint(0, 100)) for _ in range(60))]
    p = spark.createDataFrame([(k, t, v) for (k, t), v in points.items()], "k string, t long, v long")
    q = spark.createDataFrame(probes, "k string, t long, i long")
    at = {r.i: r.x for r in stepfn.as_of(p, q, ["k"], "t", F.col("v"), "x").collect()}
    strict = {r.i: r.x for r in stepfn.as_of(p, q, ["k"], "t", F.col("v"), "x", strict=True).collect()}
    area = {r.i: r.x for r in stepfn.integral_at(p, q, ["k"], "t", "v", "x").collect()}
    for bits in (1, 4):
        assert {r.i: r.x for r in stepfn.as_of(p, q, ["k"], "t", F.col("v"), "x", bits=bits).collect()} == at
        assert {r.i: r.x for r in stepfn.integral_at(p, q, ["k"], "t", "v", "x", bits).collect()} == area
    value = lambda k, t: next((points[k, s] for s in range(t, -1, -1) if (k, s) in points), None)
    for k, t, i in probes:
        assert at[i] == value(k, t) and strict[i] == (value(k, t - 1) if t else None)
        assert area[i] == sum(value(k, s) or 0 for s in range(t))
    changes = stepfn.change_points(p.where("k = 'a'"), ["k"], ["t"], "v").orderBy("t").collect()
    assert all(x.v != y.v for x, y in zip(changes, changes[1:]))


def test_brackets(spark):
    rng = random.Random(6)
    data = [(f"k{n}", i, rng.random() < 0.5) for n in range(60) for i in range(rng.randint(0, 12))]
    want, stacks = {}, {}
    for k, i, opens in data:
        stack = stacks.setdefault(k, [])
        if opens:
            stack.append(i)
            want[k, i] = None
        elif stack:
            want[k, stack.pop()] = i
        else:
            want[k, i] = "stray"
    got = {}
    for r in match(spark.createDataFrame(data, "k string, i long, o boolean"), ["k"], ["i"], F.col("o")).collect():
        if r.stray:
            got[r.k, r.i] = "stray"
        elif r.o:
            got[r.k, r.i] = r.other.i if r.other else None
    assert got == want
