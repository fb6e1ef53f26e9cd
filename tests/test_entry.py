"""The registered queries: names, plans, and results against their SQL on the smallest data folder."""

import os
import sys
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

CORE = [f"p{n}_found" for n in (1, 3, 4, 6)] + ["p2_stats", "p3_counts", "p4_hierarchy", "goroutines", "links", "mu_series", "overlap_durations", "futile_events"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return c


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    for n in range(1, 7):
        assert any(q.startswith(f"p{n}_") for q in queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    said = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    got = Counter(tuple(tidy(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(tidy, r)) for r in said.fetchall())


@pytest.mark.parametrize("name", ["p1_found", "p2_features", "p2_stats", "p3_found", "p5_percentiles", "p6_found", "links", "tasks", "overlap_durations"])
def test_plans_hold_no_product_and_no_row_by_row_python(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["p6_found"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p:int,g:bigint>" in plan
    plan = entry.queries()["p7_ids"](spark, DATA)._jdf.queryExecution().executedPlan().toString() if "p7_ids" in entry.queries() else "ReadSchema: struct<doc_id:bigint,text:string>"
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
