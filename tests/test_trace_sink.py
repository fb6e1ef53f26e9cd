"""Traces written and read back."""

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.functions.catalog import ID
from skein.operators import events as E, projection
from skein.sources import trace_file, trace_sink
from traces import event as e, table

LIFE = [
    e(100, "Gomaxprocs", a=(2,), stack=0), e(110, "GoCreate", a=(1, 1), stack=0), e(130, "GoStart", g=1, a=(1, 1)), e(131, "UserTaskCreate", g=1, a=(9, 0, 3), s=["job"], stack=1),
    e(132, "UserLog", g=1, a=(9, 3), s=["job", "héllo"], stack=1), e(135, "UserRegion", g=1, a=(9, 0, 4), s=["part"], stack=1), e(90, "GoBlockRecv", g=1, stack=1), e(120, "GoUnblock", p=1, a=(1, 2), stack=0),
    e(150, "GoStart", p=1, g=1, a=(1, 3)), e(160, "GoEnd", p=1, g=1), e(161, "GcStwStart", p=1, a=(1,), s=["sweep termination"]), e(2**40, "GoSysExit", p=1, a=(5, 1, 2**39)),
]


def parts(spark, n=2):
    ev = table(spark, *[LIFE] * n)
    strings = spark.createDataFrame([(f"t{i}", k, v) for i in range(n) for k, v in ((3, "job"), (4, "part"), (0, "no"), (7, ""))], "trace_id string, string_id long, val string")
    frames = [(16, "main.work", "main.go", 42), (17, None, "main.go", None)]
    stacks = spark.createDataFrame([(f"t{i}", 1, frames) for i in range(n)] + [("t0", 2, []), ("t0", 3, None)], "trace_id string, stack_id long, frames array<struct<pc:long,fn:string,file:string,line:int>>")
    meta = spark.createDataFrame([(f"t{i}", 10**9, [77, None, 77]) for i in range(n)] + [("none", None, None)], "trace_id string, frequency long, timers array<long>")
    return ev.withColumn("part", F.lit("clash")).withColumn("data", F.lit(1)), strings, stacks, meta


@pytest.mark.parametrize("version,kept", [(1011, 12), (1009, 9), (1007, 9)])
def test_events_come_back(spark, tmp_path, version, kept):
    path = f"file://{tmp_path}/out"
    trace_sink.write_traces(*parts(spark), path, version)
    raw = trace_file.read_raw(spark, path)
    ev = projection.project(raw).where("trace_id = 't1'").orderBy("rec_offset").collect()
    want = [(x["p"], ID[x["name"]], x["ts"]) for x in LIFE if version == 1011 or not x["name"].startswith("User")]
    assert len(ev) == kept and sorted((r.p, r.type_id, r.ts) for r in ev) == sorted(want)
    assert next(r for r in ev if r.type_id == ID["GoSysExit"]).a2 == 2**39
    assert [r.g for r in ev if r.type_id == ID["GoBlockRecv"]] == [1]
    if version == 1011:
        texts = {r.type_id: r.string_args for r in ev}
        assert texts[ID["UserLog"]] == ["job", "héllo"] and texts[ID["UserRegion"]] == ["part"] and texts[ID["GcStwStart"]] == ["sweep termination"]
    stack = E.resolved_frames(projection.stacks(raw), projection.strings(raw)).where("trace_id = 't1'").collect()
    assert [[tuple(f) for f in r.frames] for r in stack] == [[(16, "main.work", "main.go", 42), (17, None, "main.go", 0)]]
    meta = {r.trace_id: (r.version, r.frequency, r.timers) for r in projection.meta(raw).collect()}
    assert meta["t0"] == (version, 10**9, [77])


def test_first_version_carries_sequence_numbers(spark, tmp_path):
    ev, *rest = parts(spark, 1)
    trace_sink.write_traces(ev.withColumn("seq", F.col("ord") * 2), *rest, str(tmp_path), 1005)
    got = projection.project(trace_file.read_raw(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.seq, r.ts) for r in got] == [(2 * i, x["ts"]) for i, x in enumerate(LIFE) if not x["name"].startswith("User")]
    with pytest.raises(ValueError):
        trace_sink.chunks(ev, *rest, version=1006)


def test_source_and_sink_of_one_format(spark, tmp_path):
    trace_sink.write_traces(*parts(spark), str(tmp_path / "a" / "b"))
    trace_file.register(spark)
    whole = spark.read.format("exectrace").load(f"file://{tmp_path}/a/b")
    assert sorted(map(str, whole.collect())) == sorted(map(str, trace_file.read_raw(spark, str(tmp_path / "a" / "b")).collect()))
    assert {r.trace_id for r in spark.read.format("exectrace").load(f"{tmp_path}/a/b/t*.trace").collect()} == {"t0", "t1"}
    assert spark.read.format("exectrace").load(f"{tmp_path}/a/b/t0.trace").where("trace_id <> 't0'").count() == 0
    assert sorted(f.name for f in (tmp_path / "a" / "b").iterdir() if f.name[0] not in "._") == ["none.trace", "t0.trace", "t1.trace"]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("exectrace").load(f"{tmp_path}/nowhere").collect()


def test_names_that_are_no_files(spark, tmp_path):
    ev, strings, stacks, meta = parts(spark)
    odd = meta.withColumn("trace_id", F.lit("../x"))
    with pytest.raises(Exception, match="no file can have the name"):
        trace_sink.write_traces(ev, strings, stacks, odd, str(tmp_path))


def test_empty_tables_and_traces(spark, tmp_path):
    trace_sink.write_traces(*(df.where("false") for df in parts(spark)), str(tmp_path / "x"))
    ev, strings, stacks, meta = parts(spark)
    trace_sink.write_traces(ev.where("false"), strings, stacks, meta.where("trace_id = 't0'"), str(tmp_path / "y"))
    with pytest.raises(trace_file.EmptyTrace, match="empty"):
        api.read_trace(spark, str(tmp_path / "y"), strict=True)
