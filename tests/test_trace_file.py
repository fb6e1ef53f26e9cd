import io

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.functions.catalog import ID, TYPES, arity
from skein.sources import trace_file
from skein.sources.trace_file import InvalidTrace, _Bytes, header_version, records
from traces import header, record, string, text, varint


@pytest.mark.parametrize("data,value", [("00", 0), ("7F", 127), ("8001", 128), ("AC02", 300), ("8094EBDC03", 10**9), ("FF" * 9 + "01", -1)])
def test_varint(data, value):
    assert _Bytes(io.BytesIO(bytes.fromhex(data))).varint() == value


def test_varint_too_long():
    with pytest.raises(InvalidTrace, match="bad value"):
        _Bytes(io.BytesIO(b"\x80" * 10)).varint()


def test_header():
    assert header_version(header("1.11")) == 1011
    assert header_version(header("1.9")) == 1009
    assert header_version(header("1.5")) == 1005
    for bad in ("1.6", "1.12"):
        with pytest.raises(InvalidTrace, match="unsupported"):
            header_version(header(bad))
    for junk in (b"go 1.9 trAce\0\0\0\0", b"", b"go 1.9 trace"):
        with pytest.raises(InvalidTrace, match="bad trace header"):
            header_version(junk)


def parse(*parts, version="1.11"):
    return [r[1:] for r in records(io.BytesIO(header(version) + b"".join(parts)))]


def test_byte_vectors():
    hexes = {
        "02 80 94 EB DC 03": (ID["Frequency"], [10**9], None),
        "41 00 E8 07": (ID["Batch"], [0, 1000], None),
        "25 01 04 6D 61 69 6E": (ID["String"], [1], "main"),
        "C3 06 01 01 10 01 02 2A": (ID["Stack"], [1, 1, 16, 1, 2, 42], None),
        "CD 04 0A 01 01 00": (ID["GoCreate"], [10, 1, 1, 0], None),
        "8E 14 01 01": (ID["GoStart"], [20, 1, 1], None),
        "0F 05": (ID["GoEnd"], [5], None),
    }
    for h, want in hexes.items():
        assert parse(bytes.fromhex(h)) == [(16, *want)]


@pytest.mark.parametrize(
    "part,why",
    [
        (bytes.fromhex("CD030A01AC02"), "wrong length"),
        (bytes.fromhex("4E1401"), "wrong number"),
        (b"\0", "unknown type"),
        (bytes([50]), "unknown type"),
        (string(1, "a") + string(1, "b"), "repeated id"),
        (string(0, "a"), "invalid"),
        (string(1, ""), "empty"),
        (record("Frequency", 0), "out of order"),
        (record("GoStart", 1, 1, 1)[:-1], "end of file"),
        (record("Stack", 1, 2, 3, 4), "wrong number"),
        (record("Stack", 1, 1001), "too many frames"),
        (bytes([ID["UserLog"] | 0xC0]) + varint(4) + b"\1\1\1\0" + varint(2_000_000), "incorrect size"),
    ],
)
def test_broken_records(part, why):
    with pytest.raises(InvalidTrace, match=why):
        parse(part)


def test_newer_types_are_unknown_to_older_versions():
    with pytest.raises(InvalidTrace, match="unknown type"):
        parse(record("UserTaskEnd", 1, 1, 0), version="1.9")


def test_arity_by_version():
    assert arity(ID["GoStart"], 1011) == 3 and arity(ID["GoStart"], 1005) == 3
    assert arity(ID["GcSweepDone"], 1008) == 1 and arity(ID["GcSweepDone"], 1009) == 3
    assert arity(ID["GcStwStart"], 1009) == 1 and arity(ID["GcStwStart"], 1010) == 2
    assert arity(ID["Batch"], 1011) == 2 and arity(ID["Batch"], 1005) == 3
    assert arity(ID["Stack"], 1011) is None
    assert len(TYPES) == 49


def life():
    """One goroutine's life on two processors, with a task, a region and a log."""
    return b"".join([
        header("1.11"),
        record("Batch", 0, 1000),
        record("Gomaxprocs", 0, 2, 0),
        record("ProcStart", 0, 7),
        record("GoCreate", 10, 1, 1, 0),
        record("GoStart", 20, 1, 1),
        record("UserTaskCreate", 5, 9, 0, 3, 1),
        record("UserRegion", 5, 9, 0, 4, 1),
        record("UserLog", 1, 9, 3, 1, extra=text("hello")),
        record("GoBlockRecv", 29, 1),
        record("Batch", 1, 1060),
        record("ProcStart", 0, 8),
        record("GoCreate", 1, 2, 1, 0),
        record("GoStart", 1, 2, 1),
        record("GoUnblock", 38, 1, 3, 0),
        record("GoSched", 5, 1),
        record("Batch", 0, 1110),
        record("GoStart", 10, 1, 4),
        record("UserRegion", 10, 9, 1, 4, 1),
        record("GoEnd", 20),
        string(1, "main.work"), string(2, "main.go"), string(3, "job"), string(4, "part"),
        record("Stack", 1, 1, 16, 1, 2, 42),
        record("TimerGoroutine", 77),
        record("Frequency", 10**9),
    ])


def test_read_trace_end_to_end(spark, tmp_path):
    (tmp_path / "a.trace").write_bytes(life())
    t = api.read_trace(spark, str(tmp_path))
    ev = {r.rec_offset: r for r in t.events.collect()}
    rows = sorted(ev.values(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(len(rows)))
    assert [(r.type, r.ts, r.g) for r in rows if r.g == 1] == [("GoStart", 30, 1), ("UserTaskCreate", 35, 1), ("UserRegion", 40, 1), ("UserLog", 41, 1), ("GoBlockRecv", 70, 1), ("GoStart", 120, 1), ("UserRegion", 130, 1), ("GoEnd", 150, 1)]
    link = {r.type: (r.link_ts, r.link_g) for r in rows if r.link_offset is not None and 1 in (r.g, r.a0)}
    assert link["GoCreate"] == (30, 1) and link["GoBlockRecv"] == (100, 2) and link["GoUnblock"] == (120, 1)
    assert next(r for r in rows if r.type == "UserRegion").link_ts == 130
    assert next(r for r in rows if r.type == "UserLog").string_args == ["job", "hello"]
    assert [r.rule_id for r in t.violations.where("rule_id <> 'bracket'").collect()] == []
    g = {r.g: r for r in api.goroutines(t).collect()}
    assert (g[1].exec_time, g[1].sched_wait_time, g[1].block_time, g[1].total_time, g[1].end_ts, g[1].name, g[1].pc) == (70, 40, 30, 140, 150, "main.work", 16)
    region = [r for r in api.regions(t).collect()]
    assert [(r.name, r.task_id, r.exec_time, r.sched_wait_time, r.block_time, r.total_time) for r in region] == [("part", 9, 40, 20, 30, 90)]
    task = api.tasks(t).collect()
    assert [(x.task_id, x.name, x.completed, x.first_ts, x.last_ts, x.duration, x.goroutines) for x in task] == [(9, "job", False, 35, 41, 115, [1])]


def test_data_source_and_permissive_mode(spark, tmp_path):
    (tmp_path / "good.trace").write_bytes(life())
    (tmp_path / "bad.trace").write_bytes(life()[:60] + b"\0")
    (tmp_path / "none.trace").write_bytes(b"")
    trace_file.register(spark)
    a = spark.read.format("exectrace").option("mode", "PERMISSIVE").load(str(tmp_path))
    b = trace_file.read_raw(spark, str(tmp_path), "PERMISSIVE")
    assert a.columns == b.columns
    # files without bytes do not reach the reader of other file systems
    assert sorted(map(str, a.where("trace_id <> 'none'").collect())) == sorted(map(str, b.collect()))
    assert {r.trace_id for r in a.where("corrupt_reason is not null").collect()} == {"bad", "none"}
    with pytest.raises(Exception, match="unknown type|bad trace header|end of file"):
        trace_file.read_raw(spark, str(tmp_path)).count()


def test_old_format_orders_by_sequence(spark, tmp_path):
    old = lambda n, *a: record(n, *a, old=True)
    data = b"".join([
        header("1.5"),
        old("Batch", 0, 1, 100), old("ProcStart", 0, 0, 7), old("GoCreate", 2, 4, 1, 0, 0), old("GoWaiting", 2, 4, 1),
        old("Batch", 1, 2, 102), old("ProcStart", 0, 0, 8), old("GoCreate", 2, 4, 2, 0, 0), old("GoWaiting", 2, 4, 2),
        old("Frequency", 10**9, 0),
    ])
    (tmp_path / "o.trace").write_bytes(data)
    t = api.read_trace(spark, str(tmp_path))
    assert [(r.seq, r.p) for r in t.events.orderBy("ord").collect()] == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1)]


def test_strict_and_empty(spark, tmp_path):
    (tmp_path / "e.trace").write_bytes(header("1.11"))
    t = api.read_trace(spark, str(tmp_path))
    assert t.events.count() == 0
    (tmp_path / "e.trace").write_bytes(header("1.11") + record("Batch", 0, 1) + record("GoStart", 1, 5, 1))
    with pytest.raises(InvalidTrace):
        api.read_trace(spark, str(tmp_path), strict=True)
    assert {"frequency", "state"} <= {r.rule_id for r in api.read_trace(spark, str(tmp_path)).violations.select("rule_id").distinct().collect()}
    assert t.events.where(F.lit(True)).columns[:3] == ["trace_id", "rec_offset", "ord"]


def test_broken_sequence_numbers(spark, tmp_path):
    (tmp_path / "a.trace").write_bytes(life())  # its GoUnblock has number 3 where 2 is due, its last GoStart 4 where 3 is
    t = api.read_trace(spark, str(tmp_path), sequences=True)
    kinds = {r.rec_offset: r.type for r in t.events.collect()}
    assert sorted(kinds[r.rec_offset] for r in t.violations.where("rule_id = 'sequence'").collect()) == ["GoStart", "GoUnblock"]
    (tmp_path / "a.trace").write_bytes(life().replace(record("GoUnblock", 38, 1, 3, 0), record("GoUnblock", 38, 1, 2, 0)).replace(record("GoStart", 10, 1, 4), record("GoStart", 10, 1, 3)))
    assert api.read_trace(spark, str(tmp_path), sequences=True).violations.where("rule_id = 'sequence'").count() == 0
