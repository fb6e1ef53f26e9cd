"""Writer of binary execution traces: event tables and dictionaries back to the files that ``trace_file`` reads.

Records are encoded in blocks, each a batch of one processor with a bounded number of events, so a trace is never in one task's memory.
The data source ``exectrace`` then streams the blocks of a trace into its file, which takes its name only when it is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from skein.functions.catalog import ID, TYPES, VERSIONS, arity
from skein.functions.tables import durable
from skein.operators.events import latest
from skein.sources import trace_file

BLOCK_BITS = 14  # events of a batch, in bits of the trace's order; entries of a dictionary block, in bits of their ids
_META = ("None", "Batch", "Frequency", "Stack", "TimerGoroutine", "String")
_CHUNK = "trace_id string, part int, at bigint, p int, data binary"


def varint(n: int) -> bytes:
    """A 64-bit number, low bits first, seven to a byte."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def text(value: str) -> bytes:
    data = value.encode()
    return varint(len(data)) + data


def record(kind: int, args: list[int], old: bool, extra: bytes = b"") -> bytes:
    """One record: up to three arguments (four in old files) are counted in its first byte, more have their length before them."""
    body = b"".join(map(varint, args))
    few = len(args) - 1 - old
    return bytes([kind | few << 6]) + body + extra if few < 3 else bytes([kind | 0xC0]) + varint(len(body)) + body + extra


def header(version: int) -> bytes:
    return f"go {version // 1000}.{version % 1000} trace".encode().ljust(16, b"\0")


def _chunk(t: pa.Table, part: int, at: int, p: int, data: bytes) -> pa.Table:
    columns = [pa.array([x], k) for x, k in ((t.column("trace_id")[0].as_py(), pa.string()), (part, pa.int32()), (at, pa.int64()), (p, pa.int32()), (data, pa.binary()))]
    return pa.Table.from_arrays(columns, ["trace_id", "part", "at", "p", "data"])


def _batch(version: int):
    """Encodes one block of events of a processor: a batch record with the base time, then differences."""
    old = version < 1007

    def encode(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["ord"], r["rec_offset"]))
        ts, seq, p = rows[0]["ts"], rows[0]["seq"] or 0, rows[0]["p"]
        out = [record(ID["Batch"], [p, seq, ts] if old else [p, ts], old)]
        for r in rows:
            kind = r["raw_type_id"]
            stack = TYPES[kind][3]
            own = [r["a0"] or 0, r["a1"] or 0, r["a2"] or 0][: arity(kind, version) - 1 - old - stack]
            lead = [(r["seq"] or 0) - seq, r["ts"] - ts] if old else [r["ts"] - ts]
            ts, seq = r["ts"], r["seq"] or 0
            words = r["string_args"] or []
            extra = text(words[1] if len(words) > 1 and words[1] is not None else "") if kind == ID["UserLog"] else b""
            out.append(record(kind, [*lead, *own, *([r["stack_id"] or 0] if stack else [])], old, extra))
        return _chunk(t, 2, rows[0]["_block"], p, b"".join(out))

    return encode


def _words(t: pa.Table) -> pa.Table:
    rows = sorted(t.select(["string_id", "val"]).to_pylist(), key=lambda r: r["string_id"])
    return _chunk(t, 3, rows[0]["string_id"], 0, b"".join(bytes([ID["String"]]) + varint(r["string_id"]) + text(r["val"]) for r in rows))


def _frames(version: int):
    old = version < 1007

    def encode(t: pa.Table) -> pa.Table:
        rows, out = sorted(t.select(["stack_id", "ids"]).to_pylist(), key=lambda r: r["stack_id"]), []
        for r in rows:
            flat = [x or 0 for f in r["ids"] for x in ((f["pc"],) if old else (f["pc"], f["fn"], f["file"], f["line"]))]
            out.append(record(ID["Stack"], [r["stack_id"], len(r["ids"]), *flat], old))
        return _chunk(t, 4, rows[0]["stack_id"], 0, b"".join(out))

    return encode


def _ends(version: int):
    old = version < 1007

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows.append((r["trace_id"], 1, 0, 0, header(version)))
                last = [record(ID["TimerGoroutine"], [g, *([0] * old)], old) for g in sorted({g for g in r["timers"] or [] if g is not None})]
                if (r["frequency"] or 0) > 0:
                    last.append(record(ID["Frequency"], [r["frequency"], *([0] * old)], old))
                rows.append((r["trace_id"], 5, 0, 0, b"".join(last)))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["trace_id", "part", "at", "p", "data"])

    return encode


def chunks(events: DataFrame, strings: DataFrame, stacks: DataFrame, meta: DataFrame, version: int = 1011) -> DataFrame:
    """``trace_id, part, at, p, data``: the pieces of each trace's file, in order of ``part``, ``at`` and ``p``.

    ``events`` needs ``trace_id, rec_offset, ord, raw_type_id, ts, p, a0, a1, a2, string_args, stack_id``, and ``seq`` for versions before
    1007. Rows without a trace, type, time or processor, and types the version does not know, are left out, as are strings that
    are empty or have id 0 and stacks without frames. Null arguments are 0. Of several rows of a dictionary entry the newest that is
    not deleted counts. Names in frames get string ids above all that the trace has or names. Traces without a row in ``meta`` have no file.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version}")
    kinds = [i for i, name, first, *_ in TYPES if name not in _META and first <= version]
    known = events.where(F.col("raw_type_id").isin(*kinds) & F.col("trace_id").isNotNull() & F.col("ts").isNotNull() & F.col("p").isNotNull() & F.col("ord").isNotNull())
    seq = F.col("seq") if "seq" in events.columns else F.lit(None).cast("bigint")
    rows = known.select("trace_id", "rec_offset", "ord", "raw_type_id", "ts", seq.alias("seq"), "p", "a0", "a1", "a2", "string_args", "stack_id", F.shiftright("ord", BLOCK_BITS).alias("_block"))
    parts = [rows.groupBy("trace_id", "p", "_block").applyInArrow(_batch(version), _CHUNK)]
    facts = meta.where("trace_id is not null").groupBy("trace_id").agg(F.max("frequency").alias("frequency"), F.first("timers", ignorenulls=True).alias("timers"))
    parts.append(facts.mapInArrow(_ends(version), _CHUNK))
    frames = latest(stacks, "stack_id", "frames").where("trace_id is not null and stack_id <> 0 and size(frames) > 0")
    frames = frames.select("trace_id", "stack_id", F.posexplode("frames").alias("_i", "_f")).select("trace_id", "stack_id", "_i", "_f.pc", "_f.fn", "_f.file", "_f.line")
    words = latest(strings, "string_id", "val").where("trace_id is not null and string_id <> 0 and val <> ''")
    if version >= 1007:
        names = durable(frames.select("trace_id", F.explode(F.array("fn", "file")).alias("val")).where("val <> ''").distinct())
        kind = F.col("raw_type_id")
        named = F.when(kind == ID["UserLog"], F.col("a1")).when(kind.isin(ID["GoStartLabel"], ID["UserTaskCreate"], ID["UserRegion"]), F.col("a2"))
        used = strings.select("trace_id", "string_id").unionByName(known.select("trace_id", named.alias("string_id")))
        top = used.groupBy("trace_id").agg(F.max("string_id").alias("_top"))
        number = F.row_number().over(Window.partitionBy("trace_id").orderBy("val"))
        named = durable(names.join(top, "trace_id", "left").select("trace_id", (F.coalesce("_top", F.lit(0)) + number).alias("string_id"), "val"))
        words = words.select("trace_id", "string_id", "val").unionByName(named)
        parts.append(words.groupBy("trace_id", F.shiftright("string_id", BLOCK_BITS).alias("_block")).applyInArrow(_words, _CHUNK))
        for c in ("fn", "file"):
            ids = named.select("trace_id", F.col("string_id").alias(f"_{c}"), F.col("val").alias(c))
            frames = frames.join(ids, ["trace_id", c], "left")
    else:
        frames = frames.withColumn("_fn", F.lit(0)).withColumn("_file", F.lit(0))
    frame = F.struct("_i", "pc", F.col("_fn").alias("fn"), F.col("_file").alias("file"), "line")
    listed = frames.groupBy("trace_id", "stack_id").agg(F.array_sort(F.collect_list(frame)).alias("ids"))
    parts.append(listed.groupBy("trace_id", F.shiftright("stack_id", BLOCK_BITS).alias("_block")).applyInArrow(_frames(version), _CHUNK))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made.join(facts.select("trace_id"), "trace_id", "left_semi").select(*(c.split()[0] for c in _CHUNK.split(", ")))


def write_traces(events: DataFrame, strings: DataFrame, stacks: DataFrame, meta: DataFrame, path: str, version: int = 1011) -> None:
    """Writes one file ``<path>/<trace_id>.trace`` per row of ``meta``; see :func:`chunks`."""
    trace_file.register(events.sparkSession)
    order = ("trace_id", "part", "at", "p")
    chunks(events, strings, stacks, meta, version).repartition("trace_id").sortWithinPartitions(*order).write.format("exectrace").mode("append").save(path)


class Files(DataSourceWriter):
    """Streams sorted pieces into one file per trace."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        fs, root = trace_file.file_system(self.path)
        fs.create_dir(root, recursive=True)
        trace, out, unnamed = None, None, f"{root}/_{uuid.uuid4().hex}"

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(unnamed, f"{root}/{trace}.trace")

        for row in iterator:
            if row.trace_id != trace:
                close()
                if "/" in row.trace_id:
                    raise ValueError(f"no file can have the name {row.trace_id}")
                trace, out = row.trace_id, fs.open_output_stream(unnamed)
            out.write(bytes(row.data))
        close()
        return WriterCommitMessage()
