"""Reader of binary execution traces of the Go runtime, versions 1.5 and 1.7 to 1.11.

``read_raw`` decodes files of any Hadoop file system, each from one row; the data source ``exectrace`` streams files of any size that
Arrow's file systems can open from every executor, one partition per file. Both give one row per record::

    trace_id STRING, version INT, rec_offset BIGINT, type_id INT, args ARRAY<BIGINT>, str_arg STRING, corrupt_reason STRING

Unsigned 64-bit numbers keep their bit pattern. A record that breaks the format ends its file: with an error, or with
one row that says why where ``mode`` is ``PERMISSIVE``.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.functions.catalog import ID, TYPES, VERSIONS, arity
from skein.functions.ship import ship

SCHEMA = "trace_id string, version int, rec_offset bigint, type_id int, args array<bigint>, str_arg string, corrupt_reason string"
MOST_TEXT = 1_000_000  # bytes of a string
MOST_FRAMES = 1000
BATCH_ROWS = 8192


class InvalidTrace(ValueError):
    """A file that is not a trace, or a record that breaks the format."""


class EmptyTrace(InvalidTrace):
    """A trace without events."""


def header_version(head: bytes) -> int:
    """The version, 1000 * major + minor, from a file's first 16 bytes."""
    found = re.fullmatch(rb"go ([1-9])\.([1-9][0-9]{0,2}) trace\x00*", head)
    if len(head) != 16 or not found:
        raise InvalidTrace("bad trace header")
    version = int(found[1]) * 1000 + int(found[2])
    if version not in VERSIONS:
        raise InvalidTrace(f"unsupported trace file version {version // 1000}.{version % 1000}")
    return version


class _Bytes:
    """A buffered byte stream that knows its position."""

    def __init__(self, stream: BinaryIO, chunk: int = 1 << 20):
        self.stream, self.chunk, self.data, self.at, self.base = stream, chunk, b"", 0, 0

    @property
    def position(self) -> int:
        return self.base + self.at

    def need(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        if self.at + n <= len(self.data):
            return True
        self.base += self.at
        self.data = self.data[self.at :] + self.stream.read(max(self.chunk, n))
        self.at = 0
        return len(self.data) >= n

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise InvalidTrace("unexpected end of file")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        self.need(10)
        value, data, at = 0, self.data, self.at
        for i in range(10):
            if at + i >= len(data):
                raise InvalidTrace("unexpected end of file")
            byte = data[at + i]
            value |= (byte & 0x7F) << 7 * i
            if byte < 0x80:
                self.at = at + i + 1
                value &= 0xFFFFFFFFFFFFFFFF
                return value - (1 << 64) if value >> 63 else value
        raise InvalidTrace("bad value")

    def text(self) -> str:
        size = self.varint()
        if not 0 <= size <= MOST_TEXT:
            raise InvalidTrace("string has incorrect size")
        return self.take(size).decode("utf-8", "replace")


def records(stream: BinaryIO) -> Iterator[tuple[int, int, int, list[int], str | None]]:
    """``version, offset, type_id, args, text`` of each record of a trace."""
    data = _Bytes(stream)
    if not data.need(16):
        raise InvalidTrace("bad trace header")
    version = header_version(data.take(16))
    old = version < 1007
    strings: set[int] = set()
    while data.need(1):
        offset = data.position
        head = data.take(1)[0]
        kind, count, inline = head & 0x3F, (head >> 6) + 1 + old, 4 + old
        if kind == 0 or kind >= len(TYPES) or TYPES[kind][2] > version:
            raise InvalidTrace(f"unknown type {kind} at {offset}")
        if kind == ID["String"]:
            key = data.varint()
            if key == 0 or key in strings:
                raise InvalidTrace(f"string at {offset} has an invalid or repeated id {key}")
            value = data.text()
            if not value:
                raise InvalidTrace(f"string at {offset} is empty")
            strings.add(key)
            yield version, offset, kind, [key], value
            continue
        if count < inline:
            args = [data.varint() for _ in range(count)]
        else:
            length = data.varint()
            start, args = data.position, []
            while data.position - start < length:
                args.append(data.varint())
            if data.position - start != length:
                raise InvalidTrace(f"record at {offset} has wrong length, want {length}, got {data.position - start}")
        text = data.text() if kind == ID["UserLog"] else None
        if kind == ID["Stack"]:
            if len(args) < 2 or not 0 <= args[1] <= MOST_FRAMES:
                raise InvalidTrace(f"stack at {offset} has too few arguments or too many frames")
            want = (2 + args[1]) if old else 2 + 4 * args[1]
            if len(args) < want if old else len(args) != want:
                raise InvalidTrace(f"stack at {offset} has wrong number of arguments, want {want}, got {len(args)}")
        elif len(args) != arity(kind, version):
            raise InvalidTrace(f"{TYPES[kind][1]} at {offset} has wrong number of arguments, want {arity(kind, version)}, got {len(args)}")
        if kind == ID["Frequency"] and args[0] <= 0:
            raise InvalidTrace("time stamps out of order")
        yield version, offset, kind, args, text


def trace_name(path: str) -> str:
    """A trace's id: its file's name without the extension."""
    return os.path.splitext(os.path.basename(path))[0]


def batches(stream: BinaryIO, name: str, permissive: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a trace's records."""
    rows: list[tuple] = []
    try:
        for version, offset, kind, args, text in records(stream):
            rows.append((name, version, offset, kind, args, text, None))
            if len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows = []
    except InvalidTrace as e:
        if not permissive:
            raise
        rows.append((name, None, None, None, None, None, str(e)))
    yield _batch(rows)


_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def read_raw(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The records of all traces at ``path`` (files, folders or globs of any Hadoop file system).

    Files without a byte are skipped, as Spark skips them; ``exectrace`` says that their header is bad.
    """
    ship(spark)
    permissive = mode.upper() == "PERMISSIVE"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from batches(io.BytesIO(content), trace_name(name), permissive)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        if not self.path:
            raise ValueError("a path is needed")

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        kind = fs.get_file_info(path).type
        if kind == pa_fs.FileType.File:
            found = [path]
        else:
            folder, pattern = (path, "*") if kind == pa_fs.FileType.Directory else (os.path.dirname(path), os.path.basename(path))
            listed = fs.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True))
            found = sorted(f.path for f in listed if f.type == pa_fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with file_system(self.path)[0].open_input_stream(partition.path) as stream:
            yield from batches(stream, trace_name(partition.path), self.permissive)


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path there; paths without a scheme are local."""
    if "://" not in path:
        path = os.path.abspath(path.removeprefix("file:"))
        return pa_fs.LocalFileSystem(), path
    return pa_fs.FileSystem.from_uri(path)


class ExecTrace(DataSource):
    """``spark.read.format("exectrace").option("mode", ...).load(path)`` after :func:`register`; the sink of ``trace_sink``."""

    @classmethod
    def name(cls) -> str:
        return "exectrace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        from skein.sources.trace_sink import Files

        return Files(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format ``exectrace`` known to a session."""
    ship(spark)
    spark.dataSource.register(ExecTrace)
