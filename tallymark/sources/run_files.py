"""Import of compressed run files.

A file starts with a 44-byte header (magic, version, n, d, p, seed), followed by one 60-byte
table entry per run: offset and size of its zlib-compressed values (32-bit little endian),
offset and size of its zlib-compressed truth bits (lowest bit first), n, d and two encoding
numbers.  A task seeks to its blocks and inflates them in bounded pieces, so its memory does
not depend on the length of a run.

    runs = read_run_files(spark, "/shared/folder/*.bin")

Spark lists the files, tasks read their tables, and runs are dealt out to as many
tasks; the driver learns the number of runs only.  The same files can be read as a data source, then
with one partition per file:

    spark.dataSource.register(RunFileSource)
    runs = spark.read.format("run_files").load("/shared/folder/*.bin")

Files are opened through ``pyarrow.fs``, so a path may carry the scheme of any file system that
it knows; a path without scheme is a folder that driver and executors share.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format.
MAGIC = b"SATPDBN2"
VERSION = 2
VALUES_U32_LE = 1
BITS_LE = 2
HEADER = struct.Struct("<8sIQQQQ")
ENTRY = struct.Struct("<QQQQQQIII")

BATCH_ELEMENTS = 1 << 16
READ_BYTES = 1 << 18
TABLE_ENTRIES = 1 << 12
MAX_PARTITIONS = 50_000
SCHEMA = "run_id int, pos bigint, value bigint, is_new boolean, seed bigint, file string"


class RunFileError(RuntimeError):
    """A run file that breaks its own format."""


@dataclass
class RunEntry:
    """One run of one file."""

    path: str
    run_id: int
    seed: int
    values_at: int
    values_size: int
    bits_at: int
    bits_size: int
    elements: int


def _check(condition: bool, path: str, message: str) -> None:
    if not condition:
        raise RunFileError(f"{path}: {message}")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path inside it."""
    scheme, separator, rest = path.partition(":")
    if not separator or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/")
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}")
    return system, f"{base.rstrip('/')}/{inner}" if base.strip("/") else f"/{inner}"


def run_entries(path: str) -> Iterator[RunEntry]:
    """Table entries of one file, checked against the header and the file size."""
    system, inner = located(path)
    with system.open_input_file(inner) as stream:
        size = stream.size()
        header = _header(stream, path, size)
        n, d = header["n"], header["d"]
        for first in range(0, header["p"], TABLE_ENTRIES):
            count = min(TABLE_ENTRIES, header["p"] - first)
            table = ENTRY.iter_unpack(stream.read(count * ENTRY.size))
            for run_id, entry in enumerate(table, first):
                v_at, v_size, b_at, b_size, run_n, run_d, v_kind, b_kind, _ = entry
                _check((run_n, run_d) == (n, d), path, f"run {run_id} disagrees with the header")
                _check(v_kind == VALUES_U32_LE, path, f"unknown value encoding {v_kind}")
                _check(b_kind == BITS_LE, path, f"unknown bit encoding {b_kind}")
                _check(v_at + v_size <= size, path, f"values of run {run_id} lie outside the file")
                _check(b_at + b_size <= size, path, f"bits of run {run_id} lie outside the file")
                yield RunEntry(path, run_id, header["seed"], v_at, v_size, b_at, b_size, n)


def _header(stream, path: str, size: int) -> dict:
    _check(size >= HEADER.size, path, "too small for a header")
    magic, version, n, d, p, seed = HEADER.unpack(stream.read(HEADER.size))
    _check(magic == MAGIC, path, "bad magic")
    _check(version == VERSION, path, f"unsupported version {version}")
    _check(seed < 1 << 32, path, "the seed does not fit 32 bits")
    _check(d <= n, path, "more distinct values than elements")
    _check(size >= HEADER.size + p * ENTRY.size, path, "too small for its table")
    return {"n": n, "d": d, "p": p, "seed": seed}


def read_index(path: str) -> tuple[dict, list[RunEntry]]:
    """Header fields and the whole table of one file."""
    system, inner = located(path)
    with system.open_input_file(inner) as stream:
        header = _header(stream, path, stream.size())
    return header, list(run_entries(path))


class _Inflater:
    """Reads exact numbers of bytes from a zlib block inside a file."""

    def __init__(self, path: str, offset: int, size: int):
        self._path = path
        system, inner = located(path)
        self._stream = system.open_input_file(inner)
        self._stream.seek(offset)
        self._left = size
        self._zlib = zlib.decompressobj()
        self._input = b""

    def take(self, count: int) -> bytes:
        pieces, missing = [], count
        while missing > 0:
            if not self._input and not self._zlib.eof:
                self._input = self._stream.read(min(READ_BYTES, self._left))
                self._left -= len(self._input)
                _check(bool(self._input), self._path, "a compressed block ends early")
            _check(not self._zlib.eof, self._path, "a block holds too little data")
            try:
                piece = self._zlib.decompress(self._input, missing)
            except zlib.error as problem:
                raise RunFileError(f"{self._path}: {problem}") from problem
            self._input = self._zlib.unconsumed_tail
            pieces.append(piece)
            missing -= len(piece)
        return b"".join(pieces)

    def finish(self) -> None:
        """Fail if the block holds more than was asked for."""
        while not self._zlib.eof:
            if not self._input:
                self._input = self._stream.read(min(READ_BYTES, self._left))
                self._left -= len(self._input)
                _check(bool(self._input), self._path, "a compressed block ends early")
            extra = self._zlib.decompress(self._input, 1)
            _check(not extra, self._path, "a block holds too much data")
            self._input = self._zlib.unconsumed_tail
        self._stream.close()


def read_run(entry: RunEntry, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of one run."""
    if entry.elements == 0:
        return
    values = _Inflater(entry.path, entry.values_at, entry.values_size)
    bits = _Inflater(entry.path, entry.bits_at, entry.bits_size)
    for start in range(0, entry.elements, BATCH_ELEMENTS):
        count = min(BATCH_ELEMENTS, entry.elements - start)
        ids = np.frombuffer(values.take(4 * count), dtype="<u4").astype(np.int64)
        packed = np.frombuffer(bits.take((count + 7) // 8), dtype=np.uint8)
        flags = np.unpackbits(packed, count=count, bitorder="little").astype(bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(count, entry.run_id, dtype=np.int32)),
                pa.array(np.arange(start + 1, start + count + 1, dtype=np.int64)),
                pa.array(ids),
                pa.array(flags),
                pa.array(np.full(count, entry.seed, dtype=np.int64)),
                pa.array([entry.path] * count),
            ],
            schema=schema,
        )
    values.finish()
    bits.finish()


_ARROW = pa.schema(
    [
        ("run_id", pa.int32()),
        ("pos", pa.int64()),
        ("value", pa.int64()),
        ("is_new", pa.bool_()),
        ("seed", pa.int64()),
        ("file", pa.string()),
    ]
)


_ENTRY_SCHEMA = (
    "path string, run_id int, seed bigint, values_at bigint, values_size bigint, "
    "bits_at bigint, bits_size bigint, elements bigint"
)
_ENTRY_ARROW = pa.schema(
    [("path", pa.string()), ("run_id", pa.int32())]
    + [(f.name, pa.int64()) for f in fields(RunEntry)[2:]]
)


def _entry_batches(entries: Iterator[RunEntry]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for entry in entries:
        pending.append(astuple(entry))
        if len(pending) == TABLE_ENTRIES:
            yield _entry_batch(pending)
            pending = []
    if pending:
        yield _entry_batch(pending)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, kind.type) for column, kind in zip(zip(*rows), _ENTRY_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ENTRY_ARROW)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield from _entry_batches(run_entries(path))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from read_run(RunEntry(**row), _ARROW)


def _file_names(spark: SparkSession, path: str) -> DataFrame:
    system, inner = located(path)
    reader = spark.read.format("binaryFile")
    if not any(sign in inner for sign in "*?[{") and not inner.endswith(".bin"):
        reader = reader.option("pathGlobFilter", "*.bin")
    # Only the names are read: Spark leaves the contents out where they are not selected.
    return reader.load(path).select("path")


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """The table of every file at ``path``, one row per run, read by tasks."""
    return _file_names(spark, path).mapInArrow(_tables, _ENTRY_SCHEMA)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, pos, value, is_new, seed, file`` of all runs at a file, folder or pattern.

    A folder is searched for ``*.bin``.  No file at all raises :class:`RunFileError`; a file that
    breaks the format makes the query fail.  Runs are dealt out to as many tasks, up to 50,000.
    """
    try:
        index = run_index(spark, path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        raise RunFileError(f"no run files at {path}") from problem
    runs = index.count()
    if not runs and _file_names(spark, path).isEmpty():
        raise RunFileError(f"no run files at {path}")
    # An explicit number is kept by adaptive execution, which knows the index's size only.
    dealt = index.repartition(min(max(runs, 1), MAX_PARTITIONS))
    return dealt.mapInArrow(_runs, SCHEMA)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, pattern: str):
        self._pattern = pattern

    def partitions(self) -> list[_File]:
        system, inner = located(self._pattern)
        prefix = self._pattern[: len(self._pattern) - len(inner.lstrip("/"))].rstrip("/")
        folder, names = inner, "*.bin"
        if system.get_file_info(inner).type != fs.FileType.Directory:
            folder, names = posixpath.split(inner)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        paths = sorted(
            f"{prefix}/{file.path.lstrip('/')}"
            for file in found
            if file.is_file and fnmatch.fnmatch(file.base_name, names)
        )
        if not paths:
            raise RunFileError(f"no run files at {self._pattern}")
        return [_File(path) for path in paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        for entry in run_entries(partition.path):
            yield from read_run(entry, _ARROW)


class RunFileSource(DataSource):
    """Batch source ``run_files``; the path is a file, a folder or a pattern of file names."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
