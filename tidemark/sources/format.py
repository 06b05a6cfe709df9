"""Landed answers as a format of Spark: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

A folder holds files of lines, one answer each. Rows are (path, pos, body): the file, the byte at which the line begins, and the line;
``landed`` has the functions that make rows of the bodies. A file is read in ranges of bytes, small ones several to a
partition: a line belongs to the range in which it begins. Filters on ``path`` and ``pos`` decide which files and ranges are planned. As a stream, files are taken in the
order of their names, and the last may grow: an offset is a file and a byte at which a line ends, so that a restarted stream goes on where it was.
"""

from __future__ import annotations


import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, pos long, body string"
#: Bytes of one partition, and of one read.
RANGE, CHUNK = 32 << 20, 1 << 20
#: Partitions that small ranges are packed into at least: a range of a few KB costs less than a task.
PARTITIONS = 64
#: Lines of one Arrow batch.
LINES = 4096


class Range(InputPartition):
    """The lines of a file that begin from byte ``start`` to before byte ``end``."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class Dealt(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[Range]):
        super().__init__(tuple(r.value for r in ranges))
        self.ranges = ranges


def _dealt(ranges: list[Range]) -> list[Dealt]:
    """Ranges in partitions of up to RANGE bytes, or less where these would be fewer than PARTITIONS; a larger range stands alone."""
    target = min(RANGE, sum(r.end - r.start for r in ranges) / PARTITIONS)
    out: list[list[Range]] = []
    size = 0
    for r in ranges:
        if not out or size + r.end - r.start > target:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.end - r.start
    return [Dealt(own) for own in out] or [Dealt([])]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of one file, in the order of their names; hidden ones are left out."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    root = path.removesuffix(at) if path.endswith(at) else ""
    return sorted((root + f.path, f.size) for f in found if f.is_file and not any(p[0] in "._" for p in f.path.removeprefix(at).split("/") if p))


def lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in the range, without their ends; empty lines are left out. A line ends with its newline or the file."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        size = f.size()
        here, held = start, []
        if start:
            f.seek(start - 1)
            first = f.read(1)
            here = start if first == b"\n" else -1  # -1: in the middle of a line that begins earlier
        pos = start
        while pos < size and (here < end if here >= 0 else pos < end - 1):
            f.seek(pos)
            # as long as no line has begun, only the range is read: what begins behind its end belongs to another one
            chunk = f.read(CHUNK if here >= 0 else min(CHUNK, end - 1 - pos))
            pos += len(chunk)
            if here < 0:
                cut = chunk.find(b"\n")
                if cut < 0:
                    continue
                here, chunk = pos - len(chunk) + cut + 1, chunk[cut + 1 :]
            if b"\n" not in chunk:  # a line of many chunks is put together once
                held.append(chunk)
                continue
            parts = b"".join([*held, chunk]).split(b"\n")
            held = [parts.pop()]
            for p in parts:
                if here >= end:
                    return
                if p.strip():
                    yield here, p
                here += len(p) + 1
        last = b"".join(held)
        if last.strip() and 0 <= here < end:
            yield here, last


def _batches(part: Range, low: int = 0, high: int | None = None) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, str]] = []
    for pos, raw in lines(part.path, part.start, part.end):
        if pos >= low and (high is None or pos <= high):
            out.append((pos, raw.decode("utf-8", "replace")))
        if len(out) >= LINES:
            yield _batch(part.path, out)
            out = []
    if out:
        yield _batch(part.path, out)


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows])], ["path", "pos", "body"])


def _ranges(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, a, min(a + size, end)) for a in range(start, end, size)]


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.paths: list[Filter] = []
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else None
            if name == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.paths.append(f)
            elif name == ("pos",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("pos",) and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.paths)

    def partitions(self) -> list[Dealt]:
        # a line that begins at pos lies in one range only, so ranges outside of the wanted bytes hold none
        top = lambda n: n if self.high is None else min(n, self.high + 1)
        found = [r for path, n in files(self.path) if self._wanted(path) for r in _ranges(path, min(self.low, n), max(0, top(n)), self.size)]
        return _dealt(found)

    def read(self, part: Dealt) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from _batches(r, self.low, self.high)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line of the last file."""
        for path, n in reversed(files(self.path)):
            if end := _last_end(path, n):
                return {"file": path, "byte": end}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Dealt]:
        out = []
        for path, n in files(self.path):
            if start["file"] <= path <= end["file"]:
                a = start["byte"] if path == start["file"] else 0
                out += _ranges(path, a, end["byte"] if path == end["file"] else n, self.size)
        return _dealt(out)

    def read(self, part: Dealt) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from _batches(r)


def _last_end(path: str, size: int) -> int:
    """The byte behind the file's last newline; 0 without any."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        end = size
        while end > 0:
            begin = max(0, end - CHUNK)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


class Landed(DataSource):
    """Options: ``path`` (or load's argument), ``range`` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("the format landed needs a path")
        return self.options["path"], int(self.options.get("range", RANGE))

    def reader(self, schema) -> Reader:
        return Reader(*self._own())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._own())


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its code travels with the plan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
