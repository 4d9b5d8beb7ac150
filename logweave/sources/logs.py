"""A data source for log files by positions: `spark.read.format("logs")` and `spark.readStream.format("logs")`.

Rows are (file, line_no, line); line_no is the byte at which the line begins, which orders the lines of a file and needs no count of the lines before. A file is cut into ranges of `rangeBytes`; a range reads the lines that
begin in it, to the end of the last one, so a huge file is many tasks. A stream takes what has been added to files since the last micro-batch, up to the last whole line: it follows growing files, which Spark's
own file source does not.

With `strata` (and `each`), only so many stretches are read, of `each` lines from equal distances in bytes on: what is read does not grow with the file.

Paths are what pyarrow's file systems reach (local and mounted folders, hdfs, s3, gs). Bytes that are no UTF-8 are dropped. An empty file has no lines; a last line without its end
is read by a batch, and waits in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
FIRST = 4096  # what a stretch reads at once

SCHEMA = "file string, line_no long, line string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the log files under a path, in order of name; hidden ones and markers do not count."""
    system, where = opened(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        return []
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    return sorted((head + f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def lines_between(handle, start: int, end: int, block: int = BLOCK, most: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines of an open file that begin at start or later and before end; at most `most`."""
    at = max(0, start - 1)
    handle.seek(at)
    held, skip, found = b"", start > 0, 0  # skip: the rest of the line before
    while True:
        more = handle.read(block)
        lines = (held + more).split(b"\n")
        held = lines.pop()
        if not more and held:
            lines.append(held)
        for line in lines:
            here, at = at, at + len(line) + 1
            if skip:
                skip = False
                continue
            if here >= end or found == most:
                return
            found += 1
            yield here, line
        if not more or (at >= end and not skip):
            return


def text_of(line: bytes) -> str:
    return line.decode("utf-8", "ignore").removesuffix("\r")


def stretch(handle, size: int, strata: int, nth: int, each: int) -> list[tuple[int, str]]:
    """The lines of one of `strata` stretches: `each` whole lines after its place."""
    at = min(nth * max(size // strata, 1), max(size - 1, 0))
    # A place inside a file is taken to be inside a line, even where one begins there: its rest is left out.
    return [(p, text_of(x)) for p, x in lines_between(handle, at + 1 if at else 0, size, FIRST, each)]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Stretch(InputPartition):
    def __init__(self, path: str, size: int, nth: int):
        self.path, self.size, self.nth = path, size, nth


def ranges(path: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(path, a, min(a + step, end)) for a in range(start, end, step)]


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    system, where = opened(part.path)
    places, lines, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "line_no", "line"])

    with system.open_input_file(where) as handle:
        for at, line in lines_between(handle, part.start, part.end):
            places.append(at)
            lines.append(text_of(line))
            size += len(line)
            if size > 4 << 20 or len(lines) >= 10_000:
                yield batch()
                places, lines, size = [], [], 0
    if lines:
        yield batch()


class LogReader(DataSourceReader):
    def __init__(self, path: str, step: int, strata: int, each: int):
        self.path, self.step, self.strata, self.each = path, step, strata, each

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path)
        if self.strata:
            return [Stretch(p, n, k) for p, n in files if n for k in range(self.strata)] or [Range("", 0, 0)]
        return [r for p, n in files for r in ranges(p, 0, n, self.step)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return iter(())
        if isinstance(partition, Range):
            return batches(partition)
        system, where = opened(partition.path)
        with system.open_input_file(where) as handle:
            found = stretch(handle, partition.size, self.strata, partition.nth, self.each)
        return iter([(partition.path, place, line) for place, line in found])


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the bytes of each file that have been taken: always whole lines."""

    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: self._whole(p, n) for p, n in listed(self.path) if n}

    def _whole(self, path: str, size: int) -> int:
        """Where the last whole line of a file ends."""
        system, where = opened(path)
        with system.open_input_file(where) as handle:
            end = size
            while end > 0:
                begin = max(0, end - BLOCK)
                handle.seek(begin)
                cut = handle.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for p, n in sorted(end.items()) for r in ranges(p, start.get(p, 0), n, self.step)] or [Range("", 0, 0)]

    def read(self, partition):
        return batches(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Options: path, rangeBytes, strata, each."""

    @classmethod
    def name(cls) -> str:
        return "logs"

    def schema(self) -> str:
        return SCHEMA

    def _step(self) -> int:
        return int(self.options.get("rangeBytes", 128 << 20))

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], self._step(), int(self.options.get("strata", 0)), int(self.options.get("each", 15)))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"], self._step())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def read_ranges(spark: SparkSession, path: str, step: int = 128 << 20) -> DataFrame:
    """(file, line_no, line) of log files, by ranges of bytes."""
    register(spark)
    return spark.read.format("logs").option("rangeBytes", step).load(path)


def read_growing(spark: SparkSession, path: str, step: int = 128 << 20) -> DataFrame:
    """The same as a stream that follows files as they grow."""
    register(spark)
    return spark.readStream.format("logs").option("rangeBytes", step).load(path)


def sample(spark: SparkSession, path: str, strata: int = 10, each: int = 15) -> DataFrame:
    """(file, line_no, line): `each` lines from each of `strata` places of every file; stretches of a short file overlap, and then share lines."""
    register(spark)
    return spark.read.format("logs").option("strata", strata).option("each", each).load(path)
