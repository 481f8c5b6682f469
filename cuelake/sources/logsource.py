"""Event logs as a data source: `spark.read.format("event_log")` and `spark.readStream.format("event_log")`.

A log is a file of JSON lines, or a folder of them, that writers append to. The path may be of any file system that Arrow
knows by its URI (file, s3, gs, hdfs). Files are cut into ranges at multiples of `blockSize` bytes, planned from the files' sizes alone; a
line belongs to the range that it begins in, so no byte is parsed twice and no file is one task. Small blocks of a large log are one
range, and small files one partition, so that the number of tasks follows from the bytes and not from the block size. Conditions on the task and on
the sequence number are taken over from the query and applied before rows are made.

As a stream, the offset of a file is the end of its last whole line: a line whose end isn't written yet is held back and
appears, once, when it is whole. A batch, which no more will come to, also takes a last line without an end, if it reads. Lines that
don't read, or have no sequence number, are left out either way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

if TYPE_CHECKING:
    import pyarrow as pa

SCHEMA = "event_id string, task_id string, sequence bigint, occurred_at string, type string, data string"
CHUNK = 1 << 20
#: A log is about so many partitions, and more if they'd have more than so many bytes; rows of a batch.
PARTS, PART_BYTES, BATCH = 64, 16 << 20, 8192


class Range:
    """The lines of a file that begin in [start, end); `tail`: also a last one without its end."""

    def __init__(self, path: str, start: int, end: int, tail: bool):
        self.path, self.start, self.end, self.tail = path, start, end, tail


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def log_files(uri: str) -> dict[str, int]:
    """Path -> size of the logs at a path; none if it isn't there."""
    from pyarrow import fs

    system, path = _system(uri)
    at = system.get_file_info(path)
    if at.type == fs.FileType.NotFound:
        return {}
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.endswith((".json", ".jsonl")) and not f.base_name.startswith((".", "_"))}


def last_end(system, path: str, size: int, low: int) -> int:
    """The end of the last whole line of a file, `low` if there is none behind that."""
    with system.open_input_file(path) as f:
        high = size
        while high > low:
            start = max(low, high - CHUNK)
            f.seek(start)
            at = f.read(high - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


def lines(system, part: Range) -> Iterator[bytes]:
    """Lines that begin in a range. The byte before it tells whether one begins at its start."""
    with system.open_input_file(part.path) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        skip, held = part.start > 0, b""
        while True:
            chunk = f.read(CHUNK)
            if not chunk:
                break
            *whole, rest = (held + chunk).split(b"\n")
            for line in whole:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= part.end:
                    return
                yield line
            held = rest
            if at >= part.end and not skip:
                return
        if part.tail and held and not skip and at < part.end:
            yield held


_SPACE = re.compile(r"[ \t\r\n]*")


def members(text: str) -> dict[str, tuple[object, str]]:
    """Of a JSON object: name -> (value, its text as it stands). ValueError where it isn't one."""
    decoder, out, at = json.JSONDecoder(), {}, _SPACE.match(text).end()
    if text[at : at + 1] != "{":
        raise ValueError("no object")
    at, mark = _SPACE.match(text, at + 1).end(), ","
    if text[at : at + 1] == "}":
        mark, at = "}", at + 1
    while mark == ",":
        name, at = decoder.raw_decode(text, at)
        at = _SPACE.match(text, at).end()
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError("no member")
        at = _SPACE.match(text, at + 1).end()
        value, end = decoder.raw_decode(text, at)
        out[name] = (value, text[at:end])
        end = _SPACE.match(text, end).end()
        mark, at = text[end : end + 1], _SPACE.match(text, end + 1).end()
    if mark != "}" or at < len(text):
        raise ValueError("no end")
    return out


_TEXTS = ("event_id", "task_id", "occurred_at", "type", "data")


def event(line: bytes) -> tuple | None:
    """A row of an event's line; None if it doesn't read or has no number. Values that aren't texts are kept as they stand."""
    text = line.decode("utf-8", "replace")
    try:
        row = json.loads(text)
        if not isinstance(row, dict):
            return None
        if all(isinstance(row.get(c), str | None) for c in _TEXTS) and type(row.get("sequence")) is int:
            return row.get("event_id"), row.get("task_id"), row["sequence"], row.get("occurred_at"), row.get("type"), row.get("data")
        row = members(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(n := row.get("sequence", (None,))[0], int) or isinstance(n, bool):
        return None
    texts = {c: None if c not in row or row[c][0] is None else row[c][0] if isinstance(row[c][0], str) else row[c][1] for c in _TEXTS}
    return texts["event_id"], texts["task_id"], n, texts["occurred_at"], texts["type"], texts["data"]


def planned(spans: list[tuple[str, int, int]], block: int, tail: bool) -> list[Ranges]:
    """Partitions of the bytes (path, start, end): ranges of the least multiple of `block` that gives no more than about `PARTS`
    of them, or of `PART_BYTES`, and neighbours together up to that size."""
    size = block * max(1, -(-min(sum(end - start for _, start, end in spans) // PARTS, PART_BYTES) // block))
    out, held = [], size
    for path, start, end in spans:
        for a in range(start, end, size):
            r = Range(path, a, min(a + size, end), tail)
            if held + r.end - r.start > size:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(r)
            held += r.end - r.start
    return out


def _rows(uri: str, part: Ranges | None, tests: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    if part is None:  # a plan without partitions is read once, with none
        return
    system, _ = _system(uri)
    place = {"task_id": 1, "sequence": 2}
    schema = pa.schema([(c, pa.int64() if c == "sequence" else pa.string()) for c in ("event_id", "task_id", "sequence", "occurred_at", "type", "data")])
    tests, rows = [(place[c], op, v) for c, op, v in tests], []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for r in part.ranges:
        for line in lines(system, r):
            row = event(line)
            if row and all(row[k] is not None and (row[k] == v if op == "=" else row[k] > v if op == ">" else row[k] >= v) for k, op, v in tests):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


class LogReader(DataSourceReader):
    def __init__(self, uri: str, block: int):
        self.uri, self.block, self.tests = uri, block, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on the task and lower bounds of the sequence are applied here; the others are left to Spark."""
        for f in filters:
            op = "=" if isinstance(f, EqualTo) else ">" if isinstance(f, GreaterThan) else ">=" if isinstance(f, GreaterThanOrEqual) else None
            column = f.attribute[0] if op and len(f.attribute) == 1 else None
            if column == "sequence" or column == "task_id" and op == "=":
                self.tests.append((column, op, f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        return planned([(path, 0, size) for path, size in log_files(self.uri).items()], self.block, True)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _rows(self.uri, partition, self.tests)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, block: int):
        self.uri, self.block, self.known = uri, block, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Each log's end of its last whole line. A log that has grown is read from its end backwards, to where it was known before."""
        system, _ = _system(self.uri)
        for path, size in log_files(self.uri).items():
            before = self.known.get(path, 0)
            if size > before and (end := last_end(system, path, size, before)):
                self.known[path] = end
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return planned([(path, start.get(path, 0), to) for path, to in end.items()], self.block, False)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _rows(self.uri, partition, [])

    def commit(self, end: dict) -> None:
        """What was written stays; there's nothing to give back."""


class EventLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("blockSize", 16 << 20))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._options())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._options())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take over conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLogSource)
