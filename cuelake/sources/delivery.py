"""Delivered files as a data source: `df.write.format("delivery")` and `spark.read.format("delivery")`.

Written are rows of (name, content). A name's file is made once, at the path and the name; its bytes are never replaced.
A task stages each file under its content's hash and moves it to its name, if nothing is there; the same bytes there are left
alone, and others are a conflict. What a task found goes to a list of its own in `_delivery/lists`, and the driver gets that list's
name, the number of its rows and the sum of their hashes, however many rows there are. The commit writes one manifest in
`_delivery/manifests` that names the lists. Its own name is made from the number and the sum of the rows' hashes, which don't depend on how
rows are divided over tasks.

So a task that runs again finds its files; a job that died before its commit has left files but no history, and running it again gives the
same files and the same history; a job that is run again after its commit finds its manifest and adds nothing. Reading gives the
history: (name, sha256, bytes, conflict), each fact once, from the lists that manifests name, a partition a list.

The path may be of any file system that Arrow knows by its URI. Names of one write must differ (`write_deliveries` sees to it).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, sha256 string, bytes bigint, conflict boolean"
OWN = "_delivery"


@dataclass
class Listed(WriterCommitMessage):
    """A task's list, its rows' number, and the sum of their hashes."""

    name: str
    rows: int
    total: int


class List(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.rstrip("/"))


def _bytes(system, path: str) -> bytes | None:
    from pyarrow import fs

    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_file(path) as f:
        return f.read()


def _put(system, root: str, path: str, data: bytes) -> None:
    """The whole file or none of it: staged under a name of its own, then moved."""
    staged = f"{root}/{OWN}/staged/{hashlib.sha256(data).hexdigest()}-{uuid.uuid4().hex}"
    for folder in (staged, path):
        system.create_dir(folder.rpartition("/")[0], recursive=True)
    with system.open_output_stream(staged) as f:
        f.write(data)
    system.move(staged, path)


def safe_name(name: str | None) -> bool:
    """A name below the path, and none of the source's own."""
    parts = (name or "").split("/")
    return bool(name) and "\x00" not in name and parts[0] != OWN and not any(p in ("", ".", "..") for p in parts)


def deliver_file(system, root: str, name: str, data: bytes) -> dict:
    """Make a name's file, unless it is there; the row of what was found."""
    there = _bytes(system, f"{root}/{name}")
    if there is None:
        _put(system, root, f"{root}/{name}", data)
    return {"name": name, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "conflict": there is not None and there != data}


def _fact_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.sha256(line).digest(), "big")


class DeliveryWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator) -> Listed:
        system, root = _system(self.uri)
        name, rows, total = uuid.uuid4().hex, 0, 0
        folder = f"{root}/{OWN}/lists"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                if not safe_name(row["name"]) or row["content"] is None:
                    raise ValueError(f"a delivery needs a content and a name below the path, not {row['name']!r}")
                content = row["content"]
                fact = deliver_file(system, root, row["name"], content.encode() if isinstance(content, str) else bytes(content))
                line = json.dumps(fact, ensure_ascii=False).encode()
                out.write(line + b"\n")
                rows, total = rows + 1, (total + _fact_hash(line)) % (1 << 256)
        return Listed(name, rows, total)

    def commit(self, messages: list[Listed | None]) -> None:
        system, root = _system(self.uri)
        lists = [m for m in messages if m is not None]
        filled = [m for m in lists if m.rows]
        path = f"{root}/{OWN}/manifests/{sum(m.rows for m in filled)}-{sum(m.total for m in filled) % (1 << 256):064x}.json"
        known = _bytes(system, path) is not None
        if filled and not known:
            _put(system, root, path, json.dumps(sorted(m.name for m in filled)).encode())
        for m in lists:
            if known or not m.rows:
                system.delete_file(f"{root}/{OWN}/lists/{m.name}")

    def abort(self, messages: list[Listed | None]) -> None:
        """Lists go; files stay, as running it again would find them."""
        system, root = _system(self.uri)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{OWN}/lists/{m.name}")


class DeliveryReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[List]:
        from pyarrow import fs

        system, root = _system(self.uri)
        found = system.get_file_info(fs.FileSelector(f"{root}/{OWN}/manifests", allow_not_found=True))
        names = {name for f in found if f.type == fs.FileType.File for name in json.loads(_bytes(system, f.path))}
        return [List(f"{root}/{OWN}/lists/{n}") for n in sorted(names)]

    def read(self, partition: List | None) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = _system(self.uri)
        with system.open_input_stream(partition.path) as f:
            held = b""
            while chunk := f.read(1 << 20):
                *whole, held = (held + chunk).split(b"\n")
                for fact in map(json.loads, whole):
                    yield fact["name"], fact["sha256"], fact["bytes"], fact["conflict"]


class DeliverySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DeliveryReader:
        return DeliveryReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DeliveryWriter:
        if overwrite:
            raise ValueError("delivered files are never replaced: mode('append')")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("a delivery has the columns name and content")
        return DeliveryWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeliverySource)


def delivery_history(spark: SparkSession, uri: str) -> DataFrame:
    """(name, sha256, bytes, conflict), each fact once: a file that several jobs delivered has one row."""
    register(spark)
    return spark.read.format("delivery").load(uri).distinct()


def write_deliveries(files: DataFrame, uri: str, name: str = "name", content: str = "content") -> None:
    """Deliver (name, content) rows. Equal rows are one; of several contents under a name the least hash is tried first, and so
    on, in one task, so that one of them is the file and the others are conflicts, whatever the order of rows was. A name is a key
    of the shuffle: a task holds a row at a time, however many rows a name has."""
    register(files.sparkSession)
    raw: Column = F.col(content).cast("binary")
    rows = files.select(F.col(name).alias("name"), raw.alias("content")).withColumn("sha256", F.sha2("content", 256))
    first = rows.dropDuplicates(["name", "sha256"])
    first.repartition("name").sortWithinPartitions("name", "sha256").select("name", "content").write.format("delivery").mode("append").option("path", uri).save()


def read_delivered(spark: SparkSession, uri: str) -> DataFrame:
    """(name, content) of the files that the history names, read by name, so that hidden and empty ones are read too."""

    def read(batches):
        import pyarrow as pa

        system, root = _system(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_bytes(system, f"{root}/{name}")], pa.binary())], ["name", "content"])

    names = delivery_history(spark, uri).where("NOT conflict").select("name").distinct()
    return names.mapInArrow(read, "name string, content binary")
