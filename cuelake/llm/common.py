"""What the operators of this subpackage share: table access, the shared work folder, clean-up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}
_passing: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; an own one only where it is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="cuelake-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage ends here, so a lost
    executor costs a re-read and not the work before it, and several readers do that work once."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, keep))


def write_table(df: DataFrame, name: str, keep: bool = False) -> str:
    path = new_path(df.sparkSession, name)
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.parquet(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in this context, but for those to `keep`, are deleted at its end. What leaves it is values or kept tables."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        own = f"__{name}"
        while own in taken:
            own = f"_{own}"
        taken.add(own)
        out.append(own)
    return out


def once_a_process(name: str, build):
    """What `build` makes, made once in each Python worker process: tasks that follow reuse it."""
    import sys
    import types

    kept = sys.modules.setdefault("_cuelake_once", types.ModuleType("_cuelake_once")).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


class Memo(dict):
    """A dictionary that makes what it lacks, and starts anew at `limit` entries. Keys longer than `LONGEST` aren't
    kept, so it stays bounded in bytes too."""

    LONGEST = 200

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if isinstance(key, str | bytes) and len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
