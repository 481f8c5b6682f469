"""Joins, windows and aggregates over timed records. All keep the task as a join or window key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Time buckets of joins of short intervals: an interval meets only those that share a bucket with it.
BUCKET_MS = 10_000
#: Joins of intervals of any length: the finest block of time, how many blocks make one of the next level, and the number of levels above.
BLOCK_MS, RADIX, LEVELS = 8_192, 16, 4


def in_order(task: str = "task_id", by: str = "idx"):
    return W.partitionBy(task).orderBy(by)


def overlapping(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of a task whose times overlap (each with `task_id`, `start_ms`, `end_ms`; right's columns must else differ).

    For short intervals: each is cut into all its buckets. The equi-key is task and time bucket, so a long recording is not one nested loop. A pair that shares several
    buckets is taken in the one where its overlap starts.
    """

    def bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / bucket_ms), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bucket_ms)
        return df.withColumn("__bucket", F.explode(F.sequence(first, last)))

    r = right.withColumnsRenamed({"start_ms": "r_start_ms", "end_ms": "r_end_ms"})
    joined = bucketed(left, "start_ms", "end_ms").join(bucketed(r, "r_start_ms", "r_end_ms"), ["task_id", "__bucket"])
    overlaps = (F.col("r_end_ms") > F.col("start_ms")) & (F.col("r_start_ms") < F.col("end_ms"))
    own = F.floor(F.greatest("start_ms", "r_start_ms") / bucket_ms) == F.col("__bucket")
    return joined.where(overlaps & own).drop("__bucket")


def _blocks(lo: Column, hi: Column, radix: int, levels: int) -> tuple[Column, Column]:
    """Of the finest blocks lo to hi - 1: the fewest blocks of all levels that cover them, and the blocks that they cover in part, as (level, node)."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def row(level: int, a: Column, b: Column) -> Column:
        at = F.transform(F.sequence(a, b - 1), lambda n: F.struct(F.lit(level).alias("level"), n.cast("bigint").alias("node")))
        return F.when(a < b, at).otherwise(none)

    cover, part = [], []
    for level in range(levels + 1):
        # the blocks of this level that are full, less those of which the whole next block is
        size = radix**level
        a, b = F.ceil(lo / size), F.floor(hi / size)
        up, down = F.ceil(lo / (size * radix)), F.floor(hi / (size * radix))
        whole = up < down
        if level == levels:
            cover.append(row(level, a, b))
        else:
            cover += [row(level, a, F.when(whole, up * radix).otherwise(b)), F.when(whole, row(level, down * radix, b)).otherwise(none)]
        if level:
            torn = lambda n: F.when((n * size < lo) | ((n + 1) * size > hi), F.struct(F.lit(level).alias("level"), n.cast("bigint").alias("node")))  # noqa: E731, B023
            part.append(F.array_compact(F.array_distinct(F.array(torn(F.floor(lo / size)), torn(F.floor((hi - 1) / size))))))
    return F.concat(*cover), F.concat(*part) if part else none


def overlapping_any_length(left: DataFrame, right: DataFrame, block_ms: int = BLOCK_MS, radix: int = RADIX, levels: int = LEVELS) -> DataFrame:
    """Pairs of a task whose times overlap (each with `task_id`, `start_ms`, `end_ms`; right's columns must else differ).

    Time is divided into blocks, `radix` of which make one of the next level. An interval has the few blocks of all levels that
    cover it, whose number grows with the logarithm of its length, and at each level at most two that it fills in part. Two intervals that
    overlap have a block in common that one of them fills: the larger of the two that hold the overlap's start, and no other one that holds it.
    So the equi-key is task, level and block, a long recording is no nested loop, and a long interval isn't cut into all its finest blocks.
    """

    def cut(df: DataFrame, s: str, e: str, filled: tuple[int, ...], torn: int) -> DataFrame:
        lo, hi = F.floor(F.col(s) / block_ms), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / block_ms) + 1
        ends = df.withColumns({"__lo": lo, "__hi": hi})
        cover, part = _blocks(F.col("__lo"), F.col("__hi"), radix, levels)
        told = lambda which, tag: F.transform(which, lambda n: F.struct(F.lit(tag).alias("__tag"), n["level"].alias("__level"), n["node"].alias("__node")))
        return ends.withColumn("__blocks", F.concat(*[told(cover, k) for k in filled], told(part, torn))).drop("__lo", "__hi").select("*", F.inline("__blocks")).drop("__blocks")

    # the tag keeps blocks that both fill in part from meeting, so hot ones of the upper levels aren't joined
    l = cut(left, "start_ms", "end_ms", (0,), 1)
    r = cut(right.withColumnsRenamed({"start_ms": "r_start_ms", "end_ms": "r_end_ms"}), "r_start_ms", "r_end_ms", (0, 1), 0)
    overlaps = (F.col("r_end_ms") > F.col("start_ms")) & (F.col("r_start_ms") < F.col("end_ms"))
    own = F.floor(F.greatest("start_ms", "r_start_ms") / (F.lit(block_ms) * F.pow(F.lit(radix), F.col("__level")).cast("bigint"))) == F.col("__node")
    return l.join(r, ["task_id", "__level", "__node", "__tag"]).where(overlaps & own).drop("__level", "__node", "__tag")


def previous(df: DataFrame, column: str, default=None, by: str = "idx") -> Column:
    return F.lag(column, 1, default).over(in_order(by=by))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate with map-side combine: no key's rows are gathered."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*")


def islands(df: DataFrame, new_island: Column, by: str = "idx", task: str = "task_id") -> DataFrame:
    """Add `island`, counted up in each task wherever `new_island` holds."""
    return df.withColumn("__new", F.coalesce(new_island.cast("int"), F.lit(1))).withColumn("island", F.sum("__new").over(in_order(task, by))).drop("__new")


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every occurrence of a key but its first."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("occurrence", nth).where("occurrence > 1")


def ordered_text(value: Column, order: Column, separator: str = "\n") -> Column:
    """An aggregate: values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def dictionary_priority(scope: Column, explicit: Column, default: Column) -> Column:
    """2 explicit project, 3 project default, 4 explicit global, 5 global default, null if not used."""
    project = scope == "project"
    return F.when(project & explicit, 2).when(project & default, 3).when(~project & explicit, 4).when(~project & default, 5)


def dictionary_winners(candidates: DataFrame) -> DataFrame:
    """One candidate for each entry_id: least priority, then dictionary_id, then part."""
    rest = [c for c in candidates.columns if c != "entry_id"]
    best = F.min_by(F.struct(*rest), F.struct("priority", "dictionary_id", "part"))
    return candidates.groupBy("entry_id").agg(best.alias("b")).select("entry_id", "b.*")


def merge_findings(found: DataFrame) -> DataFrame:
    """Findings of one identity become one: references united, the highest confidence kept, and among equals the
    smallest rationale; different suggestions under one identity are a conflict."""
    rank = F.expr("CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END")
    return found.groupBy("task_id", "kind", "start_ms", "end_ms", "current_text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
        F.min_by(F.struct("confidence", "rationale"), F.struct(-rank, F.col("rationale"))).alias("best"),
        (F.count_distinct(F.coalesce("suggested_text", F.lit("\x00"))) > 1).alias("conflict"),
    ).select("task_id", "kind", "start_ms", "end_ms", "current_text", "refs", "best.confidence", "best.rationale", "conflict")
