"""Audio frames packed into chunks that end with cues, without a list of any recording's frames.

A chunk takes as many frames as `target` bytes hold; if none, as `hard` bytes hold. If a cue ends behind the chunk's start and no
later than its frames, the chunk ends with the last such cue, at the nearest frame, the earlier of two. So where a chunk ends depends on the
frame that it begins behind and, through the last chunk's end, on one time. From a frame there are only two ways on: to the last frame that
fits, or to the cue. These ways are found for all frames at once; which of them the chunks are is found by doubling: who knows the
successor of 2^k steps of every place, and the places up to 2^k steps from the start, gets those of 2^(k+1) by two joins.

Windows have a stretch of bytes or of time as their key besides the recording, and take over what earlier stretches end with, so a long
recording is no single sort, and joins have the frame as a key. `mp3.pack` is the same on one recording's lists; the tests compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.sources.storage import fresh

#: Frames and milliseconds that a window takes at once.
FRAMES, SPAN_MS = 4_096, 600_000
TASK = "task_id"


def cuts(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, n, offset, at): bytes and time after each frame, times scaled to the file's length; the last row is the file's end.
    frames: task_id, n (0, 1, ...), bytes, length_ms; files: task_id, file_bytes, file_ms."""
    blocks = frames.select(TASK, "n", "bytes", F.col("length_ms").cast("double").alias("ms"), F.floor(F.col("n") / FRAMES).alias("b"))
    sums = blocks.groupBy(TASK, "b").agg(F.sum("bytes").alias("block_bytes"), F.sum("ms").alias("block_ms"), F.count("*").alias("c"))
    whole, earlier = W.partitionBy(TASK), W.partitionBy(TASK).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        TASK, "b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("block_bytes", "block_ms")],
        F.sum("block_ms").over(whole).alias("all_ms"), F.sum("c").over(whole).alias("frames"),
    )
    inside = W.partitionBy(TASK, "b").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    summed = blocks.withColumns({"offset": F.sum("bytes").over(inside), "elapsed": F.sum("ms").over(inside)}).join(carried, [TASK, "b"]).join(files, TASK)
    time = F.floor((F.col("elapsed") + F.col("before_block_ms")) * (F.col("file_ms") / F.col("all_ms")) + 0.5).cast("long")
    end = F.col("n") == F.col("frames") - 1
    return summed.select(
        TASK, F.col("n").cast("long").alias("n"), F.when(end, F.col("file_bytes")).otherwise(F.col("offset") + F.col("before_block_bytes")).cast("long").alias("offset"),
        F.when(end, F.col("file_ms")).otherwise(F.greatest(F.lit(0), F.least(F.col("file_ms"), time))).cast("long").alias("at"),
    )


def latest(rows: DataFrame, sign: int = 1) -> DataFrame:
    """`rows` (task_id, t, kind, value, ...) with `value` of the last row that has one, up to each row by t, then kind; from the other end if `sign` is -1."""
    at = rows.withColumn("o", F.col("t") * sign).withColumn("b", F.floor(F.col("o") / SPAN_MS))
    ends = at.groupBy(TASK, "b").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("o"))).alias("v"))
    before = F.last("v", ignorenulls=True).over(W.partitionBy(TASK).orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    inside = F.last("value", ignorenulls=True).over(W.partitionBy(TASK, "b").orderBy("o", "kind").rowsBetween(W.unboundedPreceding, 0))
    return at.withColumn("value", inside).join(ends.select(TASK, "b", before.alias("before")), [TASK, "b"]).withColumn("value", F.coalesce("value", "before")).drop("o", "b", "before")


def nearest_frames(cut: DataFrame, cue_ends: DataFrame) -> DataFrame:
    """(task_id, cue, near): the frame whose end is nearest to each cue's, the earliest of equals."""
    empty = F.lit(None).cast("struct<at:bigint,n:bigint>")
    marks = cut.groupBy(TASK, F.col("at").alias("t")).agg(F.min("n").alias("n")).select(TASK, "t", F.lit(0).alias("kind"), F.struct(F.col("t").alias("at"), "n").alias("value"))
    cues = cue_ends.select(TASK, F.col("end_ms").cast("long").alias("t")).where("t IS NOT NULL").distinct().select(TASK, "t", F.lit(1).alias("kind"), empty.alias("value"))
    before, after = (latest(marks.unionByName(cues), s).where("kind = 1").select(TASK, F.col("t").alias("cue"), F.col("value").alias(name)) for s, name in ((1, "p"), (-1, "q")))
    far = F.col("q").isNull() | (F.col("cue") - F.col("p.at") <= F.col("q.at") - F.col("cue"))
    return before.join(after, [TASK, "cue"]).where("p IS NOT NULL OR q IS NOT NULL").select(TASK, "cue", F.when(F.col("p").isNotNull() & far, F.col("p.n")).otherwise(F.col("q.n")).alias("near"))


def reach(cut: DataFrame, target: int, hard: int) -> DataFrame:
    """(task_id, n, offset, fit, fit_at): the last frame that fits behind each one, and its time; null if none does. A window has a stretch
    of bytes, and the frames that those near its end may reach."""
    wide = 4 * hard
    start = cut.select(TASK).distinct().select(TASK, F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("at"))
    b = F.floor(F.col("offset") / wide)
    copied = F.when((b > 0) & (F.col("offset") - b * wide <= hard), F.array(b, b - 1)).otherwise(F.array(b))
    spread = cut.unionByName(start).withColumn("own", b).withColumn("b", F.explode(copied))
    row = F.struct("n", "at")
    within = lambda most: F.max(row).over(W.partitionBy(TASK, "b").orderBy("offset").rangeBetween(0, most))
    found = spread.withColumns({"some": within(target), "one": within(hard)}).where("b = own")
    best: Column = F.when(F.col("some.n") > F.col("n"), F.col("some")).when(F.col("one.n") > F.col("n"), F.col("one"))
    return found.select(TASK, "n", "offset", best.alias("f")).select(TASK, "n", "offset", F.col("f.n").alias("fit"), F.col("f.at").alias("fit_at"))


def ways(cut: DataFrame, cue_ends: DataFrame, target: int, hard: int) -> DataFrame:
    """(task_id, n, offset, fit, fit_at, cue, cue_n): each frame's two ways on; `cue` is the last cue no later than what fits."""
    cues = nearest_frames(cut, cue_ends).select(TASK, F.col("cue").alias("t"), F.lit(0).alias("kind"), F.struct("cue", "near").alias("value"), *[F.lit(None).cast("long").alias(c) for c in ("n", "offset", "fit")])
    asked = reach(cut, target, hard)
    rows = asked.where("fit IS NOT NULL").select(TASK, F.col("fit_at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<cue:bigint,near:bigint>").alias("value"), "n", "offset", "fit")
    known = latest(cues.unionByName(rows)).where("kind = 1")
    on = known.select(TASK, "n", "offset", "fit", F.col("t").alias("fit_at"), F.col("value.cue").alias("cue"), F.greatest(F.col("value.near"), F.col("n") + 1).alias("cue_n"))
    stuck = asked.where("fit IS NULL").select(TASK, "n", "offset", "fit", "fit_at", F.lit(None).cast("long").alias("cue"), F.lit(None).cast("long").alias("cue_n"))
    return on.unionByName(stuck)


def packed(cut: DataFrame, cue_ends: DataFrame, target: int, hard: int) -> DataFrame:
    """(task_id, chunk, start, end, start_ms, end_ms, problem) of `cuts` and (task_id, end_ms) of cues. A recording's chunks end early with a `problem`
    where a frame has more than `hard` bytes (`frame_too_large`) or a chunk would have no time (`no_time`); then `end` and `end_ms` are null.
    A recording without frames has no chunks; one without cues is packed by bytes alone. 1 <= target <= hard."""
    if not 1 <= target <= hard:
        raise ValueError("1 <= target <= hard")
    spark = cut.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = fresh(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    cut = kept(cut.select(TASK, "n", "offset", "at"), "pack-cuts")
    way = kept(ways(cut, cue_ends, target, hard), "pack-ways")
    last = cut.groupBy(TASK).agg(F.max("n").alias("last"), F.max("at").alias("all_ms"))
    place = lambda n, m: F.struct(n.alias("n"), m.alias("m"))
    start = last.select(TASK, F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))
    arrived = way.where("fit IS NOT NULL").select(TASK, F.explode(F.array(place(F.col("fit"), F.col("fit_at")), place(F.col("cue_n"), F.col("cue")))).alias("p")).where("p.n IS NOT NULL AND p.m IS NOT NULL").select(TASK, "p.n", "p.m")
    places = arrived.unionByName(start).distinct()
    by_cue = F.coalesce(F.col("cue") > F.col("m"), F.lit(False))
    to_n = F.when(by_cue, F.col("cue_n")).otherwise(F.col("fit"))
    to_m = F.when(to_n == F.col("last"), F.col("all_ms")).when(by_cue, F.col("cue")).otherwise(F.col("fit_at"))
    went = places.join(way, [TASK, "n"]).join(last, TASK).where("n < last").select(TASK, "n", "m", "offset", to_n.alias("to_n"), to_m.alias("to_m"), (to_n == F.col("last")).alias("final"))
    problem = F.when(F.col("to_n").isNull(), "frame_too_large").when(~F.col("final") & (F.col("to_m") <= F.col("m")), "no_time")
    step = kept(went.withColumn("problem", problem), "pack-steps")

    jump = step.where("problem IS NULL AND NOT final").select(TASK, "n", "m", "to_n", "to_m")
    seen, new, k = None, kept(start.withColumn("chunk", F.lit(0).cast("long")), "pack-seen"), 0
    while not new.isEmpty():
        seen = new if seen is None else seen.unionByName(new)
        there = seen.join(jump, [TASK, "n", "m"]).select(TASK, F.col("to_n").alias("n"), F.col("to_m").alias("m"), (F.col("chunk") + 2**k).alias("chunk"))
        new = kept(there, "pack-seen")
        onward = jump.select(TASK, F.col("n").alias("to_n"), F.col("m").alias("to_m"), F.col("to_n").alias("next_n"), F.col("to_m").alias("next_m"))
        jump, k = kept(jump.join(onward, [TASK, "to_n", "to_m"]).select(TASK, "n", "m", F.col("next_n").alias("to_n"), F.col("next_m").alias("to_m")), "pack-jumps"), k + 1
    if seen is None:
        seen = new
    ends = cut.select(TASK, F.col("n").alias("to_n"), F.col("offset").alias("end"))
    chunks = seen.join(step, [TASK, "n", "m"]).join(ends, [TASK, "to_n"], "left")
    fine = lambda c: F.when(F.col("problem").isNull(), F.col(c))
    return chunks.select(TASK, "chunk", F.col("offset").alias("start"), fine("end").alias("end"), F.col("m").alias("start_ms"), fine("to_m").alias("end_ms"), "problem")
