"""Corrections and review decisions on cues whose times never change."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators.relational import in_order
from cuelake.sources.storage import fresh


def apply_suggestions(cues: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Cues with their suggestions applied one after another, each on what the one before left: the first
    occurrence of its original text is replaced. (task_id, segment_id, text, applied)"""
    lists = suggestions.groupBy("task_id", F.col("segment_ref").alias("segment_id")).agg(
        F.array_sort(F.collect_list(F.struct("suggestion_id", "original_text", "suggested_text"))).alias("s")
    )
    both = cues.join(lists, ["task_id", "segment_id"], "left").withColumn("s", F.coalesce("s", F.array().cast(lists.schema["s"].dataType)))
    state = F.struct(F.col("text").alias("text"), F.lit(0).alias("applied"))

    def step(acc, s):
        at = F.instr(acc["text"], s["original_text"])
        fits = (at > 0) & (s["original_text"] != "") & (F.trim(s["suggested_text"]) != "")
        changed = F.overlay(acc["text"], s["suggested_text"], at, F.length(s["original_text"]))
        return F.when(fits, F.struct(changed.alias("text"), (acc["applied"] + 1).alias("applied"))).otherwise(acc)

    return both.select("task_id", "segment_id", F.aggregate("s", state, step).alias("r")).select("task_id", "segment_id", "r.*")


def distribute(pieces: list[str], patches: list[tuple[int, int, str]]) -> list[str]:
    """The joined pieces with patches (start, end, replacement), cut again: a boundary inside a patch moves in
    proportion, every piece keeps a character. ValueError where that can't be."""
    whole = "".join(pieces)
    patches = sorted(patches)
    if any(b > len(whole) for _, b, _ in patches) or any(q[0] < p[1] for p, q in zip(patches, patches[1:], strict=False)):
        raise ValueError("patches overlap or leave the text")
    parts, at, shifts = [], 0, [0]
    for a, b, new in patches:
        parts += [whole[at:a], new]
        at = b
        shifts.append(shifts[-1] + len(new) - (b - a))
    text = "".join([*parts, whole[at:]])
    if len(text) < len(pieces):
        raise ValueError("too little text for the cues")
    starts = [a for a, _, _ in patches]

    def moved(boundary: int) -> int:
        k = bisect_left(starts, boundary)
        if k and boundary < patches[k - 1][1]:
            a, b, new = patches[k - 1]
            return a + shifts[k - 1] + math.floor((boundary - a) / (b - a) * len(new) + 0.5)
        return boundary + shifts[k]

    cuts, length = [0], 0
    for k, piece in enumerate(pieces[:-1], 1):
        length += len(piece)
        cuts.append(max(cuts[-1] + 1, min(moved(length), len(text) - (len(pieces) - k))))
    out = [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    if not all(out):
        raise ValueError("an empty cue")
    return out


def _linked(links: DataFrame) -> DataFrame:
    """(task_id, island, component) of islands in links (task_id, a, b): the least island that each one reaches. A round takes
    the least label of the neighbours, then that label's own, so rounds grow with the logarithm of the longest chain; each is written."""
    spark = links.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = fresh(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = written(links.union(links.select("task_id", "b", "a")).toDF("task_id", "island", "other").distinct(), "review-links")
    labels = written(edges.groupBy("task_id", "island").agg(F.least(F.col("island"), F.min("other")).alias("component")), "review-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("island", "other"), ["task_id", "other"]).groupBy("task_id", "island").agg(F.min("component").alias("near"))
        least = labels.join(near, ["task_id", "island"]).select("task_id", "island", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("new"))
        least = written(least, "review-labels")
        if least.where("new").isEmpty():
            return labels
        own = least.select("task_id", F.col("island").alias("component"), F.col("component").alias("further"))
        labels = written(least.join(own, ["task_id", "component"], "left").select("task_id", "island", F.least("component", "further").alias("component")), "review-labels")


def change_components(changes: DataFrame) -> DataFrame:
    """Changes with `component`: those that share a target, in steps, have one number in their task.

    A change's targets are runs of neighbours. Runs that overlap share a target, so a window over the runs of a task numbers
    their islands; only a change of several runs links islands, and only such links need a search."""
    ends = F.struct(F.array_min("targets").alias("lo"), F.array_max("targets").alias("hi"))
    plain = F.array_max("targets") - F.array_min("targets") + 1 == F.size(F.array_distinct("targets"))
    whole = changes.where(plain).select("task_id", "change_id", ends.alias("e")).select("task_id", "change_id", "e.lo", "e.hi")
    apart = changes.where(~plain).select("task_id", "change_id", F.posexplode(F.array_sort(F.array_distinct("targets"))).alias("i", "idx"))
    cut = apart.groupBy("task_id", "change_id", F.col("idx") - F.col("i")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("task_id", "change_id", "lo", "hi")
    ordered = W.partitionBy("task_id").orderBy("lo", "hi", "change_id")
    reach = F.max("hi").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    runs = whole.unionByName(cut).withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(ordered)).drop("new")
    path = fresh(changes.sparkSession, "review-runs")
    runs.write.parquet(path)
    runs = changes.sparkSession.read.schema(runs.schema).parquet(path)
    of = runs.groupBy("task_id", "change_id").agg(F.min("island").alias("island"), F.array_sort(F.collect_set("island")).alias("all"))
    several = of.where(F.size("all") > 1)
    if several.isEmpty():
        labelled = of.withColumn("component", F.col("island"))
    else:
        links = several.select("task_id", F.col("island").alias("a"), F.explode(F.slice("all", 2, F.size("all") - 1)).alias("b"))
        labelled = of.join(_linked(links), ["task_id", "island"], "left").withColumn("component", F.coalesce("component", "island"))
    return changes.join(labelled.select("task_id", "change_id", "component"), ["task_id", "change_id"])


def _decided(cues: list[tuple[int, str]], changes: list[tuple]) -> list[tuple[int, str, str | None]]:
    """(idx, text, problem) of the cues of a component after its changes (targets, begin, proposed, final)."""
    at = {idx: k for k, (idx, _) in enumerate(cues)}
    starts = [0, *itertools.accumulate(len(t) for _, t in cues)]
    whole, patches = "".join(t for _, t in cues), []
    try:
        for targets, begin, proposed, final in changes:
            if any(i not in at for i in targets) or any(b != a + 1 for a, b in zip(targets, targets[1:], strict=False)):
                raise ValueError("targets aren't neighbouring cues")
            a = starts[at[targets[0]]] + begin
            if whole[a : a + len(proposed)] != proposed:
                raise ValueError("the text has changed")
            patches.append((a, a + len(proposed), final))
        return [(idx, t, None) for (idx, _), t in zip(cues, distribute([t for _, t in cues], patches), strict=True)]
    except ValueError as e:
        return [(idx, t, str(e)) for idx, t in cues]


def _decide_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components one after another, from rows sorted by (task_id, component, change or cue, place)."""
    schema = pa.schema([("task_id", pa.int64()), ("idx", pa.int64()), ("text", pa.string()), ("problem", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    now, cues, changes = None, [], []
    for batch in batches:
        done = []
        for task, component, idx, text, targets, begin, proposed, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (task, component):
                done += [(now[0], *r) for r in _decided(cues, changes)] if cues else []
                now, cues, changes = (task, component), [], []
            if targets is None:
                cues.append((idx, text))
            else:
                changes.append((targets, begin, proposed, final))
        if done:
            yield out(done)
    if cues:
        yield out([(now[0], *r) for r in _decided(cues, changes)])


def apply_decisions(cues: DataFrame, changes: DataFrame) -> DataFrame:
    """(task_id, idx, text, problem). changes: task_id, change_id, targets (cue numbers), begin (within the first
    one), proposed_text, final_text. What is decided together are the changes of a component and their cues; a cue
    without a change passes by."""
    marked = change_components(changes)
    path = fresh(cues.sparkSession, "review-changes")
    marked.write.parquet(path)
    marked = cues.sparkSession.read.schema(marked.schema).parquet(path)
    placed = marked.select("task_id", "component", F.explode("targets").alias("idx")).distinct()
    mine = cues.select("task_id", "idx", "text").join(placed, ["task_id", "idx"], "left")
    path = fresh(cues.sparkSession, "review-cues")
    mine.write.parquet(path)
    mine = cues.sparkSession.read.schema(mine.schema).parquet(path)
    free = mine.where("component IS NULL").select("task_id", "idx", "text", F.lit(None).cast("string").alias("problem"))
    told = marked.select("task_id", "component", F.lit(0).alias("kind"), "change_id", F.transform("targets", lambda x: x.cast("long")).alias("targets"), F.col("begin").cast("long").alias("begin"), "proposed_text", "final_text")
    both = mine.where("component IS NOT NULL").withColumn("kind", F.lit(1)).unionByName(told, allowMissingColumns=True)
    dealt = both.repartition("task_id", "component").sortWithinPartitions("task_id", "component", "kind", "idx", "change_id")
    rows = dealt.select("task_id", "component", F.col("idx").cast("long"), "text", "targets", "begin", "proposed_text", "final_text")
    return free.unionByName(rows.mapInArrow(_decide_batches, "task_id long, idx long, text string, problem string"))


def fold_decisions(log: DataFrame) -> DataFrame:
    """The state of each change from its log (task_id, change_id, sequence, decision): the last decision wins."""
    return log.groupBy("task_id", "change_id").agg(F.max_by("decision", "sequence").alias("decision"), F.max("sequence").alias("sequence"), F.count("*").alias("decisions"))


def approval(states: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approved while nothing is pending and no decision is later than the approval."""
    decided = states.groupBy("task_id").agg(F.count_if(F.col("decision") == "pending").alias("pending"), F.max("sequence").alias("last"))
    at = approvals.groupBy("task_id").agg(F.max("sequence").alias("approved_at"))
    ok = (F.col("pending") == 0) & F.coalesce(F.col("approved_at") > F.col("last"), F.lit(False))
    return decided.join(at, "task_id", "left").select("task_id", "pending", ok.alias("approved"))


def number(df: DataFrame, prefix: str) -> DataFrame:
    """Dense ids of a task's rows in order."""
    return df.withColumn("id", F.format_string(prefix + "-%04d", F.row_number().over(in_order())))
