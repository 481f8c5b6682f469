"""The checks of a finished SRT file against the cues it was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import visible as V
from cuelake.sources.storage import fresh

#: Checks that also report when they pass.
REPORTED = ("SRT_UTF8", "SRT_SEQUENCE", "SRT_TIME_FORMAT", "SRT_TEXT", "SRT_VISIBLE_SUBTITLE_STYLE", "SRT_TIMELINE", "SRT_LINE_COUNT", "SRT_LINE_LENGTH", "SRT_CALIBRATED_MAPPING")
_LINE = r"^(\d{2,}:\d{2}:\d{2},\d{3}) --> (\d{2,}:\d{2}:\d{2},\d{3})$"


def _found(*tests: tuple[str, Column, str | Column]) -> Column:
    """An array of (check, status) of the tests that hold."""
    rows = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("check"), (F.lit(s) if isinstance(s, str) else s).alias("status"))) for k, c, s in tests]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def _written(df: DataFrame, name: str) -> DataFrame:
    """What several checks read is made once."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(text: Column) -> Column:
    return V.visible(T.flat_text(text))["removed"]


def validate(files: DataFrame, expected: DataFrame, mode: str = "text-only", purpose: str = "calibrated", removed=_removed) -> DataFrame:
    """(key, check, status, n): per file and check the worst status and how often it failed or warned (0 if it passed).

    files: key, source (decoded, without the byte-order mark but with its own newlines), bom (whether it had one), duration_ms. expected: key, idx, start_ms,
    end_ms, text (as shown), and reference_start and reference_end, the times that text-only output must keep; null
    where there is no reference cue. `removed` counts the marks that shown text must not have.
    """
    transcribed, text_only = purpose == "transcribed", mode == "text-only"
    plain = F.replace("source", F.lit("\r\n"), F.lit("\n"))
    rest = F.replace("source", F.lit("\r\n"), F.lit(""))
    expected = _written(expected, "srt-expected")
    whole = files.select(
        "key", "duration_ms",
        _found(
            ("SRT_UTF8", F.col("bom"), "failed"),
            ("SRT_NEWLINES", rest.contains("\r") | (F.col("source").contains("\r\n") & rest.contains("\n")), "failed"),
            ("SRT_FINAL_NEWLINE", ~plain.endswith("\n") | plain.endswith("\n\n"), "failed"),
            ("SRT_BLOCKS", F.regexp_replace(plain, "\n$", "") == "", "failed"),
        ).alias("found"),
        F.filter(F.split(F.regexp_replace(plain, "\n$", ""), "\n\n"), lambda b: plain != "").alias("blocks"),
    )
    whole = _written(whole, "srt-files")
    per_block = whole.select("key", "duration_ms", F.posexplode("blocks").alias("block", "b")).withColumn("lines", F.split("b", "\n"))
    timing = F.get("lines", F.lit(1))
    start, end = T.parse_time(F.regexp_extract(timing, _LINE, 1)), T.parse_time(F.regexp_extract(timing, _LINE, 2))
    broken = (
        F.when(~F.size("lines").between(3, 4), "SRT_BLOCK_STRUCTURE")
        .when(F.get("lines", F.lit(0)) != (F.col("block") + 1).cast("string"), "SRT_SEQUENCE")
        .when(~timing.rlike(_LINE) | start.isNull() | end.isNull(), "SRT_TIME_FORMAT")
    )
    body = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    parsed = per_block.select("key", "duration_ms", "block", broken.alias("broken"), start.alias("s"), end.alias("e"), body.alias("body"), F.array_join(body, "\n").alias("t"))
    parsed = _written(parsed, "srt-blocks")
    good = parsed.where("broken is null")
    in_file = W.partitionBy("key").orderBy("block")
    placed = good.select("*", (F.row_number().over(in_file) - 1).cast("long").alias("idx"), F.lag("e").over(in_file).alias("before"), T.characters(F.col("t")).alias("n"), removed(F.col("t")).alias("marks"))
    cues = expected.select("key", F.col("idx").cast("long").alias("idx"), F.col("start_ms").alias("xs"), F.col("end_ms").alias("xe"), T.flat_text(F.col("text")).alias("xt"), "reference_start", "reference_end")
    mapped = _written(placed.join(cues, ["key", "idx"], "left"), "srt-mapped")
    ms = F.col("e") - F.col("s")
    issues = mapped.select(
        "key",
        F.concat(
            _found(
                ("SRT_TEXT", T.forbidden_text(F.col("t")).isNotNull(), "failed"),
                ("SRT_TIMELINE", (F.col("s") >= F.col("e")) | (F.col("e") > F.col("duration_ms")), "failed"),
                ("SRT_TIMELINE", F.col("s") < F.col("before"), "failed"),
                ("SRT_LINE_COUNT", F.size("body") > T.MAX_LINES, "failed"),
                ("SRT_VISIBLE_SUBTITLE_STYLE", F.col("marks") > 0, "failed"),
                ("SRT_HARD_CHARACTER_LIMIT", (F.col("n") > T.HARD_CHARACTERS) & F.lit(not transcribed), "failed"),
                ("SRT_DURATION", (ms < T.SOFT_MIN_MS) | (ms > T.SOFT_MAX_MS), "warning"),
                ("SRT_READING_SPEED", T.reading_speed(F.col("n"), ms) > T.MAX_SPEED, "warning"),
                ("SRT_CALIBRATED_MAPPING", F.col("xs").isNotNull() & ((F.col("s") != F.col("xs")) | (F.col("e") != F.col("xe")) | (T.flat_text(F.col("t")) != F.col("xt"))), "failed"),
            ),
            F.transform(
                F.filter("body", lambda line: T.characters(line) > T.TARGET_CHARACTERS),
                lambda _: F.struct(F.lit("SRT_LINE_LENGTH").alias("check"), F.lit("warning" if text_only or transcribed else "failed").alias("status")),
            ),
        ).alias("found"),
    )
    per_file = parsed.groupBy("key").agg(F.count("*").alias("blocks"), F.count_if(F.col("broken").isNull()).alias("good"))
    counts = files.select("key").join(per_file, "key", "left").join(expected.groupBy("key").agg(F.count("*").alias("cues"), F.count("reference_start").alias("references")), "key", "left").na.fill(0)
    moved = mapped.groupBy("key").agg(F.count_if(~F.col("s").eqNullSafe(F.col("reference_start")) | ~F.col("e").eqNullSafe(F.col("reference_end"))).alias("moved"))
    totals = counts.join(moved, "key", "left").na.fill(0).select(
        "key",
        ((F.col("blocks") > 0) & (F.col("blocks") == F.col("good"))).alias("complete"),
        _found(
            ("SRT_CALIBRATED_MAPPING", F.col("good") != F.col("cues"), "failed"),
            ("SRT_TEXT_ONLY_TIMELINE", F.lit(text_only and not transcribed) & ((F.col("references") != F.col("good")) | (F.col("moved") > 0)), "failed"),
        ).alias("found"),
    )
    structure = parsed.where("broken is not null").select("key", F.array(F.struct(F.col("broken").alias("check"), F.lit("failed").alias("status"))).alias("found"))
    every = whole.select("key", "found").unionByName(structure).unionByName(issues).unionByName(totals.select("key", "found"))
    found = every.select("key", F.inline("found")).groupBy("key", "check").agg(F.min("status").alias("status"), F.count("*").alias("n"))  # failed sorts before warning
    asked = totals.select("key", "complete", F.explode(F.array(*[F.lit(c) for c in (*REPORTED, *(["SRT_TEXT_ONLY_TIMELINE"] * (text_only and not transcribed)))])).alias("check"))
    # what depends on every block passes only in a file whose blocks all parse
    passed = asked.where(F.col("complete") | F.col("check").isin("SRT_UTF8", "SRT_TIMELINE", "SRT_CALIBRATED_MAPPING", "SRT_TEXT_ONLY_TIMELINE")).join(found.select("key", "check"), ["key", "check"], "left_anti")
    return found.unionByName(passed.select("key", "check", F.lit("passed").alias("status"), F.lit(0).cast("long").alias("n")))


def status(transcript_valid: Column, calibration_valid: Column, same_task: Column, suggestion_problem: Column, mode_problem: Column, reference_problem: Column, conclusion: Column, over_limit: Column) -> Column:
    """struct(status, code): the ladder of a correction run. The first rung that fails decides."""

    def rung(name: str, code: str | Column) -> Column:
        return F.struct(F.lit(name).alias("status"), (F.lit(code) if isinstance(code, str) else code).alias("code"))

    return (
        F.when(~transcript_valid, rung("failed", "UPSTREAM_TRANSCRIPT_INVALID"))
        .when(~calibration_valid, rung("failed", "UPSTREAM_CALIBRATION_INVALID"))
        .when(~same_task, rung("failed", "UPSTREAM_ARTIFACT_MISMATCH"))
        .when(suggestion_problem.isNotNull(), rung("failed", suggestion_problem))
        .when(mode_problem.isNotNull(), rung("rejected", mode_problem))
        .when(reference_problem.isNotNull(), rung("needs_input", reference_problem))
        .when(conclusion != "matched", rung("needs_input", "REFERENCE_AUDIO_MISMATCH"))
        .when(over_limit, rung("needs_input", "CALIBRATED_HARD_LIMIT_INVALID_FOR_FIXED_TIMELINE"))
        .otherwise(rung("completed", F.lit(None).cast("string")))
    )
