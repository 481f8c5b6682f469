"""Subtitle and transcript files as DataFrames. Readers take (key, source) rows and give a row a cue or a problem a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.relational import ordered_text

MAX_BYTES = 10 * 1024 * 1024


def decode(content: Column) -> Column:
    """Bytes as text: strict UTF-8 (null for other bytes), without a byte-order mark at the start, each kind of line end as a newline."""
    return T.unify_newlines(F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\\x{FEFF}", ""))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, bytes, sha256, source, problem) of each file: whole, strict UTF-8, no byte-order mark, one kind of newline."""
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    problem = F.when((F.col("length") < 1) | (F.col("length") > MAX_BYTES), "size").when(~valid, "encoding")
    return files.select(F.col("path").alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), decode(F.col("content")).alias("source"), problem.alias("problem"))


def detect_format(source: Column, path: Column) -> Column:
    """By content first, then by extension; null if neither tells."""
    start = F.regexp_replace(source, f"^{T.SPACE}+", "")
    return F.when(start.rlike(r"^WEBVTT(?:\s|$)"), "vtt").when(start.startswith("{"), "transcript_json").when(F.lower(path).endswith(".srt"), "srt")


_LINE = r"^(\d{2,}:\d{2}:\d{2},\d{3})\s+-->\s+(\d{2,}:\d{2}:\d{2},\d{3})$"


def parse_srt(files: DataFrame) -> DataFrame:
    """The strict reader: (key, block, sequence, start_ms, end_ms, text, problem). Sequences rise, with gaps allowed;
    a file's first problem is on its rows, and a file without blocks has one row."""
    plain = T.unify_newlines(F.regexp_replace("source", "^\\x{FEFF}", ""))
    blocks = F.filter(F.transform(F.split(plain, "\n[\t ]*\n"), T.trim), lambda b: b != "")
    rows = files.select("key", F.posexplode_outer(blocks).alias("block", "b")).withColumn("lines", F.split("b", "\n"))
    number, timing = T.trim(F.get("lines", F.lit(0))), T.trim(F.get("lines", F.lit(1)))
    parsed = rows.select(
        "key", "block", F.when(number.rlike("^[1-9][0-9]*$"), number.try_cast("long")).alias("sequence"),
        T.parse_time(F.regexp_extract(timing, _LINE, 1)).alias("start_ms"), T.parse_time(F.regexp_extract(timing, _LINE, 2)).alias("end_ms"),
        T.trim(F.array_join(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), "\n")).alias("text"), F.size("lines").alias("n"),
    )
    from pyspark.sql import Window as W

    in_file = W.partitionBy("key").orderBy("block")
    problem = (
        F.when(F.col("block").isNull(), "no_blocks")
        .when(F.col("n") < 3, "incomplete_block")
        .when(F.col("sequence").isNull(), "bad_sequence")
        .when(F.col("sequence") <= F.coalesce(F.lag("sequence").over(in_file), F.lit(0)), "sequence_order")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad_timeline")
        .when(F.col("text") == "", "empty_text")
    )
    first = F.first("p", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return parsed.withColumn("p", problem).withColumn("problem", first).drop("p", "n")


#: Markup that SRT and WebVTT cues may have, and VTT's entities; fixed values.
SRT_MARKUP = ("(?i)</?(?:i|b|u)>", r"(?i)<font(?:\s+[^>]*)?>|</font>")
VTT_MARKUP = (r"(?i)</?v(?:\.[^ >]+)*(?:\s+[^>]*)?>", r"(?i)</?(?:c|i|b|u|ruby|rt|lang)(?:\.[^ >]+)*(?:\s+[^>]*)?>")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&nbsp;": " "}


def strip_srt_markup(c: Column) -> Column:
    return reduce(lambda out, tag: F.regexp_replace(out, tag, ""), SRT_MARKUP, c)


def strip_vtt_markup(c: Column) -> Column:
    """Known tags go and four entities are decoded; null if other markup is left."""
    out = reduce(lambda out, tag: F.regexp_replace(out, tag, ""), VTT_MARKUP, c)
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.when(~c.rlike("[<&]"), c).when(~out.rlike("<[^>]*>") & ~out.rlike("&[a-zA-Z0-9#]+;"), out)


#: Cue settings that may follow a VTT timing; fixed values.
VTT_SETTINGS = (
    r"^(?:(?:line:(?:-?\d+(?:\.\d+)?%?|auto)(?:,(?:start|center|end))?|position:\d+(?:\.\d+)?%(?:,(?:line-left|center|line-right))?"
    r"|size:\d+(?:\.\d+)?%|align:(?:start|center|end|left|right)|vertical:(?:rl|lr))\s*)+$"
)


def _cues(files: DataFrame, vtt: bool) -> DataFrame:
    """Blocks of a lenient import: an identifier is optional; markup that isn't known is a problem."""
    from pyspark.sql import Window as W

    source = T.unify_newlines(F.regexp_replace("source", "^\\x{FEFF}", ""))
    header = F.trim(F.get(F.split(source, "\n", 2), F.lit(0))).rlike(r"^WEBVTT(?:[ \t].*)?$") if vtt else F.lit(True)
    body = F.coalesce(F.get(F.split(source, "\n", 2), F.lit(1)), F.lit("")) if vtt else source
    blocks = F.filter(F.transform(F.split(body, r"\n[ \t]*\n+"), lambda b: F.regexp_replace(b, r"^\n+|\s+$", "")), lambda b: T.trim(b) != "")
    if vtt:
        blocks = F.filter(blocks, lambda b: ~T.trim(b).rlike(r"^(?:NOTE|STYLE|REGION)(?:\s|$)"))
    rows = files.select("key", header.alias("header"), F.posexplode_outer(blocks).alias("block", "b"))
    lines = F.split("b", "\n")
    named = ~F.get(lines, F.lit(0)).contains("-->")
    rest = F.when(named, F.slice(lines, 2, F.size(lines))).otherwise(lines)
    rows = rows.select("key", "header", "block", F.when(named, T.trim(F.get(lines, F.lit(0)))).alias("identifier"), rest.alias("rest"))
    timing = r"^(\S+)\s+-->\s+(\S+)(?:\s+(.*))?$" if vtt else r"^(\S+)\s+-->\s+(\S+)\s*$"
    line = T.trim(F.get("rest", F.lit(0)))
    raw = F.array_join(F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))), "\n")
    text = strip_vtt_markup(raw) if vtt else F.when(~strip_srt_markup(raw).rlike("<[^>]*>"), strip_srt_markup(raw))
    settings = F.trim(F.regexp_extract(line, timing, 3)) if vtt else F.lit("")
    cues = rows.select(
        "key", "header", "block", "identifier", line.rlike(timing).alias("timed"), T.parse_time(F.regexp_extract(line, timing, 1), vtt).alias("start_ms"),
        T.parse_time(F.regexp_extract(line, timing, 2), vtt).alias("end_ms"), (raw != text).alias("stripped"), T.trim(text).alias("text"), settings.alias("settings"),
    )
    in_file = W.partitionBy("key").orderBy("block")
    problem = (
        F.when(~F.col("header"), "no_header")
        .when(F.col("block").isNull(), "no_cues")
        .when(~F.col("timed"), "no_timing")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad_timestamp")
        .when((F.col("settings") != "") & ~F.col("settings").rlike(VTT_SETTINGS), "unsupported_settings")
        .when(F.col("text").isNull(), "unsupported_markup")
        .when(T.safe_text_problem(F.col("text")).isNotNull(), T.safe_text_problem(F.col("text")))
        .when(F.col("end_ms") <= F.col("start_ms"), "bad_interval")
        .when(F.col("start_ms") < F.lag("end_ms", 1, -1).over(in_file), "overlap")
    )
    first = F.first("p", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return cues.withColumn("p", problem).withColumn("problem", first).drop("p", "header", "timed")


def import_srt(files: DataFrame) -> DataFrame:
    return _cues(files, vtt=False)


def import_vtt(files: DataFrame) -> DataFrame:
    return _cues(files, vtt=True)


def keep_words(words: Column, start: Column, end: Column) -> Column:
    """struct(words, dropped): words that lie in the cue and don't start before the last kept one has ended."""
    state = F.struct(F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>").alias("words"), F.lit(0).alias("dropped"), start.alias("last"))

    def step(acc: Column, w: Column) -> Column:
        valid = (T.trim(w["text"]) != "") & (w["start_ms"] >= acc["last"]) & (w["end_ms"] > w["start_ms"]) & (w["end_ms"] <= end)
        kept = F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"))
        return F.when(
            F.coalesce(valid, F.lit(False)), F.struct(F.array_append(acc["words"], kept).alias("words"), acc["dropped"].alias("dropped"), w["end_ms"].alias("last"))
        ).otherwise(F.struct(acc["words"].alias("words"), (acc["dropped"] + 1).alias("dropped"), acc["last"].alias("last")))

    return F.aggregate(F.coalesce(words, F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>")), state, step, lambda a: F.struct(a["words"], a["dropped"]))


TRANSCRIPT = "text string, segments array<struct<index:bigint, start_ms:bigint, end_ms:bigint, text:string, words:array<struct<text:string,start_ms:bigint,end_ms:bigint,confidence:double>>>>"


def import_transcript_json(files: DataFrame) -> DataFrame:
    """(key, index, start_ms, end_ms, text, words, dropped, problem) of a transcript document. A word whose confidence is
    neither null nor from 0 to 1 is dropped, as one out of its place is."""
    from pyspark.sql import Window as W

    doc = files.select("key", F.from_json("source", TRANSCRIPT).alias("t"))
    joined = F.array_join(F.transform("t.segments", lambda s: s["text"]), "\n") == F.col("t.text")
    rows = doc.select("key", joined.alias("joined"), F.posexplode_outer("t.segments").alias("at", "s"))
    # a word without text is dropped
    sure = lambda w: F.coalesce(w["confidence"].between(0, 1), F.lit(True))
    words = F.transform("s.words", lambda w: F.struct(F.when(sure(w), w["text"]).otherwise("").alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms")))
    kept = keep_words(words, F.col("s.start_ms"), F.col("s.end_ms"))
    in_file = W.partitionBy("key").orderBy("at")
    problem = (
        F.when(F.col("at").isNull(), "no_segments")
        .when(~F.col("s.index").eqNullSafe(F.col("at").cast("long")), "bad_index")
        .when(~F.coalesce((F.col("s.start_ms") >= F.lag("s.end_ms", 1, -1).over(in_file)) & (F.col("s.end_ms") > F.col("s.start_ms")), F.lit(False)), "bad_interval")
        .when(T.trim(F.coalesce("s.text", F.lit(""))) == "", "empty_text")
        .when(~F.col("joined"), "text_differs")
    )
    first = F.first("p", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = rows.withColumn("k", kept).withColumn("p", problem).withColumn("problem", first)
    return out.select("key", F.col("s.index").alias("index"), F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"), F.col("s.text").alias("text"), "k.words", "k.dropped", "problem")


def cue_ids(content_sha256: Column, index: Column, start: Column, end: Column, text: Column) -> Column:
    """Ids that only content decides."""
    return F.concat(F.lit("seg-"), F.substring(F.sha2(F.concat_ws("\n", content_sha256, index.cast("string"), start.cast("string"), end.cast("string"), text), 256), 1, 16))


def write_srt(cues: DataFrame, key: str = "task_id", final_blank: bool = True) -> DataFrame:
    """(key, source) with each key's cues in the order of `idx`; with or without a blank line at the end."""
    block = F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.groupBy(F.col(key).alias("key")).agg(F.concat(ordered_text(block, F.col("idx")), F.lit("\n" if final_blank else "")).alias("source"))


def stream_content(bodies: DataFrame) -> DataFrame:
    """(key, content, finish_reason, events) of a server-sent event body: deltas joined up to the end mark."""
    from pyspark.sql import Window as W

    data = F.transform(F.filter(F.split(T.unify_newlines(F.col("source")), "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substr(x, F.lit(6))))
    rows = bodies.select("key", F.posexplode(F.filter(data, lambda x: x != "")).alias("pos", "d"))
    reason = F.nullif(F.get_json_object("d", "$.choices[0].finish_reason"), F.lit(""))
    ended = (F.col("d") == "[DONE]") | reason.isNotNull()
    before = F.coalesce(F.max(ended).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    used = rows.select("key", "pos", reason.alias("reason"), ended.alias("ended"), (F.col("d") != "[DONE]").alias("event"), F.coalesce(F.get_json_object("d", "$.choices[0].delta.content"), F.get_json_object("d", "$.choices[0].message.content"), F.lit("")).alias("chunk"), before.alias("after")).where("not after")
    return used.groupBy("key").agg(
        F.nullif(ordered_text(F.col("chunk"), F.col("pos"), ""), F.lit("")).alias("content"),
        F.when(F.bool_or("ended"), F.max("reason")).otherwise("stream_incomplete").alias("finish_reason"),
        F.count_if("event").alias("events"),
    )


def unfence(c: Column) -> Column:
    """What stands in a code fence, or the text itself."""
    inner = F.regexp_extract(T.trim(c), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(T.trim(c))


def corrected_units(c: Column) -> Column:
    """The units of a structured answer: only the key `corrected_units`, each unit with exactly three keys; else null."""
    schema = "corrected_units array<struct<unit_id:string,corrected_text:string,rationale:string>>"
    raw = F.from_json(F.get_json_object(c, "$.corrected_units"), "array<string>")
    exact = F.forall(raw, lambda u: F.array_sort(F.json_object_keys(u)) == F.array(F.lit("corrected_text"), F.lit("rationale"), F.lit("unit_id")))
    return F.when((F.json_object_keys(c) == F.array(F.lit("corrected_units"))) & exact, F.from_json(c, schema)["corrected_units"])


DICTIONARY_CSV = "entry_id string, canonical string, variants string, kind string, language string, case_sensitive string, number_sensitive string, notes string, tags string, enabled string"


def read_dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema=DICTIONARY_CSV, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    flag = lambda c, default: F.coalesce(F.lower(c).try_cast("boolean"), F.lit(default)).alias(c)
    return raw.select("entry_id", "canonical", F.from_json("variants", "array<string>").alias("variants"), "kind", "language", flag("case_sensitive", False), flag("number_sensitive", False), "notes", F.from_json("tags", "array<string>").alias("tags"), flag("enabled", True))


def guard_formula(c: Column) -> Column:
    """A cell that a spreadsheet would run gets a quote before it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_dictionary_csv(entries: DataFrame, path: str) -> None:
    """Never overwrites."""
    text = [c for c, t in entries.dtypes if t == "string"]
    columns = [guard_formula(F.col(c)).alias(c) if c in text else F.to_json(c).alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in entries.dtypes]
    entries.select(*columns).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def read_event_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Events past `after`, in the log's own order; a torn line has no sequence and is left out."""
    schema = "event_id string, task_id string, sequence bigint, occurred_at string, type string, data string, _torn string"
    events = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_torn").json(path)
    return events.where((F.col("sequence") > after) & F.col("_torn").isNull()).drop("_torn")


RECOGNIZED = "utterances array<struct<text:string,start_time:bigint,end_time:bigint,words:array<struct<text:string,start_time:bigint,end_time:bigint>>>>"


def import_recognized(bodies: DataFrame, lenient: bool = False) -> DataFrame:
    """(key, segment_id, start_ms, end_ms, text, words, dropped, problem) of a recognizer's answer (key, source).

    Blank words without times (-1) are no words. Strictly, any other word that doesn't fit is the file's problem;
    leniently such words are dropped and counted. Segments must be in order either way."""
    from pyspark.sql import Window as W

    rows = bodies.select("key", F.posexplode_outer(F.from_json("source", RECOGNIZED)["utterances"]).alias("at", "u"))
    spoken = F.filter(F.coalesce("u.words", F.array().cast("array<struct<text:string,start_time:bigint,end_time:bigint>>")), lambda w: ~((w["start_time"] == -1) & (w["end_time"] == -1) & (T.trim(w["text"]) == "")))
    words = F.transform(spoken, lambda w: F.struct(w["text"].alias("text"), w["start_time"].alias("start_ms"), w["end_time"].alias("end_ms")))
    in_file = W.partitionBy("key").orderBy("at")
    ordered = (F.col("u.start_time") >= F.lag("u.end_time", 1, 0).over(in_file)) & (F.col("u.end_time") > F.col("u.start_time"))
    kept = rows.withColumn("k", keep_words(words, F.col("u.start_time"), F.col("u.end_time"))).withColumn(
        "p",
        F.when(F.col("at").isNull(), "no_segments").when(T.trim(F.coalesce("u.text", F.lit(""))) == "", "empty_text").when(~F.coalesce(ordered, F.lit(False)), "bad_interval")
        .when((F.col("k.dropped") > 0) & F.lit(not lenient), "bad_word"),
    )
    first = F.first("p", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return kept.withColumn("problem", first).select(
        "key", F.format_string("asr-segment-%04d", F.col("at") + 1).alias("segment_id"), F.col("u.start_time").alias("start_ms"), F.col("u.end_time").alias("end_ms"), F.col("u.text").alias("text"),
        F.transform("k.words", lambda w, i: F.struct(F.format_string("asr-word-%04d-%04d", F.col("at") + 1, i + 1).alias("word_id"), w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"))).alias("words"),
        "k.dropped", "problem",
    )


def inspect(files: DataFrame, cues: DataFrame) -> DataFrame:
    """(key, bytes, sha256, format, cue_count, duration_ms, problem) of `read_files` and the cues that a reader found."""
    found = cues.groupBy("key").agg(F.count("start_ms").alias("cue_count"), F.max("end_ms").alias("duration_ms"), F.first("problem", ignorenulls=True).alias("__p"))
    joined = files.join(found, "key", "left")
    return joined.select("key", "bytes", "sha256", detect_format(F.col("source"), F.col("key")).alias("format"), "cue_count", "duration_ms", F.coalesce("problem", "__p").alias("problem"))


def log_gaps(events: DataFrame) -> DataFrame:
    """(task_id, sequence, expected) where a task's sequence isn't 1, 2, 3 and so on."""
    from pyspark.sql import Window as W

    expected = F.row_number().over(W.partitionBy("task_id").orderBy("sequence")).cast("long")
    return events.select("task_id", "sequence", expected.alias("expected")).where("sequence <> expected")


def split_valid(rows: DataFrame, column: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad rows) of JSON texts: a record that doesn't parse, or lacks what it needs, stops no other one."""
    parsed = rows.withColumn("record", F.from_json(column, schema))
    good = F.coalesce(F.expr(f"record.{required} IS NOT NULL"), F.lit(False))
    return parsed.where(good), rows.withColumn("record", F.from_json(column, schema)).where(~good).drop("record")
