"""Readers and writers, on texts written from the derived cues and on literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.plans import workload as D
from cuelake.plans.registry import query
from cuelake.plans.workload import sql
from cuelake.sources import subtitles as S

STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"
_SRT = f"string_agg((idx + 1) || chr(10) || {STAMP.format('start_ms')} || ' --> ' || {STAMP.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY idx)"


def files_of(spark, *sources):
    return spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sources)], "key string, source string")


@query("snk2_srt_text", sql(f"SELECT task_id AS key, {_SRT} || chr(10) AS source FROM segments GROUP BY task_id"))
def snk2(spark, d):
    return S.write_srt(D.segments(spark, d))


def _damaged(spark, d):
    """Files in which some sequences repeat, some times are wrong and some end early."""
    files = S.write_srt(D.segments(spark, d))
    source = F.when(F.col("key") % 10 == 3, F.regexp_replace("source", "\n2\n", "\n1\n")).when(F.col("key") % 10 == 5, F.replace("source", F.lit("00:00:0"), F.lit("00:99:0"))).when(F.col("key") % 10 == 7, F.concat("source", F.lit("\n9\n")))
    return files.select("key", source.otherwise(F.col("source")).alias("source"))


_MANY = "max(idx) OVER (PARTITION BY task_id) > 0"


@query("src1_strict_srt", sql(f"SELECT task_id AS key, idx::INT AS block, CASE WHEN task_id % 10 = 3 AND idx = 1 THEN 1 ELSE idx + 1 END AS sequence, CASE WHEN task_id % 10 = 5 AND start_ms < 10000 THEN NULL ELSE start_ms END AS start_ms, CASE WHEN task_id % 10 = 5 AND end_ms < 10000 THEN NULL ELSE end_ms END AS end_ms, text, CASE WHEN task_id % 10 = 3 AND {_MANY} THEN 'sequence_order' WHEN task_id % 10 = 5 THEN 'bad_timeline' WHEN task_id % 10 = 7 THEN 'incomplete_block' END AS problem FROM segments UNION ALL SELECT task_id, (count(*))::INT, 9, NULL, NULL, '', 'incomplete_block' FROM segments WHERE task_id % 10 = 7 GROUP BY task_id"))
def src1(spark, d):
    return S.parse_srt(_damaged(spark, d)).select("key", "block", "sequence", "start_ms", "end_ms", "text", "problem")


@query("src2_import_srt", sql("SELECT task_id AS key, idx::INT AS block, start_ms, end_ms, text, idx % 2 = 0 AS stripped FROM segments"))
def src2(spark, d):
    tagged = D.segments(spark, d).withColumn("text", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("<i>"), "text", F.lit("</i>"))).otherwise(F.col("text")))
    return S.import_srt(S.write_srt(tagged)).where("problem is null").select("key", "block", "start_ms", "end_ms", "text", "stripped")


@query("src3_import_vtt", sql("SELECT task_id AS key, idx::INT AS block, printf('cue %d', idx) AS identifier, start_ms, end_ms, text FROM segments"))
def src3(spark, d):
    """Cues with identifiers, settings and class tags, and a note that is skipped."""
    stamp = lambda c: F.replace(T.srt_time(F.col(c)), F.lit(","), F.lit("."))
    block = F.concat(F.format_string("cue %d\n", "idx"), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit(" align:start\n<c.loud>"), "text", F.lit("</c>\n"))
    files = D.segments(spark, d).groupBy(F.col("task_id").alias("key")).agg(S.ordered_text(block, F.col("idx")).alias("body"))
    source = F.concat(F.lit("WEBVTT title\n\nNOTE a note\nof two lines\n\n"), "body")
    return S.import_vtt(files.select("key", source.alias("source"))).where("problem is null").select("key", "block", "identifier", "start_ms", "end_ms", "text")


@query("src4_vtt_markup", "SELECT * FROM (VALUES ('a &amp; b', 'a & b'), ('<v.x Bob>hi</v>', 'hi'), ('<c.red>x</c> &lt;', 'x <'), ('<blink>x</blink>', NULL), ('&copy;', NULL), ('plain', 'plain')) v(raw, text)")
def src4(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("a &amp; b", "<v.x Bob>hi</v>", "<c.red>x</c> &lt;", "<blink>x</blink>", "&copy;", "plain")], "raw string")
    return rows.select("raw", S.strip_vtt_markup(F.col("raw")).alias("text"))


@query("src5_transcript_json", sql("""SELECT g.task_id AS key, g.idx AS "index", g.start_ms, g.end_ms, g.text, count(w.word) FILTER (w.word NOT IN (1, 2))::BIGINT AS kept, count(w.word) FILTER (w.word IN (1, 2))::INT AS dropped FROM segments g JOIN words w ON w.task_id = g.task_id AND w.idx = g.idx GROUP BY ALL"""))
def src5(spark, d):
    """Documents whose cues' second words start before their cues, and whose third words' confidence is above 1: these are
    dropped, the others kept. SRC14's fold is the same."""
    words = D.words(spark, d).withColumn("start_ms", F.when(F.col("word") == 1, -1).otherwise(F.col("start_ms")))
    words = words.withColumn("confidence", F.when(F.col("word") == 2, 1.5).when(F.col("word") > 3, 0.5))
    fields = ("text", "start_ms", "end_ms", "confidence")
    lists = words.groupBy("task_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", *fields))), lambda w: F.struct(*[w[c].alias(c) for c in fields])).alias("words"))
    cues = D.segments(spark, d).join(lists, ["task_id", "idx"]).select("task_id", F.struct(F.col("idx").alias("index"), "start_ms", "end_ms", "text", "words").alias("s"))
    docs = cues.groupBy(F.col("task_id").alias("key")).agg(F.array_sort(F.collect_list("s")).alias("segments"))
    source = F.to_json(F.struct(F.array_join(F.transform("segments", lambda s: s["text"]), "\n").alias("text"), "segments"))
    parsed = S.import_transcript_json(docs.select("key", source.alias("source"))).where("problem is null")
    return parsed.select("key", "index", "start_ms", "end_ms", "text", F.size("words").cast("long").alias("kept"), "dropped")


@query("src6_format", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'vtt' WHEN page_id % 4 = 1 THEN 'transcript_json' WHEN page_id % 4 = 2 THEN 'srt' END AS format FROM pages")
def src6(spark, d):
    source = F.expr("CASE page_id % 4 WHEN 0 THEN '  WEBVTT x' WHEN 1 THEN ' {}' ELSE '1' END")
    path = F.expr("CASE page_id % 4 WHEN 2 THEN '/a/B.SRT' ELSE '/a/b.txt' END")
    return D.table(spark, d, "pages").select("page_id", S.detect_format(source, path).alias("format"))


@query("src15_envelope", "SELECT event_id, 'said ' || event_type AS content, CASE WHEN event_id % 2 = 0 THEN 'stop' END AS finish_reason FROM events")
def src15(spark, d):
    reason = F.when(F.col("event_id") % 2 == 0, "stop")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("said "), "event_type").alias("content")).alias("message"), reason.alias("finish_reason"))).alias("choices")))
    bodies = D.table(spark, d, "events").select("event_id", body.alias("b"))
    return bodies.select("event_id", F.get_json_object("b", "$.choices[0].message.content").alias("content"), F.get_json_object("b", "$.choices[0].finish_reason").alias("finish_reason"))


@query("src16_event_stream", sql("""SELECT task_id AS key, string_agg(text, '' ORDER BY idx) FILTER (idx <= e) AS content, CASE WHEN task_id % 6 = 1 THEN 'stream_incomplete' ELSE 'stop' END AS finish_reason, count(*) FILTER (idx <= e)::BIGINT AS events
FROM (SELECT *, CASE WHEN task_id % 4 = 2 THEN max(idx) OVER w // 2 ELSE max(idx) OVER w END AS e FROM segments WINDOW w AS (PARTITION BY task_id)) GROUP BY task_id""".replace("task_id % 6 = 1", "task_id % 6 = 1 AND task_id % 4 <> 2")))
def src16(spark, d):
    """A cue is a delta. The last one ends the stream, in some tasks one in the middle, after which nothing is read; in some no end comes."""
    cues = D.segments(spark, d).withColumn("last", F.max("idx").over(D.W.partitionBy("task_id")))
    early = F.col("task_id") % 4 == 2
    stop = F.when(early & (F.col("idx") == F.expr("last div 2")) | ~early & (F.col("task_id") % 6 != 1) & (F.col("idx") == F.col("last")), "stop")
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("delta"), stop.alias("finish_reason"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))), F.lit("\n"))
    bodies = cues.groupBy(F.col("task_id").alias("key")).agg(S.ordered_text(line, F.col("idx")).alias("source"))
    return S.stream_content(bodies)


@query("src17_unfence", "SELECT * FROM (VALUES (0, '{\"a\": 1}'), (1, '{\"a\": 1}'), (2, 'x')) v(id, inner_text)")
def src17(spark, d):
    rows = spark.createDataFrame([(0, '```json\n{"a": 1}\n```'), (1, ' {"a": 1} '), (2, "x")], "id int, t string")
    return rows.select("id", S.unfence(F.col("t")).alias("inner_text"))


@query("src18_structured_answer", sql("SELECT task_id, idx, CASE WHEN idx % 3 <> 2 THEN text END AS corrected_text FROM segments"))
def src18(spark, d):
    unit = F.when(F.col("idx") % 3 == 2, F.to_json(F.struct(F.lit("u").alias("unit_id"), F.col("text").alias("corrected_text"), F.lit("r").alias("rationale"), F.lit(1).alias("more")))).otherwise(
        F.to_json(F.struct(F.lit("u").alias("unit_id"), F.col("text").alias("corrected_text"), F.lit("r").alias("rationale")))
    )
    body = F.concat(F.lit('{"corrected_units":['), unit, F.lit("]}"))
    return D.segments(spark, d).select("task_id", "idx", F.get(S.corrected_units(body), F.lit(0))["corrected_text"].alias("corrected_text"))


@query("snk8_formula_guard", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM part")
def snk8(spark, d):
    return D.table(spark, d, "part").select("p_partkey", S.guard_formula(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))).alias("cell"))


@query("prj9_content_ids", sql("SELECT task_id, idx, 'seg-' || left(sha256('0' || chr(10) || idx || chr(10) || start_ms || chr(10) || end_ms || chr(10) || text), 16) AS segment_id FROM segments"))
def prj9(spark, d):
    return D.segments(spark, d).select("task_id", "idx", S.cue_ids(F.lit("0"), F.col("idx"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("segment_id"))


@query("prj1_task_view", sql("""SELECT task_id, type AS status, CASE type WHEN 'error' THEN 'retry' WHEN 'purchase' THEN 'deliver' WHEN 'view' THEN 'wait' ELSE 'review' END AS next_action, type IN ('view', 'click') AS can_cancel
FROM task_events QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY sequence DESC) = 1"""))
def prj1(spark, d):
    last = D.task_events(spark, d).groupBy("task_id").agg(F.max_by("type", "sequence").alias("status"))
    action = F.when(F.col("status") == "error", "retry").when(F.col("status") == "purchase", "deliver").when(F.col("status") == "view", "wait").otherwise("review")
    return last.select("task_id", "status", action.alias("next_action"), F.col("status").isin("view", "click").alias("can_cancel"))


@query("prj2_result_view", sql("SELECT task_id, count(*) AS calls, CASE WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE min(type) END AS outcome FROM task_events GROUP BY task_id"))
def prj2(spark, d):
    return D.task_events(spark, d).groupBy("task_id").agg(F.count("*").alias("calls"), F.when(F.count_distinct("type") > 1, "mixed").otherwise(F.min("type")).alias("outcome"))


@query("prj4_event_view", sql("SELECT event_id, CASE WHEN type = 'error' THEN 'error' WHEN k > 50 THEN 'warning' ELSE 'info' END AS severity, 'stage-' || (k % 5) AS stage FROM task_events"))
def prj4(spark, d):
    severity = F.when(F.col("type") == "error", "error").when(F.col("k") > 50, "warning").otherwise("info")
    return D.task_events(spark, d).select("event_id", severity.alias("severity"), F.concat(F.lit("stage-"), (F.col("k") % 5).cast("string")).alias("stage"))


@query("prj7_uncorrected_cues", sql("SELECT task_id, printf('subtitle-%04d', idx + 1) AS subtitle_id, start_ms, end_ms, text, 'medium' AS confidence FROM segments"))
def prj7(spark, d):
    return D.segments(spark, d).select("task_id", F.format_string("subtitle-%04d", F.col("idx") + 1).alias("subtitle_id"), "start_ms", "end_ms", "text", F.lit("medium").alias("confidence"))


@query("prj8_applied_suggestions", sql("SELECT task_id, suggestion_id, suggested_text FROM suggestions WHERE confidence <> 'low'"))
def prj8(spark, d):
    return D.suggestions(spark, d).where("confidence <> 'low' and suggested_text is not null").select("task_id", "suggestion_id", "suggested_text")
