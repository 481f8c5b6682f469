"""Files, documents and records: readers and writers in round trips, projections, dictionaries and adapters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import visible as V
from cuelake.operators import adapters as X
from cuelake.operators import align as A
from cuelake.operators import packing as K
from cuelake.operators import process as P
from cuelake.operators import relational as R
from cuelake.operators import srt_checks as Q
from cuelake.plans import workload as D
from cuelake.plans.process_queries import _aligned, _matched
from cuelake.plans.registry import query
from cuelake.plans.source_queries import _SRT, STAMP
from cuelake.plans.text_queries import CELL, COUNT, MATCH, SECRET
from cuelake.plans.workload import sql
from cuelake.sources import mp3
from cuelake.sources import subtitles as S
from cuelake.sources.delivery import delivery_history, read_delivered, write_deliveries
from cuelake.sources.storage import fresh, put

KEY = ("task_id", "idx")


# --- files -----------------------------------------------------------------------------------------------


@query("src7_inspect", sql("SELECT task_id, count(*) AS cue_count, max(end_ms) AS duration_ms, 'srt' AS format, NULL::VARCHAR AS problem FROM segments GROUP BY task_id"))
def src7(spark, d):
    """SRC8 too. Every recording is written to a file of its own, and all are read whole."""
    path = fresh(spark, "src7")
    S.write_srt(D.segments(spark, d)).select("key", F.col("source").alias("value")).write.partitionBy("key").text(path)
    files = S.read_files(spark, f"{path}/key=*/*").withColumn("task_id", F.regexp_extract("key", "key=([0-9]+)", 1).cast("long")).withColumn("key", F.concat("key", F.lit(".srt")))
    found = S.inspect(files, S.parse_srt(files.select("key", "source")))
    return found.join(files.select("key", "task_id"), "key").select("task_id", "cue_count", "duration_ms", "format", "problem")


def _frames(n: int, padding: int = 0) -> bytes:
    return b"".join(bytes([0xFF, 0xFB, 0x90 | 0, 0x64]) + bytes(413) for _ in range(n)) + b"TAG" * padding


def _audio(spark):
    """Audio files of each kind, read with the binaryFile source; `path` is the name."""
    folder = fresh(spark, "audio")
    kinds = {"two": _frames(2), "many": _frames(50), "tagged": b"ID3" + bytes([3, 0, 0, 0, 0, 0, 10]) + bytes(10) + _frames(3, 1), "noise": b"not audio at all"}
    for name, data in kinds.items():
        put(spark, f"{folder}/{name}.mp3", data)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp3").load(folder)
    return files.select(F.regexp_extract("path", "([a-z]+)[.]mp3$", 1).alias("path"), "content")


@query("src8_decoded_texts", sql("SELECT task_id, idx, CASE WHEN idx % 7 <> 4 THEN text || chr(10) || text || chr(10) || chr(10) || CASE WHEN idx % 7 = 5 THEN chr(65279) ELSE '' END END AS source FROM segments"))
def src8(spark, d):
    """Bytes with a byte-order mark at their start or end, with line ends of three kinds, and with a byte that is no UTF-8."""
    mark, k = F.unhex(F.lit("EFBBBF")), F.col("idx") % 7
    body = F.concat("text", F.when(k % 2 == 0, "\r\n").otherwise("\r"), "text", F.lit("\n\r"))
    raw = F.concat(F.when(k == 3, mark).otherwise(F.unhex(F.lit(""))), F.encode(body, "UTF-8"), F.when(k == 4, F.unhex(F.lit("FF"))).when(k == 5, mark).otherwise(F.unhex(F.lit(""))))
    return D.segments(spark, d).select(*KEY, S.decode(raw).alias("source"))


@query("src10_mp3_durations", "SELECT * FROM (VALUES ('two', TRUE, 52::BIGINT), ('many', TRUE, 1306::BIGINT), ('tagged', TRUE, 78::BIGINT), ('noise', FALSE, NULL)) v(path, mp3, duration_ms)")
def src10(spark, d):
    """SRC11 too."""
    return mp3.durations(_audio(spark))


@query("src12_frame_table", "SELECT 'many' AS path, 50::BIGINT AS frames, 20850::BIGINT AS bytes UNION ALL SELECT 'two', 2, 834 UNION ALL SELECT 'tagged', 3, 1271")
def src12(spark, d):
    """AG19 too: a row a frame, summed up."""
    return mp3.frame_table(_audio(spark)).groupBy("path").agg(F.count("*").alias("frames"), F.max("end").alias("bytes"))


def _recognized(spark, d):
    """A recognizer's answers: the second word of some cues starts too early, and each cue has a blank word without times."""
    spoken = D.words(spark, d).withColumn("start_ms", F.when((F.col("word") == 1) & ((F.col("task_id") + F.col("idx")) % 5 == 0), F.col("start_ms") - 10_000).otherwise(F.col("start_ms")))
    word = F.struct("word", "text", F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"))
    blank = F.struct(F.lit(999).cast("long").alias("word"), F.lit(" ").alias("text"), F.lit(-1).cast("long").alias("start_time"), F.lit(-1).cast("long").alias("end_time"))
    lists = spoken.groupBy("task_id", "idx").agg(F.array_append(F.array_sort(F.collect_list(word)), blank).alias("words"))
    cues = D.segments(spark, d).join(lists, list(KEY)).select("task_id", F.struct("idx", "text", F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), "words").alias("u"))
    return cues.groupBy(F.col("task_id").alias("key")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("u")).alias("utterances"))).alias("source"))


_BAD = "w.word = 1 AND (w.task_id + w.idx) % 5 = 0"


@query("src13_strict_answer", sql(f"SELECT w.task_id AS key, printf('asr-segment-%04d', w.idx + 1) AS segment_id, count(*) FILTER (NOT ({_BAD}))::INT AS words, max(max(CASE WHEN {_BAD} THEN 'bad_word' END)) OVER (PARTITION BY w.task_id) AS problem FROM words w GROUP BY w.task_id, w.idx"))
def src13(spark, d):
    """One bad word is the whole answer's problem."""
    return S.import_recognized(_recognized(spark, d)).select("key", "segment_id", F.size("words").alias("words"), "problem")


@query("src14_lenient_answer", sql(f"SELECT w.task_id AS key, printf('asr-segment-%04d', w.idx + 1) AS segment_id, count(*) FILTER (NOT ({_BAD}))::INT AS words, count(*) FILTER ({_BAD})::INT AS dropped FROM words w GROUP BY w.task_id, w.idx"))
def src14(spark, d):
    """Bad words are dropped and counted."""
    return S.import_recognized(_recognized(spark, d), lenient=True).select("key", "segment_id", F.size("words").alias("words"), "dropped")


def _dictionary(spark, d):
    part = D.table(spark, d, "part")
    return part.select(
        F.concat(F.lit("entry-"), F.col("p_partkey").cast("string")).alias("entry_id"), F.concat(F.when(F.col("p_partkey") % 9 == 0, "=").otherwise(""), F.col("p_name")).alias("canonical"),
        F.array(F.lower("p_brand"), F.concat(F.lit('a "quoted", '), F.col("p_type"))).alias("variants"), F.lit("term").alias("kind"), F.lit("en").alias("language"), (F.col("p_size") % 2 == 0).alias("case_sensitive"),
        F.lit(False).alias("number_sensitive"), F.lit(None).cast("string").alias("notes"), F.array(F.lit("x")).alias("tags"), (F.col("p_partkey") % 4 != 0).alias("enabled"),
    )


@query("src19_dictionary_csv", """SELECT 'entry-' || p_partkey AS entry_id, CASE WHEN p_partkey % 9 = 0 THEN '''=' ELSE '' END || p_name AS canonical, ['x'] AS tags, [lower(p_brand), 'a "quoted", ' || p_type] AS variants, p_size % 2 = 0 AS case_sensitive, p_partkey % 4 <> 0 AS enabled FROM part""")
def src19(spark, d):
    """SNK8 and SNK9 too: written as CSV with guarded formulas, and read back."""
    path = fresh(spark, "src19")
    S.write_dictionary_csv(_dictionary(spark, d), path)
    return S.read_dictionary_csv(spark, path).select("entry_id", "canonical", "tags", "variants", "case_sensitive", "enabled")


@query("snk9_never_overwritten", """SELECT 'entry-' || p_partkey AS entry_id, p_name AS canonical, format, TRUE AS refused FROM part, (VALUES ('csv'), ('json')) v(format)""")
def snk9(spark, d):
    """Dictionaries exported as CSV and as JSON; a second export to the same place is refused, and the first stays as it was."""
    entries = D.table(spark, d, "part").select(F.concat(F.lit("entry-"), F.col("p_partkey").cast("string")).alias("entry_id"), F.col("p_name").alias("canonical"))
    exports = {"csv": S.write_dictionary_csv, "json": lambda df, path: df.write.mode("errorifexists").json(path)}
    out = []
    for name, export in exports.items():
        path = fresh(spark, f"snk9-{name}")
        export(entries, path)
        try:
            export(entries.withColumn("canonical", F.lit("other")), path)
            refused = False
        except AnalysisException:
            refused = True
        kept = spark.read.schema("entry_id string, canonical string").option("header", True).format(name).load(path)
        out.append(kept.withColumns({"format": F.lit(name), "refused": F.lit(refused)}))
    return out[0].unionByName(out[1])


@query("src20_dictionary_json", "SELECT 'entry-' || p_partkey AS entry_id, [lower(p_brand), 'a \"quoted\", ' || p_type] AS variants FROM part")
def src20(spark, d):
    path = fresh(spark, "src20")
    _dictionary(spark, d).write.mode("errorifexists").json(path)
    return spark.read.schema("entry_id string, variants array<string>").json(path)


@query("src24_isolated_records", "SELECT 'good' AS kind, count(*) AS n FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 10 = 3")
def src24(spark, d):
    """SRC23 too: a record that doesn't parse stops no other one."""
    raw = D.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit("{torn")).otherwise(F.col("props")).alias("raw"))
    good, bad = S.split_valid(raw, "raw", "k bigint", "k")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(good, "good").unionByName(count(bad, "bad"))


@query("src25_json_budget", "SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'not_json' WHEN event_id % 10 = 4 THEN 'depth' END AS problem FROM events")
def src25(spark, d):
    deep = "[" * 25 + "]" * 25
    raw = F.when(F.col("event_id") % 10 == 3, "{torn").when(F.col("event_id") % 10 == 4, deep).otherwise(F.col("props"))
    return D.table(spark, d, "events").select("event_id", V.over_budget(raw).alias("problem"))


@query("snk1_validated_srt", sql(f"SELECT task_id AS key, {_SRT} AS source FROM segments GROUP BY task_id"))
def snk1(spark, d):
    """Wrapped at 18 characters (none of these cues has more, as a Latin word counts as one); one newline at the end."""
    wrapped = D.segments(spark, d).withColumn("text", F.array_join(V.wrapped(F.col("text")), "\n"))
    return S.write_srt(wrapped, final_blank=False)


@query("snk4_report", sql(f"""SELECT task_id, '# Report' || chr(10) || chr(10) || '- task: ' || task_id || chr(10) || '- cues: ' || count(*) || chr(10) || '- warnings: ' || count(*) FILTER (warned) || chr(10) || chr(10) || '| cue | time | text |' || chr(10) || '|---|---|---|' || chr(10)
|| string_agg('| ' || (idx + 1) || ' | ' || {STAMP.format('start_ms')} || ' | ' || {CELL.format('text')} || ' |', chr(10) ORDER BY idx) || chr(10) AS report
FROM (SELECT task_id, idx, start_ms, {SECRET.format('text', '(task_id + idx)')} AS text, length(text) > 18 AS warned FROM segments) GROUP BY task_id"""))
def snk4(spark, d):
    """A task's cues as Markdown: sections from aggregates, cells escaped and redacted."""
    shown = D.segments(spark, d).withColumn("warned", F.length("text") > 18).withColumn("text", F.expr(SECRET.format("text", "(task_id + idx)")))
    row = F.concat(F.lit("| "), (F.col("idx") + 1).cast("string"), F.lit(" | "), T.srt_time(F.col("start_ms")), F.lit(" | "), T.report_cell(F.col("text")), F.lit(" |"))
    parts = shown.groupBy("task_id").agg(F.count("*").alias("cues"), F.count_if("warned").alias("warned"), R.ordered_text(row, F.col("idx")).alias("rows"))
    return parts.select("task_id", F.concat(F.lit("# Report\n\n- task: "), F.col("task_id").cast("string"), F.lit("\n- cues: "), F.col("cues").cast("string"), F.lit("\n- warnings: "), F.col("warned").cast("string"), F.lit("\n\n| cue | time | text |\n|---|---|---|\n"), F.col("rows"), F.lit("\n")).alias("report"))


@query("snk5_canonical_json", "SELECT event_id, sha256('{' || chr(10) || '  \"a\": ' || event_id || ',' || chr(10) || '  \"k\": ' || (props ->> '$.k') || chr(10) || '}' || chr(10)) AS sha256 FROM events")
def snk5(spark, d):
    raw = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"a":'), F.col("event_id").cast("string"), F.lit("}"))
    return D.table(spark, d, "events").select("event_id", F.sha2(V.canonical(raw), 256).alias("sha256"))


_APPROVED = "SELECT 'talk.' || o_custkey || '.approved.' || left(sha256(o_orderpriority), 12) || '.srt' AS name, sha256(o_orderpriority || CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE '' END) AS sha256, o_orderkey FROM orders"


@query("snk10_delivery", f"""WITH a AS ({_APPROVED}), h AS (SELECT name, min(sha256(p)) AS sha256 FROM (SELECT 'talk.' || o_custkey || '.approved.' || left(sha256(o_orderpriority), 12) || '.srt' AS name, o_orderpriority AS p FROM orders WHERE o_custkey % 3 = 0) GROUP BY name)
SELECT a.name, a.sha256, CASE WHEN h.name IS NULL THEN 'delivered' WHEN h.sha256 = a.sha256 THEN 'unchanged' ELSE 'conflict' END AS outcome FROM a LEFT JOIN h USING (name)""")
def snk10(spark, d):
    orders = D.table(spark, d, "orders")
    name = P.delivery_name(F.lit("talk"), F.col("o_custkey"), F.sha2("o_orderpriority", 256))
    approved = orders.select(name.alias("name"), F.sha2(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise("")), 256).alias("sha256"))
    history = orders.where("o_custkey % 3 = 0").groupBy(name.alias("name")).agg(F.min(F.sha2("o_orderpriority", 256)).alias("sha256"))
    return P.deliver(approved, history)


_TASK_SRT = f"SELECT task_id, {_SRT} || chr(10) AS content FROM segments GROUP BY task_id"


@query("snk10_delivered_files", sql(f"""SELECT 'talk.' || task_id || '.approved.' || left(sha256(content), 12) || '.srt' AS name, sha256(content) AS sha256, strlen(content) AS bytes, conflict,
  CASE WHEN NOT conflict THEN sha256(content) END AS file_sha256
FROM (SELECT task_id, content, FALSE AS conflict FROM ({_TASK_SRT}))
UNION ALL SELECT 'talk.' || task_id || '.approved.' || left(sha256(content), 12) || '.srt', sha256(content || 'x'), strlen(content) + 1, TRUE, NULL FROM ({_TASK_SRT}) WHERE task_id % 5 = 0"""))
def snk10_files(spark, d):
    """Each task's approved subtitles are delivered, delivered again, and some with other bytes; then the history and the files are read."""
    path = fresh(spark, "delivered")
    kept = fresh(spark, "approved")
    files = S.write_srt(D.segments(spark, d)).select("key", F.col("source").alias("content"))
    files.select("key", P.delivery_name(F.lit("talk"), F.col("key"), F.sha2("content", 256)).alias("name"), "content").write.parquet(kept)
    approved = spark.read.parquet(kept)
    write_deliveries(approved, path)
    write_deliveries(approved.repartition(5), path)
    write_deliveries(approved.where("key % 5 = 0").withColumn("content", F.concat("content", F.lit("x"))), path)
    back = read_delivered(spark, path).select("name", F.sha2("content", 256).alias("file_sha256"), F.lit(False).alias("conflict"))
    return delivery_history(spark, path).join(back, ["name", "conflict"], "left")


@query("snk11_snapshot_files", """SELECT p_size AS dictionary_id, sha256(content) AS sha256, content FROM (
  SELECT p_size, '[' || string_agg(DISTINCT '"' || p_type || '"', ',' ORDER BY '"' || p_type || '"') || ']' AS content FROM part GROUP BY p_size
  UNION SELECT p_size, '[' || string_agg(DISTINCT '"' || p_type || '"', ',' ORDER BY '"' || p_type || '"') || ']' FROM part WHERE p_partkey % 3 > 0 GROUP BY p_size)""")
def snk11_files(spark, d):
    """Two versions of each dictionary, kept under the hash of their content; one that didn't change is kept once."""
    path = fresh(spark, "snapshots")
    for kept in ("true", "p_partkey % 3 > 0"):
        content = F.to_json(F.array_sort(F.collect_set("p_type"))).alias("content")
        versions = D.table(spark, d, "part").where(kept).groupBy("p_size").agg(content)
        write_deliveries(versions.withColumn("name", F.concat_ws("/", "p_size", F.concat(F.sha2("content", 256), F.lit(".json")))), path)
    read = read_delivered(spark, path).withColumn("content", F.col("content").cast("string"))
    return read.select(F.split_part("name", F.lit("/"), F.lit(1)).cast("int").alias("dictionary_id"), F.sha2("content", 256).alias("sha256"), "content")


@query("snk11_new_versions", "SELECT DISTINCT o_custkey AS dictionary_id, sha256(o_orderpriority) AS sha256 FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 4 = 0)")
def snk11(spark, d):
    rows = D.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("dictionary_id"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return P.new_versions(rows.drop("o_orderkey"), rows.where("o_orderkey % 4 = 0"), "dictionary_id", "sha256")


@query("snk12_result_documents", sql("SELECT task_id, '{\"cues\":' || count(*) || ',\"duration_ms\":' || max(end_ms) || ',\"task_id\":' || task_id || '}' AS document FROM segments GROUP BY task_id"))
def snk12(spark, d):
    """Keys in sorted order."""
    totals = D.segments(spark, d).groupBy("task_id").agg(F.count("*").alias("cues"), F.max("end_ms").alias("duration_ms"))
    return totals.select("task_id", F.to_json(F.struct("cues", "duration_ms", "task_id")).alias("document"))


# --- projections, texts and numbers ----------------------------------------------------------------------


@query("prj3_old_view", sql("SELECT task_id, type AS status, 'v1' AS contract, coalesce(nullif(k, 50), 0) AS revision FROM task_events WHERE sequence = 1"))
def prj3(spark, d):
    """PRJ10 and PRJ11 are the same kind: a projection with defaults for what older records lack."""
    return D.task_events(spark, d).where("sequence = 1").select("task_id", F.col("type").alias("status"), F.lit("v1").alias("contract"), F.coalesce(F.nullif("k", F.lit(50)), F.lit(0)).alias("revision"))


@query("prj5_exchange_ids", sql("SELECT task_id, 'trn-' || left(sha256(string_agg(text, chr(10) ORDER BY idx)), 24) AS transcript_id, count(*) AS cues FROM segments GROUP BY task_id"))
def prj5(spark, d):
    joined = D.segments(spark, d).groupBy("task_id").agg(R.ordered_text(F.col("text"), F.col("idx")).alias("t"), F.count("*").alias("cues"))
    return joined.select("task_id", F.concat(F.lit("trn-"), F.substring(F.sha2("t", 256), 1, 24)).alias("transcript_id"), "cues")


@query("prj6_word_ids", sql("SELECT task_id, idx, list(printf('word-%04d-%04d', idx + 1, word + 1) ORDER BY word) AS word_ids FROM words GROUP BY task_id, idx"))
def prj6(spark, d):
    lists = D.words(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_list("word")).alias("w"))
    return lists.select(*KEY, F.transform("w", lambda w: F.format_string("word-%04d-%04d", F.col("idx") + 1, w + 1)).alias("word_ids"))


@query("str10_inline_text")
def str10(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", V.inline_text(F.col("text")).alias("text"))


@query("str19_redacted_json", "SELECT event_id, '{\"apiKey\":\"[REDACTED]\",\"n\":[{\"password\":\"[REDACTED]\",\"k\":' || (props ->> '$.k') || '}]}' AS body FROM events")
def str19(spark, d):
    raw = F.concat(F.lit('{"apiKey": "x", "n": [{"password": 1, "k": '), F.get_json_object("props", "$.k"), F.lit("}]}"))
    return D.table(spark, d, "events").select("event_id", V.redacted(raw).alias("body"))


@query("num8_percent", "SELECT p_partkey, printf('%.1f%%', p_size / 50.0 * 100) AS share FROM part")
def num8(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.percent(F.col("p_size") / 50.0).alias("share"))


@query("flt4_eligible", sql("SELECT task_id, suggestion_id FROM suggestions WHERE kind = 'text_correction' AND confidence <> 'low' AND original_text <> '' AND segment_ref <> 'seg-9999'"))
def flt4(spark, d):
    return D.suggestions(spark, d).where("kind = 'text_correction' AND confidence <> 'low' AND original_text <> '' AND segment_ref <> 'seg-9999'").select("task_id", "suggestion_id")


@query("flt6_selected_dictionaries", sql("SELECT DISTINCT dictionary_id, CASE WHEN scope = 'project' AND explicit THEN 2 WHEN scope = 'project' THEN 3 WHEN explicit THEN 4 ELSE 5 END AS priority FROM entries WHERE enabled AND (explicit OR is_default)"))
def flt6(spark, d):
    used = D.entries(spark, d).where("enabled").select("dictionary_id", R.dictionary_priority(F.col("scope"), F.col("explicit"), F.col("is_default")).alias("priority"))
    return used.where("priority is not null").distinct()


@query("flt7_ready_models", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 23 <> 0")
def flt7(spark, d):
    from cuelake.plans import contracts as C

    return C.frames(spark, d)("models").where("enabled AND check_status = 'passed' AND confirmed").select(F.col("pos").alias("s_suppkey"))


@query("flt14_review_items", sql("SELECT task_id, suggestion_id FROM suggestions WHERE confidence <> 'high' OR idx % 4 = 0"))
def flt14(spark, d):
    return D.suggestions(spark, d).where("confidence <> 'high' OR idx % 4 = 0").select("task_id", "suggestion_id")


# --- alignment and evidence ------------------------------------------------------------------------------


@query("wn7_audio_only_relations", sql(f"SELECT task_id, segment_id AS ref, (sum(n) OVER (PARTITION BY task_id ORDER BY idx) - n)::BIGINT AS asr_start, (sum(n) OVER (PARTITION BY task_id ORDER BY idx))::BIGINT AS asr_end, start_ms, end_ms FROM (SELECT *, len({MATCH.format('text')}) AS n FROM segments)"))
def wn7_audio(spark, d):
    return A.audio_only(D.segments(spark, d), "segment_id")


@query("ag14_owned_text", sql(f"SELECT task_id, segment_id AS ref, {MATCH.format('text')} AS text FROM segments WHERE {MATCH.format('text')} <> ''"))
def ag14(spark, d):
    """Cut into characters and put together again by their cue."""
    rows = A.character_rows(D.segments(spark, d), "segment_id")
    return rows.groupBy("task_id", "ref").agg(R.ordered_text(F.col("ch"), F.col("at"), "").alias("text"))


@query("jn7_word_evidence", sql(f"SELECT task_id, segment_id AS ref, start_ms, end_ms, count(*) AS characters FROM (SELECT w.task_id, w.segment_id, w.start_ms, w.end_ms, unnest(range(len({MATCH.format('w.text')}))) AS i FROM words w) GROUP BY ALL"))
def jn7(spark, d):
    """Each character has the times of its word."""
    cues, spoken = D.segments(spark, d), D.words(spark, d)
    timed = A.time_evidence(cues, spoken, "segment_id")
    return timed.groupBy("task_id", "ref", "start_ms", "end_ms").agg(F.count("*").alias("characters"))


@query("jn6_matched_pairs", sql(f"SELECT task_id, sum(len({MATCH.format('text')})) FILTER ((task_id + idx) % 5 <> 3)::BIGINT AS pairs FROM segments GROUP BY task_id HAVING sum(len({MATCH.format('text')})) FILTER ((task_id + idx) % 5 <> 3) > 0"))
def jn6(spark, d):
    return _aligned(spark, d)[0].groupBy("task_id").agg(F.count("*").alias("pairs"))


@query("ag12_timed_units")
def ag12(spark, d):
    """JN7's times carried over to a reference."""
    cues = D.segments(spark, d)
    asr = A.time_evidence(cues, D.words(spark, d), "segment_id")
    kept = D.segments(spark, d).where("(task_id + idx) % 5 <> 3").withColumn("reference_id", F.format_string("reference-%04d", F.col("idx") + 1))
    reference = A.character_rows(kept, "reference_id")
    return A.timed_units(A.align(A.placed(cues, "segment_id"), A.placed(kept, "reference_id")), asr, reference)


#: Relations of a transcript with itself, of which some begin `BACK` characters early on the reference's side.
_OFF = "(task_id + idx) % 29 = 4"
_SELF = f"""r AS (SELECT *, asr_start - CASE WHEN {_OFF} THEN 3 ELSE 0 END AS reference_start, asr_end - CASE WHEN {_OFF} THEN 3 ELSE 0 END AS reference_end
FROM (SELECT task_id, idx, m, (sum(n) OVER w - n)::BIGINT AS asr_start, (sum(n) OVER w)::BIGINT AS asr_end FROM (SELECT *, len(m) AS n FROM (SELECT *, {MATCH.format('text')} AS m FROM segments)) WINDOW w AS (PARTITION BY task_id ORDER BY idx)) WHERE asr_end > asr_start)"""


def _with_itself(spark, d):
    """(relations, placed side)."""
    cues = D.segments(spark, d)
    own = A.audio_only(cues, "idx").where("asr_end > asr_start").withColumnRenamed("ref", "idx")
    off = F.when(F.expr(_OFF), 3).otherwise(0)
    return own.select("task_id", "asr_start", "asr_end", (F.col("asr_start") - off).alias("reference_start"), (F.col("asr_end") - off).alias("reference_end")), A.placed(cues, "segment_id")


@query("wn13_monotone_relations", sql(f", {_SELF} SELECT task_id, asr_start FROM (SELECT *, lag(asr_end) OVER w AS a, lag(reference_end) OVER w AS b FROM r WINDOW w AS (PARTITION BY task_id ORDER BY asr_start)) WHERE asr_start < a OR reference_start < b").replace(") \n,", ")\n,"))
def wn13(spark, d):
    """Relations that go back on either side, beside those of an alignment, which never do."""
    return A.going_back(_with_itself(spark, d)[0]).unionByName(A.going_back(A.relations(*_matched(spark, d))))


@query("val9_alignment_recomputed", sql(f", {_SELF}, whole AS (SELECT task_id, string_agg(m, '' ORDER BY idx) AS t FROM r GROUP BY task_id) SELECT task_id, asr_start FROM r JOIN whole USING (task_id) WHERE reference_start < 0 OR substring(t, asr_start + 1, asr_end - asr_start) <> substring(t, reference_start + 1, asr_end - asr_start)").replace(") \n,", ")\n,"))
def val9(spark, d):
    """Relations whose characters differ, when looked up again, beside those of an alignment, which has none."""
    runs, asr, reference = _matched(spark, d)
    own, side = _with_itself(spark, d)
    return A.differing(own, side, side).unionByName(A.differing(A.relations(runs, asr, reference), asr, reference))


@query("wn15_replace_unique", sql("""SELECT task_id, idx, CASE WHEN (length(t) - length(replace(t, w, ''))) // greatest(length(w), 1) = 1 THEN replace(t, w, w || 'x') END AS replaced
FROM (SELECT task_id, idx, split_part(text, ' ', 1) AS w, text || lead(text, 1, '') OVER (PARTITION BY task_id ORDER BY idx) AS t FROM segments) WHERE w <> ''"""))
def wn15(spark, d):
    """A finding's text in two joined cues, replaced where it occurs once."""
    pair = D.segments(spark, d).select(*KEY, F.substring_index("text", " ", 1).alias("w"), F.array("text", F.lead("text", 1, "").over(D.in_task())).alias("texts")).where("w <> ''")
    return pair.select(*KEY, F.array_join(V.replaced_across(F.col("texts"), F.col("w"), F.concat("w", F.lit("x"))), "").alias("replaced"))


_PACKED = f"""WITH RECURSIVE {D.SQL}, sized AS (
  SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY idx, word) - 1 AS n, count(*) OVER (PARTITION BY task_id) AS frames, 400 + 10 * length(text) AS bytes FROM words
), ends AS (SELECT task_id, max(end_ms) AS file_ms FROM segments GROUP BY task_id), cuts AS (
  SELECT task_id, n, n = frames - 1 AS final, sum(bytes) OVER (PARTITION BY task_id ORDER BY n) AS place,
         CASE WHEN n = frames - 1 THEN file_ms ELSE least(file_ms, floor((26 * (n + 1))::DOUBLE * (file_ms::DOUBLE / (26 * frames)::DOUBLE) + 0.5::DOUBLE)::BIGINT) END AS ms
  FROM sized JOIN ends USING (task_id) UNION ALL SELECT task_id, -1, FALSE, 0, 0 FROM ends
), fits AS (
  SELECT task_id, n, place, final, last(n) OVER w AS fit, last(ms) OVER w AS fit_ms
  FROM cuts WINDOW w AS (PARTITION BY task_id ORDER BY place RANGE BETWEEN CURRENT ROW AND 6000 FOLLOWING)
), heard AS (
  SELECT f.*, c.end_ms AS cue FROM fits f ASOF LEFT JOIN (SELECT DISTINCT task_id, end_ms FROM segments) c ON f.task_id = c.task_id AND f.fit_ms >= c.end_ms
), near AS (
  SELECT task_id, end_ms AS cue, min_by(n, abs(ms - end_ms) * 1000000000 + n) AS cue_n FROM cuts JOIN (SELECT DISTINCT task_id, end_ms FROM segments) USING (task_id) WHERE n >= 0 GROUP BY ALL
), ways AS (SELECT h.*, greatest(cue_n, n + 1) AS cue_n, file_ms FROM heard h LEFT JOIN near USING (task_id, cue) JOIN ends USING (task_id)), walk AS (
  SELECT task_id, 0 AS chunk, -1::BIGINT AS n, 0::BIGINT AS start_ms FROM ends
  UNION ALL
  SELECT k.task_id, chunk + 1, CASE WHEN cue > start_ms THEN cue_n ELSE fit END, CASE WHEN cue > start_ms THEN cue ELSE fit_ms END
  FROM walk k JOIN ways w ON k.task_id = w.task_id AND k.n = w.n WHERE NOT final
)
SELECT task_id, chunk, place AS start, lead(place) OVER t AS "end", start_ms, CASE WHEN lead(final) OVER t THEN file_ms ELSE lead(start_ms) OVER t END AS end_ms
FROM walk JOIN ways USING (task_id, n) WINDOW t AS (PARTITION BY task_id ORDER BY chunk) QUALIFY "end" IS NOT NULL"""


@query("wn12_packed_chunks", _PACKED)
def wn12(spark, d):
    """A task's words as frames of an audio file, packed into chunks that end with cues."""
    spoken = D.words(spark, d).select("task_id", (F.row_number().over(W.partitionBy("task_id").orderBy("idx", "word")) - 1).alias("n"), (400 + F.length("text") * 10).alias("bytes"), F.lit(26.0).alias("length_ms"))
    cues = D.segments(spark, d).select("task_id", "end_ms")
    files = spoken.groupBy("task_id").agg(F.sum("bytes").alias("file_bytes")).join(cues.groupBy("task_id").agg(F.max("end_ms").alias("file_ms")), "task_id")
    return K.packed(K.cuts(spoken, files), cues, 6_000, 8_000).where("problem IS NULL").drop("problem")


# --- aggregates, orders and the correction run -----------------------------------------------------------


@query("ag5_first_seen", sql("SELECT task_id, list(w ORDER BY first_at) AS words FROM (SELECT task_id, split_part(text, ' ', 1) AS w, min(idx) AS first_at FROM segments GROUP BY ALL) GROUP BY task_id"))
def ag5(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substring_index("text", " ", 1).alias("w")))), lambda x: x["w"])
    return D.segments(spark, d).groupBy("task_id").agg(F.array_distinct(ordered).alias("words"))


@query("ag20_mark_totals")
def ag20(spark, d):
    marked = D.segments(spark, d).select("task_id", V.visible(F.col("text")).alias("v"))
    return marked.groupBy("task_id").agg(F.sum("v.removed").alias("removed"), F.sum("v.kept").alias("kept"))


@query("tk5_finding_order", sql("SELECT task_id, finding_id, row_number() OVER (PARTITION BY task_id ORDER BY start_ms, end_ms, finding_id) AS nth FROM findings"))
def tk5(spark, d):
    from pyspark.sql import Window as W

    return D.findings(spark, d).select("task_id", "finding_id", F.row_number().over(W.partitionBy("task_id").orderBy("start_ms", "end_ms", "finding_id")).cast("long").alias("nth"))


@query("tk8_entry_order", sql("SELECT dictionary_id, list(DISTINCT entry_id ORDER BY entry_id) AS entry_ids FROM entries GROUP BY dictionary_id"))
def tk8(spark, d):
    return D.entries(spark, d).groupBy("dictionary_id").agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"))


@query("jn26_unique_lookup", "SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS lookup FROM orders GROUP BY o_custkey")
def jn26(spark, d):
    return D.table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.count("*") == 1, "found").otherwise("ambiguous").alias("lookup"))


#: A cue's words without marks and digits.
_PLAIN = "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^\\p{L} ]', '', 'g'), ' +', ' ', 'g')), ''), 'x')"


def _plain(spark, d):
    words = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L} ]", ""), " +", " "))
    return D.segments(spark, d).withColumn("text", F.coalesce(F.nullif(words, F.lit("")), F.lit("x")))


def _expected(cues):
    """Cues as expected of a file; some times are off by one, and the reference lacks a cue of some tasks."""
    off, lacks = (F.col("task_id") + F.col("idx")) % 23 == 0, (F.col("task_id") % 6 == 5) & (F.col("idx") == 0)
    return cues.select(
        F.col("task_id").alias("key"), "idx", (F.col("start_ms") + off.cast("int")).alias("start_ms"), "end_ms", "text",
        F.when(~lacks, F.col("start_ms")).alias("reference_start"), F.when(~lacks, F.col("end_ms")).alias("reference_end"),
    )


_CHECKED = f"""WITH {D.SQL}, plain AS (SELECT * REPLACE ({_PLAIN} AS text) FROM segments),
c AS (SELECT *, {COUNT.format('text')} AS n, end_ms - start_ms AS ms FROM plain), tasks AS (SELECT task_id, count(*) AS cues, max(end_ms) AS whole FROM c GROUP BY task_id),
hit AS (
  SELECT task_id, 'SRT_HARD_CHARACTER_LIMIT' AS "check", 'failed' AS status FROM c WHERE n > 24
  UNION ALL SELECT task_id, 'SRT_LINE_LENGTH', 'warning' FROM c WHERE n > 18
  UNION ALL SELECT task_id, 'SRT_DURATION', 'warning' FROM c WHERE ms < 800 OR ms > 6000
  UNION ALL SELECT task_id, 'SRT_READING_SPEED', 'warning' FROM c WHERE n * 1000 > 12 * ms
  UNION ALL SELECT task_id, 'SRT_CALIBRATED_MAPPING', 'failed' FROM c WHERE (task_id + idx) % 23 = 0
  UNION ALL SELECT c.task_id, 'SRT_TIMELINE', 'failed' FROM c JOIN tasks USING (task_id) WHERE task_id % 7 = 0 AND end_ms > whole - 1
  UNION ALL SELECT task_id, 'SRT_UTF8', 'failed' FROM tasks WHERE task_id % 10 = 1
  UNION ALL SELECT task_id, 'SRT_FINAL_NEWLINE', 'failed' FROM tasks WHERE task_id % 10 = 2
  UNION ALL SELECT task_id, 'SRT_NEWLINES', 'failed' FROM tasks WHERE task_id % 10 = 3
  UNION ALL SELECT task_id, 'SRT_TEXT_ONLY_TIMELINE', 'failed' FROM tasks WHERE task_id % 6 = 5
), found AS (SELECT task_id, "check", min(status) AS status, count(*) AS n FROM hit GROUP BY ALL)
SELECT task_id AS key, "check", status, n FROM found
UNION ALL SELECT task_id, p, 'passed', 0 FROM tasks, (SELECT unnest(['SRT_UTF8', 'SRT_SEQUENCE', 'SRT_TIME_FORMAT', 'SRT_TEXT', 'SRT_VISIBLE_SUBTITLE_STYLE', 'SRT_TIMELINE', 'SRT_LINE_COUNT', 'SRT_LINE_LENGTH', 'SRT_CALIBRATED_MAPPING', 'SRT_TEXT_ONLY_TIMELINE']) AS p) WHERE (task_id, p) NOT IN (SELECT task_id, "check" FROM found)"""


@query("val8_srt_checks", _CHECKED)
def val8(spark, d):
    """All checks of files with a byte-order mark, without a final newline, with mixed newlines and with times off. The
    cues are plain words, as in files whose style has been checked before. A mark before the first number makes that
    block's number wrong, so these files' mark is told apart from their text."""
    cues = _plain(spark, d)
    ends = cues.groupBy(F.col("task_id").alias("key")).agg(F.max("end_ms").alias("whole"))
    files = S.write_srt(cues, final_blank=False).join(ends, "key")
    source = (
        F.when(F.col("key") % 10 == 2, F.regexp_replace("source", "\n$", ""))
        .when(F.col("key") % 10 == 3, F.concat(F.replace("source", F.lit("\n"), F.lit("\r\n")), F.lit("")))
        .otherwise(F.col("source"))
    )
    source = F.when(F.col("key") % 10 == 3, F.regexp_replace(source, "^1\r\n", "1\n")).otherwise(source)
    given = files.select("key", source.alias("source"), (F.col("key") % 10 == 1).alias("bom"), (F.col("whole") - (F.col("key") % 7 == 0).cast("int")).alias("duration_ms"))
    return Q.validate(given, _expected(cues))


@query("val8_marked_srt_checks")
def val8_marked(spark, d):
    """The checks of files whose cues are whole: with their digits, sentence marks, links and quantities. Of every other task the file shows what
    is left without marks, as it should."""
    shown = F.when(F.col("task_id") % 2 == 0, V.visible(F.col("text"))["text"]).otherwise(F.col("text"))
    cues = D.segments(spark, d).withColumn("text", F.coalesce(F.nullif(shown, F.lit("")), F.lit("x")))
    ends = cues.groupBy(F.col("task_id").alias("key")).agg(F.max("end_ms").alias("duration_ms"))
    files = S.write_srt(cues, final_blank=False).join(ends, "key").withColumn("bom", F.lit(False))
    return Q.validate(files, _expected(cues))


@query("val12_status_ladder", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 9 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 6 = 1 THEN 'needs_input' ELSE 'completed' END AS status,
CASE WHEN o_orderkey % 11 = 0 THEN 'UPSTREAM_TRANSCRIPT_INVALID' WHEN o_orderkey % 13 = 0 THEN 'UPSTREAM_CALIBRATION_INVALID' WHEN o_orderkey % 17 = 0 THEN 'UPSTREAM_ARTIFACT_MISMATCH' WHEN o_orderkey % 7 = 0 THEN 'SUGGESTION' WHEN o_orderkey % 5 = 0 THEN 'MODE' WHEN o_orderkey % 9 = 0 THEN 'REFERENCE'
WHEN o_orderkey % 4 = 0 THEN 'REFERENCE_AUDIO_MISMATCH' WHEN o_orderkey % 6 = 1 THEN 'CALIBRATED_HARD_LIMIT_INVALID_FOR_FIXED_TIMELINE' END AS code FROM orders""")
def val12(spark, d):
    key = F.col("o_orderkey")
    rung = Q.status(
        key % 11 != 0, key % 13 != 0, key % 17 != 0, F.when(key % 7 == 0, "SUGGESTION"), F.when(key % 5 == 0, "MODE"), F.when(key % 9 == 0, "REFERENCE"),
        F.when(key % 4 == 0, "needs_input").otherwise("matched"), key % 6 == 1,
    )
    return D.table(spark, d, "orders").select("o_orderkey", rung.alias("s")).select("o_orderkey", "s.*")


_LOOSE = "CASE WHEN doc_id % 7 = 3 THEN text || 'e\u0301' ELSE text END"


@query("val13_composed_inputs", f"SELECT doc_id FROM (SELECT doc_id, {_LOOSE} AS t FROM documents) WHERE t <> nfc_normalize(t)")
def val13(spark, d):
    """Texts that aren't composed (NFC): every seventh ends in a letter and its accent apart."""
    texts = D.table(spark, d, "documents").select("doc_id", F.expr(_LOOSE).alias("t"))
    return texts.where(F.col("t") != V.nfc(F.col("t"))).select("doc_id")


# --- dictionaries and adapters ---------------------------------------------------------------------------


@query("mut1_optimistic_edits", """WITH r AS (SELECT o_custkey AS dictionary_id, count(*) AS revision, arg_max(o_orderpriority, o_orderkey) AS content FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey),
e AS (SELECT o_custkey AS dictionary_id, o_orderkey AS edit_id, o_orderkey % 3 + 9 AS expected, o_orderpriority AS content FROM orders)
SELECT dictionary_id, edit_id, outcome, CASE WHEN outcome = 'written' THEN now + 1 END AS revision FROM (
SELECT e.dictionary_id, e.edit_id, r.revision AS now, CASE WHEN r.dictionary_id IS NULL THEN 'not_found' WHEN e.expected <> r.revision THEN 'stale' WHEN e.content = r.content THEN 'unchanged' WHEN e.edit_id <> min(e.edit_id) OVER (PARTITION BY e.dictionary_id, e.expected) THEN 'stale' ELSE 'written' END AS outcome
FROM e LEFT JOIN r ON r.dictionary_id = e.dictionary_id)""")
def mut1(spark, d):
    """MUT2 and MUT4 are the same: append a revision if the expected one is the current one."""
    from pyspark.sql import Window as W

    orders = D.table(spark, d, "orders")
    revisions = orders.where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("dictionary_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("revision"), F.col("o_orderpriority").alias("content"))
    edits = orders.select(F.col("o_custkey").alias("dictionary_id"), F.col("o_orderkey").alias("edit_id"), (F.col("o_orderkey") % 3 + 9).alias("expected"), F.col("o_orderpriority").alias("content"))
    return P.mutate(revisions, edits)


@query("mut3_made_entries", "SELECT p_partkey, trim(p_name) AS canonical, list_sort(list_distinct([lower(p_brand), lower(p_brand), p_type])) AS variants FROM part")
def mut3(spark, d):
    """Composed, trimmed, variants once each."""
    variants = F.array_distinct(F.transform(F.array(F.concat(F.lit(" "), F.lower("p_brand")), F.lower("p_brand"), F.concat("p_type", F.lit(" "))), T.trim))
    return D.table(spark, d, "part").select("p_partkey", T.trim(V.nfc(F.concat(F.lit("  "), F.col("p_name")))).alias("canonical"), F.array_sort(variants).alias("variants"))


@query("udf2_proofread", sql("SELECT task_id, idx, replace(replace(text, 'the', 'teh'), 'and', '&') AS corrected_text, replace(replace(text, 'the', 'teh'), 'and', '&') <> text AS changed FROM segments"))
def udf2(spark, d):
    """UDF1, UDF3, UDF4 and UDF7 share the interface: a named callable on a task's rows."""
    adapter = X.dictionary_proofreader({"the": "teh", "and": "&"})
    return X.apply(adapter, D.segments(spark, d))
