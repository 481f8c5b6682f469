"""Streams over the event table, driven to their end, and the logs and jobs that they feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import process as P
from cuelake.plans import workload as D
from cuelake.plans.registry import query
from cuelake.plans.workload import sql
from cuelake.sources import logsource as L
from cuelake.sources import subtitles as S
from cuelake.sources.storage import fresh
from cuelake.streaming import events as E
from cuelake.streaming import stateful as ST

_WANTED = "CASE type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'error' THEN 'failed' ELSE 'pausing' END"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, after in E.TRANSITIONS.items() for b in after)
_FOLD = f"""WITH RECURSIVE {D.SQL}, allowed(a, b) AS (VALUES {_ALLOWED}), log AS (SELECT task_id, sequence, {_WANTED} AS wanted FROM task_events),
fold AS (
  SELECT task_id, 0::BIGINT AS sequence, 'queued' AS status, TRUE AS accepted FROM (SELECT DISTINCT task_id FROM log)
  UNION ALL
  SELECT l.task_id, l.sequence, CASE WHEN x.a IS NOT NULL THEN l.wanted ELSE f.status END, x.a IS NOT NULL
  FROM fold f JOIN log l ON l.task_id = f.task_id AND l.sequence = f.sequence + 1 LEFT JOIN allowed x ON x.a = f.status AND x.b = l.wanted
)
SELECT task_id, sequence, status, accepted FROM fold WHERE sequence > 0"""


def _stream(spark, d, table="events"):
    return E.follow(spark, d, D.table(spark, d, table).schema, f"{table}.parquet")


def _log(spark, d):
    return D.task_events(spark, d).select("task_id", "sequence", F.expr(_WANTED).alias("wanted"))


@query("stm1_once_by_key", "SELECT DISTINCT user_id AS task_id, (props ->> '$.k')::BIGINT AS k FROM events")
def stm1(spark, d):
    """Each (task, key) once, however often it comes."""
    keyed = _stream(spark, d).select(F.col("user_id").alias("task_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return E.run(E.once(keyed, "task_id", "k"), "stm1")


@query("stm2_watch_after", "SELECT event_id, user_id AS task_id, event_type AS type FROM events WHERE event_id > 50 AND event_type <> 'view'")
def stm2(spark, d):
    tail = _stream(spark, d).where("event_id > 50 AND event_type <> 'view'")
    return E.run(tail.select("event_id", F.col("user_id").alias("task_id"), F.col("event_type").alias("type")), "stm2")


@query("stm3_queue_batches", "SELECT event_type AS type, count(*) AS jobs, min(event_id) AS oldest FROM events GROUP BY event_type")
def stm3(spark, d):
    """A queue without a worker process: each micro-batch is written as done, then counted."""
    done = fresh(spark, "stm3")
    E.run(_stream(spark, d).select("event_id", "event_type"), "stm3", write=lambda df, n: df.write.mode("overwrite").parquet(f"{done}/batch={n}"))
    return spark.read.parquet(done).groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("jobs"), F.min("event_id").alias("oldest"))


@query("stm4_last_heartbeat", "SELECT user_id AS task_id, max(ts) AS heartbeat FROM events GROUP BY user_id")
def stm4(spark, d):
    return E.run(_stream(spark, d).groupBy(F.col("user_id").alias("task_id")).agg(F.max("ts").alias("heartbeat")), "stm4", mode="complete")


def _in_pieces(spark, rows, name: str, order: str):
    """A stream of `rows` whose files hold them out of order; the last file has the row that moves the watermark past all others."""
    path = fresh(spark, name)
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    rows.repartition(3, F.expr(order)).write.parquet(path)
    wait = int((span["high"] - span["low"]).total_seconds()) + 60 if span["high"] else 60
    after = F.lit(span["high"]).cast("timestamp") + F.make_dt_interval(secs=F.lit(wait + 1))
    rows.limit(1).select(*[(after if c == "at" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return E.follow(spark, path, rows.schema, files_a_batch=1), f"{wait} seconds"


@query("stm4_stale_tasks", """WITH beats AS (SELECT user_id AS task_id, date_trunc('millisecond', ts) AS ts FROM events) SELECT task_id, unnest(['stale', 'alive']) AS state, unnest([ts + INTERVAL 15 SECOND, next]) AS at FROM (SELECT *, lead(ts) OVER (PARTITION BY task_id ORDER BY ts) AS next FROM beats) WHERE next > ts + INTERVAL 15 SECOND
UNION ALL SELECT task_id, 'stale', max(ts) + INTERVAL 15 SECOND FROM beats GROUP BY task_id HAVING max(ts) + INTERVAL 15 SECOND <= (SELECT max(ts) FROM beats) + INTERVAL 1 SECOND""")
def stm4_stale(spark, d):
    """Timers on event time, in milliseconds: a task without a beat for 15 seconds is stale, and the next beat takes that back; the files hold the beats out of order."""
    beats = D.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    stream, delay = _in_pieces(spark, beats, "stm4-beats", "event_id % 3")
    found = E.run(ST.follow_heartbeats(stream, 15_000, delay), "stm4").where("task_id IS NOT NULL")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("stm5_state_fold", _FOLD)
def stm5(spark, d):
    return E.fold_states(_log(spark, d))


@query("stm5_state_stream", _FOLD)
def stm5_stream(spark, d):
    """The same states from a stream whose files hold the events out of order."""
    path = fresh(spark, "stm5-log")
    log = _log(spark, d).repartition(4, F.col("sequence") % 7)
    log.write.parquet(path)
    return E.run(E.follow_states(E.follow(spark, path, log.schema, files_a_batch=1)), "stm5")


@query("stm6_claims", sql("SELECT task_id, arg_max(type, sequence) AS last_type, CASE arg_max(type, sequence) WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'error' THEN 'quarantined' ELSE 'finished' END AS job FROM task_events GROUP BY task_id"))
def stm6(spark, d):
    last = D.task_events(spark, d).groupBy("task_id").agg(F.max_by("type", "sequence").alias("last_type"))
    job = F.when(F.col("last_type") == "signup", "queued").when(F.col("last_type") == "view", "claimed").when(F.col("last_type") == "error", "quarantined").otherwise("finished")
    return last.withColumn("job", job)


@query("stm7_crash_audit", """SELECT event_id, CASE WHEN status IN ('completed', 'failed') THEN 'none' WHEN cancel AND call_state <> 'in_flight' THEN 'cancel' WHEN call_state = 'in_flight' THEN 'interrupt' ELSE 'requeue' END AS action
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status, CASE event_id % 3 WHEN 0 THEN 'not_started' WHEN 1 THEN 'in_flight' ELSE 'response_persisted' END AS call_state, value < 5 AS cancel FROM events)""")
def stm7(spark, d):
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END")
    state = F.expr("CASE event_id % 3 WHEN 0 THEN 'not_started' WHEN 1 THEN 'in_flight' ELSE 'response_persisted' END")
    return D.table(spark, d, "events").select("event_id", P.recovery(status, state, F.col("value") < 5).alias("action"))


@query("stm8_controls", sql("SELECT task_id, CASE WHEN cancel IS NOT NULL THEN 'cancelled' WHEN pause IS NOT NULL AND (resume IS NULL OR pause > resume) THEN 'paused' ELSE 'running' END AS control FROM (SELECT task_id, max(sequence) FILTER (type = 'click') AS pause, max(sequence) FILTER (type = 'view') AS resume, max(sequence) FILTER (type = 'error' AND k = 7) AS cancel FROM task_events GROUP BY task_id)"))
def stm8(spark, d):
    at = lambda c: F.max(F.when(F.expr(c), F.col("sequence")))
    seen = D.task_events(spark, d).groupBy("task_id").agg(at("type = 'click'").alias("pause"), at("type = 'view'").alias("resume"), at("type = 'error' AND k = 7").alias("cancel"))
    return seen.select("task_id", P.control_outcome(F.col("pause"), F.col("resume"), F.col("cancel")).alias("control"))


@query("stm9_idempotent_submit", """SELECT o_custkey AS request_id, o_orderkey AS at_, CASE WHEN o_orderkey = first_at THEN 'accepted' WHEN o_orderpriority = first_print THEN 'replay' ELSE 'conflict' END AS outcome
FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_at, first(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_print FROM orders)""")
def stm9(spark, d):
    requests = D.table(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderkey").alias("at"))
    return P.idempotent_requests(requests).withColumnRenamed("at", "at_")


@query("stm9_request_stream", """SELECT request_id, seq, CASE WHEN seq = first_seq THEN 'accepted' WHEN fingerprint = first_print THEN 'replay' ELSE 'conflict' END AS outcome
FROM (SELECT o_custkey AS request_id, o_orderkey AS seq, o_orderpriority AS fingerprint, first(o_orderkey) OVER o AS first_seq, first(o_orderpriority) OVER o AS first_print FROM orders WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def stm9_stream(spark, d):
    """The same from a stream, in order of the requests' dates, whatever the order of its files: a request is decided once the watermark has passed it."""
    orders = D.table(spark, d, "orders")
    requests = orders.select(F.col("o_custkey").alias("request_id"), F.to_timestamp("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("fingerprint"))
    stream, delay = _in_pieces(spark, requests, "stm9-requests", "seq % 5")
    return E.run(ST.follow_requests(stream, 10**15, delay), "stm9").where("request_id IS NOT NULL")


_PHASE = "CASE l_linenumber % 3 WHEN 1 THEN 'dispatched' WHEN 2 THEN 'response_persisted' ELSE 'terminal' END"


@query("stm10_call_ledger", f"""SELECT call_id, min(n) FILTER (phase = 'dispatched') AS dispatched_at, min(n) FILTER (phase = 'response_persisted') AS response_at, min(n) FILTER (phase = 'terminal') AS terminal_at, (count(*) - count(DISTINCT phase))::BIGINT AS repeated,
CASE WHEN count(*) FILTER (phase = 'terminal') > 0 THEN 'known_terminal' WHEN count(*) FILTER (phase = 'response_persisted') > 0 THEN 'response_persisted' ELSE 'outcome_unknown' END AS outcome
FROM (SELECT l_orderkey AS call_id, l_linenumber::BIGINT AS n, {_PHASE} AS phase FROM lineitem) GROUP BY call_id""")
def stm10(spark, d):
    log = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").cast("long").alias("at"), F.expr(_PHASE).alias("phase"))
    return P.call_phases(log)


_RETRY = """SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'interrupted' ELSE 'running' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'known_terminal' WHEN 1 THEN 'not_dispatched' ELSE 'outcome_unknown' END AS outcome,
o_orderkey % 5 = 0 AS response_persisted, CASE o_orderkey % 7 WHEN 0 THEN 'input' WHEN 1 THEN 'model' END AS error_category, o_orderkey % 2 = 0 AS provided, o_orderkey % 6 = 0 AS chat_known, o_orderkey % 6 = 3 AS asr_known, o_orderkey * 1000 AS updated_at FROM orders"""


@query("stm11_retry_plan", f"""SELECT task_id, allowed, CASE WHEN allowed THEN NULL WHEN outcome = 'outcome_unknown' THEN 'outcome_unknown' WHEN response_persisted THEN 'response_persisted' WHEN own THEN 'user_input' WHEN NOT retryable THEN 'status' ELSE 'no_safe_start' END AS reason,
CASE WHEN chat_only THEN 'chat_not_started' WHEN asr_known THEN 'asr_not_started' END AS checkpoint, CASE WHEN allowed AND NOT chat_only AND NOT provided THEN 1 ELSE 0 END AS asr_calls, CASE WHEN allowed THEN 1 ELSE 0 END AS chat_calls,
(updated_at + (greatest(updated_at, 9000000) - updated_at) // 86400 * 86400)::BIGINT AS valid_from, (updated_at + (greatest(updated_at, 9000000) - updated_at) // 86400 * 86400 + 86400)::BIGINT AS valid_to
FROM (SELECT *, retryable AND outcome <> 'outcome_unknown' AND NOT response_persisted AND NOT own AS allowed FROM (SELECT *, status IN ('failed', 'interrupted') AS retryable, coalesce(error_category = 'input', FALSE) AS own, chat_known OR provided AND outcome = 'not_dispatched' AS chat_only FROM ({_RETRY})))""")
def stm11(spark, d):
    tasks = D.table(spark, d, "orders").selectExpr(*[
        "o_orderkey AS task_id", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'interrupted' ELSE 'running' END AS status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'known_terminal' WHEN 1 THEN 'not_dispatched' ELSE 'outcome_unknown' END AS outcome", "o_orderkey % 5 = 0 AS response_persisted",
        "CASE o_orderkey % 7 WHEN 0 THEN 'input' WHEN 1 THEN 'model' END AS error_category", "o_orderkey % 2 = 0 AS provided", "o_orderkey % 6 = 0 AS chat_known", "o_orderkey % 6 = 3 AS asr_known", "o_orderkey * 1000 AS updated_at",
    ])
    return P.retry_plan(tasks, F.lit(9_000_000))


@query("stm11_one_winner", "SELECT o_custkey AS plan_id, o_orderkey AS attempt_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS winner FROM orders")
def stm11_winner(spark, d):
    return P.one_winner(D.table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("at")))


@query("stm12_delta_stream", sql("SELECT task_id AS call_id, string_agg(text, '' ORDER BY idx) AS content FROM segments GROUP BY task_id"))
def stm12(spark, d):
    """All pieces of answers from a stream whose files hold them out of order."""
    path, cues = fresh(spark, "stm12-pieces"), D.segments(spark, d)
    last = F.max("idx").over(D.W.partitionBy("task_id"))
    pieces = cues.select(F.col("task_id").alias("call_id"), F.col("idx").alias("pos"), F.col("text").alias("chunk"), (F.col("idx") == last).alias("ended"))
    pieces.repartition(3, F.col("pos") % 5).write.parquet(path)
    return E.run(E.join_deltas(E.follow(spark, path, pieces.schema, files_a_batch=1)), "stm12")


_END = "CASE WHEN task_id % 11 = 0 THEN 'connection_close' WHEN task_id % 5 = 0 THEN 'done_marker' ELSE 'finish_reason' END"


@query("stm12_live_answers", sql(f"""SELECT task_id AS call_id, coalesce(string_agg(text, '' ORDER BY idx), '') AS content, count(*) FILTER (text <> '')::BIGINT AS deltas, max({_END}) AS ended_by, max(CASE {_END} WHEN 'connection_close' THEN 'stream_incomplete' WHEN 'finish_reason' THEN 'stop' END) AS finish_reason
FROM (SELECT *, max(idx) OVER (PARTITION BY task_id) AS last FROM segments) WHERE task_id % 7 <> 3 OR task_id % 11 = 0 OR task_id % 5 = 0 OR idx <= last // 2 GROUP BY task_id"""))
def stm12_live(spark, d):
    """Answers as bytes, cut anywhere and out of order in their files; some end before their last cue, some by a marker, some not at all."""
    cues = D.segments(spark, d).withColumn("end", F.expr(_END)).withColumn("last", F.max("idx").over(D.W.partitionBy("task_id")))
    stop = F.when((F.col("end") == "finish_reason") & (F.col("idx") == F.when(F.col("task_id") % 7 == 3, F.expr("last div 2")).otherwise(F.col("last"))), "stop")
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("delta"), stop.alias("finish_reason"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))), F.lit("\r\n"))
    bodies = cues.groupBy(F.col("task_id").alias("call_id"), "end").agg(S.ordered_text(line, F.col("idx"), "").alias("b"))
    data = F.encode(F.concat("b", F.when(F.col("end") == "done_marker", "data: [DONE]\n").otherwise("")), "UTF-8")
    starts = F.sequence(F.lit(0), F.greatest(F.length("data") - 1, F.lit(0)), F.lit(997))
    cut = bodies.select("call_id", data.alias("data")).select("call_id", "data", F.length("data").alias("size"), F.posexplode(starts).alias("pos", "k"))
    pieces = cut.select("call_id", F.col("pos").cast("long").alias("pos"), F.timestamp_seconds(F.col("pos") + 1_700_000_000).alias("at"), F.substring("data", F.col("k") + 1, F.lit(997)).alias("data"), (F.col("k") + 997 >= F.col("size")).alias("closed"))
    stream, delay = _in_pieces(spark, pieces, "stm12-bytes", "pos % 5")
    rows = E.run(ST.follow_answers(stream, 10**12, delay), "stm12-live").where("call_id IS NOT NULL")
    chunks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("n", "chunk")))), lambda x: x["chunk"]), "")
    return rows.groupBy("call_id").agg(chunks.alias("content"), F.count("chunk").alias("deltas"), F.max("ended_by").alias("ended_by"), F.max("finish_reason").alias("finish_reason"))


@query("stm15_delivery_history", sql("SELECT task_id, k AS revision, min(sequence) AS delivered FROM task_events WHERE type = 'purchase' GROUP BY task_id, k"))
def stm15(spark, d):
    """A revision is delivered once; what comes again changes nothing."""
    return D.task_events(spark, d).where("type = 'purchase'").groupBy("task_id", F.col("k").alias("revision")).agg(F.min("sequence").alias("delivered"))


@query("snk7_numbered_log", sql("SELECT event_id, task_id, sequence FROM task_events"))
def snk7(spark, d):
    """Events appended batch by batch, each with its task's next number. The stream is stopped and goes on from its checkpoint."""
    source, log, checkpoint = (fresh(spark, f"snk7-{name}") for name in ("events", "log", "checkpoint"))
    rows = D.table(spark, d, "events").select("event_id", F.col("user_id").alias("task_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("type"))
    half = rows.agg(F.max("event_id")).first()[0] or 0
    for part in ("event_id <= {0} div 2", "event_id > {0} div 2"):
        rows.where(part.format(half)).write.mode("append").parquet(source)
        E.run(E.follow(spark, source, rows.schema), "snk7", write=E.append_numbered(log), checkpoint=checkpoint)
    return spark.read.parquet(log).select("event_id", "task_id", "sequence")


@query("src21_log_gaps", sql("SELECT task_id, sequence, expected FROM (SELECT task_id, sequence, row_number() OVER (PARTITION BY task_id ORDER BY sequence) AS expected FROM task_events WHERE event_id % 40 <> 0) WHERE sequence <> expected"))
def src21(spark, d):
    """A log written as JSON lines and read back, with events missing: every number that isn't the next."""
    path = fresh(spark, "src21-log")
    log = D.task_events(spark, d).where("event_id % 40 <> 0").select(F.col("event_id").cast("string").alias("event_id"), F.col("task_id").cast("string").alias("task_id"), "sequence", F.col("occurred_at").cast("string").alias("occurred_at"), "type")
    log.write.json(path)
    gaps = S.log_gaps(S.read_event_log(spark, path))
    return gaps.select(F.col("task_id").cast("long").alias("task_id"), "sequence", "expected")


_KEPT = "SELECT task_id, count(*) AS events, max(sequence) AS last, sum(sequence)::BIGINT AS total FROM task_events WHERE event_id % 30 <> 0 {0} GROUP BY task_id"


def _written_log(spark, d, name: str) -> str:
    path = fresh(spark, name)
    log = D.task_events(spark, d).where("event_id % 30 <> 0")
    log.select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "task_id", "occurred_at", "type")], "sequence").write.json(path)
    return path


def _counted(events):
    sums = events.groupBy(F.col("task_id").cast("long").alias("task_id")).agg(F.count("*").alias("events"), F.max("sequence").alias("last"), F.sum("sequence").alias("total"))
    return sums.select("task_id", "events", "last", "total")


@query("src21_log_source", sql(_KEPT.format("AND sequence > 3")))
def src21_source(spark, d):
    """A log read in byte ranges; the lower bound of the numbers is applied by the source."""
    L.register(spark)
    return _counted(spark.read.format("event_log").option("blockSize", 4096).load(_written_log(spark, d, "src21-source")).where("sequence > 3"))


@query("stm1_log_tail", sql(_KEPT.format("")))
def stm1_tail(spark, d):
    """The same log followed as a stream of whole lines."""
    L.register(spark)
    path = _written_log(spark, d, "stm1-log")
    return _counted(E.run(spark.readStream.format("event_log").option("blockSize", 65536).load(path), "stm1-tail"))
