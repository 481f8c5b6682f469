"""Jobs, calls, requests, deliveries and dictionary revisions as queries over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idempotent_requests(requests: DataFrame) -> DataFrame:
    """Each submission as accepted (the first of its request_id), replay (the same fingerprint) or conflict.
    requests: request_id, fingerprint, at. Joined with one row a request, so a hot request_id is no group in memory."""
    first = requests.groupBy("request_id").agg(F.min_by(F.struct("fingerprint", "at"), "at").alias("f"))
    outcome = F.when(F.col("at") == F.col("f.at"), "accepted").when(F.col("fingerprint") == F.col("f.fingerprint"), "replay").otherwise("conflict")
    return requests.join(first, "request_id").select("request_id", "at", outcome.alias("outcome"))


def call_phases(log: DataFrame) -> DataFrame:
    """Each call's phases, each counted once: times of dispatch, of the stored response and of the end; a call that
    was dispatched and has nothing else is of unknown outcome."""
    at = lambda phase: F.min(F.when(F.col("phase") == phase, F.col("at")))
    calls = log.groupBy("call_id").agg(
        at("dispatched").alias("dispatched_at"), at("response_persisted").alias("response_at"), at("terminal").alias("terminal_at"),
        (F.count("*") - F.count_distinct("phase")).alias("repeated"),
    )
    outcome = F.when(F.col("terminal_at").isNotNull(), "known_terminal").when(F.col("response_at").isNotNull(), "response_persisted").when(F.col("dispatched_at").isNotNull(), "outcome_unknown").otherwise("not_dispatched")
    return calls.withColumn("outcome", outcome)


def recovery(status: Column, call_state: Column, cancel_requested: Column) -> Column:
    """What an audit after a crash does with a task: a call in flight is never replayed."""
    return (
        F.when(status.isin("completed", "failed", "cancelled", "needs_input", "interrupted"), "none")
        .when(cancel_requested & (call_state != "in_flight"), "cancel")
        .when(call_state == "in_flight", "interrupt")
        .when(call_state.isin("response_persisted", "not_started"), "requeue")
        .otherwise("interrupt")
    )


def control_outcome(pause: Column, resume: Column, cancel: Column) -> Column:
    """Cancel wins; else the later of pause and resume. The arguments are sequence numbers or null."""
    return F.when(cancel.isNotNull(), "cancelled").when(pause.isNotNull() & (resume.isNull() | (pause > resume)), "paused").otherwise("running")


def retry_plan(tasks: DataFrame, now: Column) -> DataFrame:
    """Whether a task may be retried, from where, at the cost of which calls, and within which day-long window.
    tasks: task_id, status, outcome, response_persisted, error_category, provided, chat_known, asr_known, updated_at."""
    retryable = F.col("status").isin("failed", "interrupted")
    own_problem = F.coalesce(F.col("error_category").isin("input", "config", "security"), F.lit(False))
    allowed = retryable & F.col("outcome").isin("known_terminal", "not_dispatched") & ~F.col("response_persisted") & ~own_problem
    chat_only = F.col("chat_known") | (F.col("provided") & (F.col("outcome") == "not_dispatched"))
    reason = (
        F.when(allowed, F.lit(None).cast("string"))
        .when(F.col("outcome") == "outcome_unknown", "outcome_unknown")
        .when(F.col("response_persisted"), "response_persisted")
        .when(own_problem, "user_input")
        .when(~retryable, "status")
        .otherwise("no_safe_start")
    )
    effective = F.greatest("updated_at", now)
    start = F.col("updated_at") + F.floor((effective - F.col("updated_at")) / 86_400) * 86_400
    return tasks.select(
        "task_id", allowed.alias("allowed"), reason.alias("reason"), F.when(chat_only, "chat_not_started").when(F.col("asr_known"), "asr_not_started").alias("checkpoint"),
        F.when(allowed & ~chat_only & ~F.col("provided"), 1).otherwise(0).alias("asr_calls"), F.when(allowed, 1).otherwise(0).alias("chat_calls"),
        start.cast("long").alias("valid_from"), (start + 86_400).cast("long").alias("valid_to"),
    )


def one_winner(attempts: DataFrame) -> DataFrame:
    """Of the attempts of one plan the first wins, the others lose. attempts: plan_id, attempt_id, at."""
    won = attempts.groupBy("plan_id").agg(F.min_by("attempt_id", F.struct("at", "attempt_id")).alias("won"))
    return attempts.join(won, "plan_id").select("plan_id", "attempt_id", (F.col("attempt_id") == F.col("won")).alias("winner"))


def delivery_name(stem: Column, task: Column, sha256: Column) -> Column:
    """Content decides the name: stem, task, `approved` and twelve digits of the hash."""
    return F.concat_ws(".", stem, task.cast("string"), F.lit("approved"), F.substring(sha256, 1, 12), F.lit("srt"))


def deliver(approved: DataFrame, delivered: DataFrame) -> DataFrame:
    """(name, sha256, outcome): new content is delivered, the same is left alone, other bytes under a name conflict.
    Both have name and sha256; `delivered` is the history, one row a name."""
    before = delivered.select("name", F.col("sha256").alias("__before"))
    outcome = F.when(F.col("__before").isNull(), "delivered").when(F.col("__before") == F.col("sha256"), "unchanged").otherwise("conflict")
    return approved.join(before, "name", "left").select("name", "sha256", outcome.alias("outcome"))


def new_versions(rows: DataFrame, kept: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content isn't kept yet under their key: what an append-only table of versions gets."""
    return rows.dropDuplicates([key, content]).join(kept.select(key, content), [key, content], "left_anti")


def mutate(revisions: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of dictionaries under optimistic locking. revisions: dictionary_id, revision, content; edits:
    dictionary_id, edit_id, expected, content. An edit of another revision is stale, one with the same content does
    nothing, and of several for one revision the first wins."""
    now = revisions.groupBy("dictionary_id").agg(F.max_by(F.struct("revision", "content"), "revision").alias("now"))
    first = edits.groupBy("dictionary_id", "expected").agg(F.min("edit_id").alias("first"))
    both = edits.join(first, ["dictionary_id", "expected"]).join(now, "dictionary_id", "left")
    outcome = (
        F.when(F.col("now").isNull(), "not_found").when(F.col("expected") != F.col("now.revision"), "stale").when(F.col("content") == F.col("now.content"), "unchanged")
        .when(F.col("edit_id") != F.col("first"), "stale").otherwise("written")
    )
    return both.select("dictionary_id", "edit_id", outcome.alias("outcome"), F.when(outcome == "written", F.col("now.revision") + 1).alias("revision"))
