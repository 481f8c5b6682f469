"""Rules on nested documents, and SQL that says from the relations which documents break them where."""

from __future__ import annotations

from cuelake.operators import documents as N
from cuelake.plans import contracts as C
from cuelake.plans.registry import query

#: Rows with their place in their document's list.
_PLACED = ", ".join(
    f"{short} AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1 AS i FROM {table})"
    for short, table in {"cue": "cues", "prop": "proposals", "ca": "calls", "st": "staging", "er": "errors", "wa": "warnings", "fi": "found", "ap": "applications", "pa": "chunks"}.items()
)


def _found(kind: str, tests: dict[str, str]) -> str:
    """`tests`: a rule -> queries for (task_id, path)."""
    parts = [f"SELECT '{kind}-' || task_id AS doc_id, '{rule}' AS \"check\", path FROM ({body}) x(task_id, path)" for rule, bodies in tests.items() for body in bodies.split(";")]
    return C.duck(f"WITH {C.SQL}, {_PLACED} SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})")


def _again(table: str, key: str, path: str, name: str = "") -> str:
    return f"SELECT task_id, '{path}/' || i || '/{name or key}' FROM (SELECT *, row_number() OVER (PARTITION BY task_id, {key} ORDER BY i) AS n FROM {table} WHERE {key} IS NOT NULL) WHERE n > 1"


_TRANSCRIPT = {
    "transcript-content-consistency": "SELECT task_id, '/full_text' FROM transcripts WHERE task_id % 6 = 0",
    "transcript-segment-order": "SELECT task_id, '/segments/' || i || '/index' FROM cue WHERE cue_index <> i; SELECT task_id, '/segments/' || i || '/start_ms' FROM (SELECT *, lag(cue_end) OVER (PARTITION BY task_id ORDER BY i) AS b FROM cue) WHERE cue_start < b",
    "transcript-segment-time-ranges": "SELECT task_id, '/segments/' || i FROM cue JOIN tasks USING (task_id) WHERE cue_start >= cue_end OR cue_end > duration_ms",
    "transcript-word-time-ranges": """SELECT task_id, '/segments/' || i || '/words/' || k || CASE WHEN f = 1 THEN '/index' ELSE '' END FROM (
        SELECT w.task_id, c.i, row_number() OVER o - 1 AS k, word_index, word_start, word_end, cue_start, cue_end, lag(word_end) OVER o AS b
        FROM cue_words w JOIN cue c ON c.task_id = w.task_id AND c.pos = w.pos WINDOW o AS (PARTITION BY w.task_id, w.pos ORDER BY word_pos)), (SELECT unnest([0, 1]) AS f)
        WHERE f = 1 AND word_index <> k OR f = 0 AND (word_start >= word_end OR word_end > cue_end OR word_start < cue_start OR word_start < b)""",
    "transcript-unique-ids": _again("cue", "cue_id", "/segments", "segment_id") + """; SELECT task_id, '/segments/*/words/' || k || '/word_id' FROM (
        SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY pos, word_pos) - 1 AS k, row_number() OVER (PARTITION BY task_id, word_id ORDER BY pos, word_pos) AS n FROM cue_words) WHERE n > 1""",
    "transcript-call-success": "SELECT task_id, '/call/outcome' FROM tasks WHERE transcript_call = 'failed' OR transcript_errors > 0",
    "call-record-time-consistency": "SELECT task_id, '/call/ended_at' FROM tasks WHERE task_id % 7 > 5",
}
_CALIBRATION = {
    "calibration-request-mode": "SELECT task_id, '/request/mode' FROM tasks WHERE has_reference = (mode IS NULL)",
    "calibration-suggestion-time-ranges": "SELECT task_id, '/suggestions/' || i FROM prop WHERE from_ms >= to_ms",
    "calibration-text-only-policy": "SELECT task_id, '/suggestions/' || i || '/kind' FROM prop WHERE task_id % 3 = 0 AND kind <> 'text_correction'",
    "calibration-unique-ids": _again("prop", "suggestion_id", "/suggestions"),
    "calibration-completed-consistency": "SELECT task_id, '/call' FROM tasks WHERE task_id % 4 <> 0 AND task_id % 7 = 0",
    "calibration-failed-consistency": "SELECT task_id, '/call' FROM tasks t WHERE task_id % 4 = 0 AND (EXISTS (SELECT 1 FROM prop p WHERE p.task_id = t.task_id) OR NOT EXISTS (SELECT 1 FROM er e WHERE e.task_id = t.task_id AND e.error_id = 'error-0'))",
}
_CALL_OF = "(SELECT task_id, call_id, arg_max(call_outcome, i) AS o, arg_max(coalesce(call_error, ''), i) AS e, arg_max(call_started, i) AS s, arg_max(call_ended, i) AS z FROM ca GROUP BY task_id, call_id)"
_NO = "NOT EXISTS (SELECT 1 FROM {0} y WHERE y.task_id = x.task_id AND y.{1} = x.{2})"
_LINKED = "(SELECT task_id, call_error AS id FROM ca WHERE call_outcome = 'failed' UNION SELECT task_id, staging_error FROM st WHERE cleanup_status = 'failed')"
_LOOSE = f"(SELECT * FROM er x WHERE {_NO.format(_LINKED, 'id', 'error_id')})"
_CALLED = f"(SELECT p.*, c.o, c.e, row_number() OVER (PARTITION BY p.task_id, chunk_call ORDER BY i) AS n FROM pa p LEFT JOIN {_CALL_OF} c ON c.task_id = p.task_id AND c.call_id = p.chunk_call WHERE chunk_outcome <> 'not_called')"
_VERIFICATION = {
    "audio-verification-failed-consistency": f"""SELECT task_id, '/errors' FROM tasks x WHERE verification = 'failed' AND NOT EXISTS (SELECT 1 FROM ca y WHERE y.task_id = x.task_id AND call_outcome = 'failed')
        AND NOT EXISTS (SELECT 1 FROM st y WHERE y.task_id = x.task_id AND cleanup_status = 'failed') AND NOT EXISTS (SELECT 1 FROM {_LOOSE} y WHERE y.task_id = x.task_id AND error_stage = 'staging_upload');
        SELECT task_id, '/calls' FROM tasks x WHERE verification = 'failed' AND EXISTS (SELECT 1 FROM er y WHERE y.task_id = x.task_id AND error_stage = 'staging_upload') AND EXISTS (SELECT 1 FROM ca y WHERE y.task_id = x.task_id);
        SELECT task_id, '/errors/' || i FROM {_LOOSE} JOIN tasks USING (task_id) WHERE verification = 'failed' AND error_stage <> 'staging_upload';
        SELECT task_id, '/application_results/' || i FROM ap JOIN tasks USING (task_id) WHERE verification = 'failed' AND (disposition = 'applied' OR modification_ref IS NOT NULL)""",
    "audio-verification-completed-consistency": """SELECT task_id, '/calls' FROM tasks x WHERE verification = 'completed' AND NOT EXISTS (SELECT 1 FROM ca y WHERE y.task_id = x.task_id);
        SELECT task_id, '/calls' FROM ca JOIN tasks USING (task_id) WHERE verification = 'completed' AND call_outcome <> 'completed'; SELECT task_id, '/staging' FROM st JOIN tasks USING (task_id) WHERE verification = 'completed'""",
    "audio-verification-finding-time-ranges": "SELECT task_id, '/findings/' || i FROM fi WHERE found_start >= found_end",
    "audio-verification-application-links": f"SELECT task_id, '/application_results/' || i || '/finding_ref' FROM ap x WHERE {_NO.format('fi', 'finding_id', 'finding_id')}; "
        + _again(f"(SELECT * FROM ap x WHERE NOT {_NO.format('fi', 'finding_id', 'finding_id')})", "finding_id", "/application_results", "finding_ref") + f"; SELECT task_id, '/application_results' FROM fi x WHERE {_NO.format('ap', 'finding_id', 'finding_id')}",
    "audio-verification-application-policy": "SELECT task_id, '/application_results/' || i FROM ap JOIN tasks USING (task_id) JOIN (SELECT task_id, finding_id, arg_max(finding_kind, i) AS k FROM fi GROUP BY ALL) USING (task_id, finding_id) WHERE disposition = 'applied' AND (verification = 'failed' OR k = 'translation')",
    "audio-verification-staging-call-links": f"SELECT task_id, '/staging/' || i || '/call_ref' FROM st x WHERE staging_call IS NULL AND EXISTS (SELECT 1 FROM ca y WHERE y.task_id = x.task_id) OR staging_call IS NOT NULL AND {_NO.format('ca', 'call_id', 'staging_call')}",
    "audio-verification-staging-call-times": f"SELECT task_id, '/staging/' || i || '/created_at' FROM st JOIN {_CALL_OF} c USING (task_id) WHERE c.call_id = staging_call AND created_at > s; SELECT task_id, '/staging/' || i || '/cleanup_finished_at' FROM st JOIN {_CALL_OF} c USING (task_id) WHERE c.call_id = staging_call AND cleaned_at < z",
    "audio-verification-chunk-ranges": """SELECT task_id, '/local_chunking/source_bytes' FROM pa JOIN tasks USING (task_id) GROUP BY task_id, source_bytes HAVING sum(bytes) <> source_bytes;
        SELECT task_id, '/local_chunking/parts' FROM pa JOIN tasks USING (task_id) GROUP BY task_id, source_bytes HAVING (source_bytes > 15000000) <> (count(*) > 1);
        SELECT task_id, '/local_chunking/parts/' || i FROM (SELECT *, lag(chunk_end, 1, 0) OVER (PARTITION BY task_id ORDER BY i) AS b FROM pa) WHERE chunk_start <> b OR chunk_end <= chunk_start""",
    "audio-verification-chunk-links": f"""SELECT task_id, '/local_chunking/parts/' || i FROM (SELECT *, bool_or(chunk_outcome = 'not_called') OVER (PARTITION BY task_id ORDER BY i) AS b FROM pa) WHERE b AND chunk_outcome <> 'not_called';
        SELECT task_id, '/local_chunking/parts/' || i || '/call_ref' FROM {_CALLED} WHERE o IS NULL OR n > 1;
        SELECT task_id, '/local_chunking/parts/' || i FROM {_CALLED} WHERE o IS NOT NULL AND n = 1 AND (chunk_outcome <> o OR coalesce(chunk_error, '') <> e);
        SELECT task_id, '/local_chunking/parts/' || i || '/error_ref' FROM {_CALLED} x WHERE o IS NOT NULL AND n = 1 AND chunk_error IS NOT NULL AND {_NO.format('er', 'error_id', 'chunk_error')};
        SELECT task_id, '/calls' FROM ca x WHERE task_id IN (SELECT task_id FROM pa) AND {_NO.format(_CALLED, 'chunk_call', 'call_id')}""",
    "audio-verification-chunk-local-only": "SELECT task_id, '/staging' FROM st WHERE task_id IN (SELECT task_id FROM pa); SELECT task_id, '/local_chunking' FROM pa JOIN tasks USING (task_id) WHERE verification = 'skipped'",
    "audio-verification-chunk-completed-status": "SELECT task_id, '/local_chunking/parts' FROM pa JOIN tasks USING (task_id) WHERE verification = 'completed' AND chunk_outcome <> 'completed'",
    "audio-verification-chunk-failed-status": "SELECT task_id, '/local_chunking/parts' FROM pa JOIN tasks USING (task_id) WHERE verification = 'failed' GROUP BY task_id HAVING count(*) FILTER (chunk_outcome = 'failed') <> 1",
    "audio-verification-unique-ids": "; ".join([
        _again("fi", "finding_id", "/findings"), _again("ap", "application_id", "/application_results"), _again("ca", "call_id", "/calls"), _again("ca", "provider_request_id", "/calls"),
        _again("st", "staging_id", "/staging"), _again("st", "object_uri", "/staging"), _again("pa", "chunk_id", "/local_chunking/parts"),
    ]),
    "audio-verification-cleanup-consistency": """SELECT task_id, '/staging/' || i || '/error_ref' FROM st x WHERE cleanup_status = 'failed' AND (
        coalesce((SELECT arg_min(error_stage, i) FROM er y WHERE y.task_id = x.task_id AND error_id = staging_error), '') <> 'staging_cleanup'
        OR (SELECT count(*) FROM wa y WHERE y.task_id = x.task_id AND warning_error = staging_error AND warning_staging = staging_id AND severity = 'high') <> 1)""",
    "call-record-time-consistency": "SELECT task_id, '/calls/' || i || '/ended_at' FROM ca WHERE call_ended < call_started",
    "artifact-created-after-terminal-records": "SELECT task_id, '/created_at' FROM ca JOIN tasks USING (task_id) WHERE call_ended > artifact_at; SELECT task_id, '/created_at' FROM st JOIN tasks USING (task_id) WHERE cleaned_at > artifact_at",
    "artifact-diagnostic-links": "; ".join([
        _again("er", "error_id", "/errors"), _again("wa", "warning_id", "/warnings"),
        f"SELECT task_id, '/warnings/' || i || '/related_error_ref' FROM wa x WHERE warning_error IS NOT NULL AND {_NO.format('er', 'error_id', 'warning_error')}",
        f"SELECT task_id, '/warnings/' || i || '/related_staging_ref' FROM wa x WHERE warning_staging IS NOT NULL AND {_NO.format('st', 'staging_id', 'warning_staging')}",
        f"SELECT task_id, '/calls/' || i || '/error_ref' FROM ca x WHERE call_error IS NOT NULL AND {_NO.format('er', 'error_id', 'call_error')}",
        f"SELECT task_id, '/staging/' || i || '/error_ref' FROM st x WHERE staging_error IS NOT NULL AND {_NO.format('er', 'error_id', 'staging_error')}",
    ]),
    "staging-time-consistency": "SELECT task_id, '/staging/' || i || '/cleanup_finished_at' FROM st WHERE cleaned_at < created_at",
}


def _issues(spark, d, kind: str, tests: dict[str, str]):
    return N.issues(C.documents(spark, d).where(f"kind = '{kind}'"), list(tests))


@query("val1_transcript_documents", _found("transcript", _TRANSCRIPT))
def val1_transcripts(spark, d):
    """CK19 to CK24 and CK45 on JSON documents, with paths."""
    return _issues(spark, d, "transcript", _TRANSCRIPT)


@query("val1_calibration_documents", _found("calibration", _CALIBRATION))
def val1_calibrations(spark, d):
    """CK25 to CK30."""
    return _issues(spark, d, "calibration", _CALIBRATION)


@query("val1_verification_documents", _found("verification", _VERIFICATION))
def val1_verifications(spark, d):
    """CK31 to CK48."""
    return _issues(spark, d, "verification", _VERIFICATION)
