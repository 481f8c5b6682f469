"""The named checks and contract rules as lists of tests, and the SQL that each list means."""

from __future__ import annotations

from cuelake.functions import text as T
from cuelake.operators import validate as V
from cuelake.operators.validate import ExactlyOne, Exists, Group, Over, Pair, Unique, Where
from cuelake.plans import contracts as C
from cuelake.plans.registry import query

_GCS = "(bucket IS NULL) <> (evidence_bucket IS NULL) OR coalesce(bucket <> evidence_bucket, FALSE) OR bucket IS NOT NULL AND (upload_at > read_at OR read_at > delete_at)"
_M, _S, _T = "config_id || '@' || pos", "entry_id || '@' || pos", "task_id"
_PREVIOUS = "lag({0}) OVER (PARTITION BY task_id ORDER BY pos)"
_CALL, _ERROR, _STAGING, _CHUNK, _FOUND, _WARNING, _APP = (f"task_id || '/' || {c} || '@' || pos" for c in ("call_id", "error_id", "staging_id", "chunk_id", "finding_id", "warning_id", "application_id"))
_TASK = ("task_id", "task_id")

#: Any of the kinds of credentials of `T.SECRETS`, wherever it stands. DuckDB's patterns have no look-arounds, so these are taken out of the same text.
_VALUE = "|".join(f"(^|[^A-Za-z0-9_]){p}" if p.startswith("(?<!") else p for p in T.SECRETS.values())
for _around, _plain in (("(?<![A-Za-z0-9_])", ""), ("(?![A-Za-z0-9_])", ""), ("'", "''"), ("\\", "\\\\")):
    _VALUE = _VALUE.replace(_around, _plain)
_FIELD = T.SENSITIVE_FIELD.replace("(?:", "(")

CHECKS: dict[str, list[V.Test]] = {
    "ck01_unique_model_config_ids": [Unique("models", ("config_id",), "pos", _M)],
    "ck02_model_defaults": [Exists("defaults", "models", (("config_id", "config_id"), ("role", "role")), "slot", parent_where="enabled")],
    "ck03_model_fingerprints": [Where("models", "fingerprint <> sha2(model_name, 256)", _M)],
    "ck04_model_check_consistency": [
        Where("models", "check_config_id <> config_id OR check_role <> role", _M),
        Exists("needs", "capabilities", (("pos", "pos"), ("capability", "capability")), "pos || capability", where="check_status = 'passed'"),
        Where("capabilities", "check_status = 'failed'", "pos || capability"),
    ],
    "ck05_confirmation_before_check": [Where("models", "check_confirmation_ref <> confirmation_ref OR NOT confirmed OR confirmed_at > started_at", _M)],
    "ck06_check_times": [Where("models", "started_at > ended_at", _M)],
    "ck07_confirmation_categories": [Where("models", "categories <> expected_categories", _M)],
    "ck08_registry_times": [Where("models", "updated_at < greatest(confirmed_at, ended_at)", _M)],
    "ck09_storage_capability": [Where("models", _GCS, _M), Pair("models", "part_sums", ("pos",), "declared_bytes <> part_bytes", _M)],
    "ck10_snapshot_unique_ids": [Unique("snapshot_entries", ("entry_id",), "pos", _S), Unique("snapshot_entries", ("config_id",), "pos", _S)],
    "ck11_snapshot_entry_consistency": [
        Where("snapshot_entries", "slot_role <> role OR check_status <> 'passed' OR entry_name <> model_name OR entry_fingerprint <> fingerprint", _S),
        Exists("needs", "capabilities", (("pos", "pos"), ("capability", "capability")), "pos || capability"),
    ],
    "ck12_snapshot_confirmation": [Where("snapshot_entries", "check_confirmation_ref <> confirmation_ref OR categories <> expected_categories", _S)],
    "ck13_snapshot_capture_times": [Where("snapshot_entries", "started_at > ended_at OR captured_at < greatest(started_at, ended_at)", _S)],
    "ck14_snapshot_confirmation_before_check": [Where("snapshot_entries", "NOT confirmed OR confirmed_at > started_at", _S)],
    "ck15_snapshot_storage": [Where("snapshot_entries", _GCS, _S)],
    "ck16_failure_consistency": [
        Where("calls", "(certainty IS NULL) <> (call_outcome IS NULL)", _CALL),
        Unique("errors", ("task_id", "error_id"), "pos", _ERROR),
        Unique("warnings", ("task_id", "warning_id"), "pos", _WARNING),
        Unique("staging", ("task_id", "staging_id"), "pos", _STAGING),
        Exists("warnings", "errors", (_TASK, ("warning_error", "error_id")), _WARNING, where="warning_error IS NOT NULL"),
        Exists("warnings", "staging", (_TASK, ("warning_staging", "staging_id")), _WARNING, where="warning_staging IS NOT NULL"),
        Exists("calls", "errors", (_TASK, ("call_error", "error_id")), _CALL, where="call_error IS NOT NULL"),
        Exists("staging", "calls", (_TASK, ("staging_call", "call_id")), _STAGING, where="staging_call IS NOT NULL"),
        Where("staging", "cleaned_at < created_at", _STAGING),
        ExactlyOne("staging", "errors", (_TASK, ("staging_error", "error_id")), _STAGING, "cleanup_status = 'failed'", "error_stage = 'staging_cleanup'"),
        ExactlyOne("staging", "warnings", (_TASK, ("staging_id", "warning_staging")), _STAGING, "cleanup_status = 'failed'", "severity = 'high'"),
        Exists("errors", "calls", (_TASK, ("error_id", "call_error")), _ERROR, where="error_stage = 'call'"),
    ],
    "ck17_sensitive_provider_config": [Where("config_fields", f"field <> 'credential_ref' AND regexp_like(field, '{_FIELD}') OR regexp_like(content, '{_VALUE}')", "pos || field")],
    "ck18_sensitive_model_metadata": [Where("models", f"regexp_like(model_name, '{_VALUE}') OR regexp_like(config_id, '{_VALUE}') OR regexp_like(bucket, '{_VALUE}')", _M)],
    "ck19_transcript_content": [Where("transcripts", "full_text <> joined", _T)],
    "ck20_transcript_segment_order": [Over("cues", (("expected", "row_number() OVER (PARTITION BY task_id ORDER BY pos) - 1"), ("before", _PREVIOUS.format("cue_end"))), "cue_index <> expected OR cue_start < before", "task_id || '/' || pos")],
    "ck21_transcript_segment_times": [Pair("cues", "tasks", ("task_id",), "cue_start < 0 OR cue_start >= cue_end OR cue_end > duration_ms", "task_id || '/' || pos")],
    "ck22_transcript_word_times": [
        Pair("cue_words", "cues", ("task_id", "pos"), "word_start < cue_start OR word_end > cue_end OR word_end <= word_start", "word_id"),
        Over("cue_words", (("expected", "row_number() OVER (PARTITION BY task_id, pos ORDER BY word_pos) - 1"), ("before", "lag(word_end) OVER (PARTITION BY task_id, pos ORDER BY word_pos)")), "word_index <> expected OR word_start < before", "word_id"),
    ],
    "ck23_transcript_unique_ids": [Unique("cues", ("task_id", "cue_id"), "pos", "task_id || '/' || pos"), Unique("cue_words", ("task_id", "word_id"), "pos * 1000 + word_pos", "task_id || '/' || pos || '/' || word_pos")],
    "ck24_transcript_call_success": [Where("tasks", "transcript_call <> 'completed' OR transcript_errors > 0", _T)],
    "ck25_request_mode": [Where("tasks", "(mode IS NULL) <> (NOT has_reference)", _T)],
    "ck26_suggestion_times": [Where("proposals", "from_ms >= to_ms", "task_id || '/' || pos")],
    "ck27_text_only_policy": [Pair("proposals", "tasks", ("task_id",), "mode = 'text-only' AND kind <> 'text_correction'", "task_id || '/' || pos")],
    "ck28_suggestion_unique_ids": [Unique("proposals", ("task_id", "suggestion_id"), "pos", "task_id || '/' || pos")],
    "ck29_calibration_completed": [Where("tasks", "calibration = 'completed' AND (calibration_call <> 'completed' OR calibration_error IS NOT NULL)", _T)],
    "ck30_calibration_failed": [
        Where("tasks", "calibration = 'failed' AND calibration_call <> 'failed'", _T),
        Exists("tasks", "errors", (_TASK, ("calibration_error", "error_id")), _T, where="calibration = 'failed'"),
        Pair("proposals", "tasks", ("task_id",), "calibration = 'failed'", "task_id || '/' || pos"),
    ],
    "ck31_verification_failed": [
        Pair("calls", "tasks", ("task_id",), "verification = 'failed' AND call_outcome = 'failed' AND call_error IS NULL", _CALL),
        Exists("tasks", "calls", (_TASK,), _T, where="verification = 'failed'", parent_where="call_outcome = 'failed'"),
        Pair("applications", "tasks", ("task_id",), "verification = 'failed' AND disposition = 'applied'", _APP),
    ],
    "ck32_verification_completed": [
        Exists("tasks", "calls", (_TASK,), _T, where="verification = 'completed'"),
        Pair("calls", "tasks", ("task_id",), "verification = 'completed' AND call_outcome <> 'completed'", _CALL),
        Pair("staging", "tasks", ("task_id",), "verification = 'completed' AND cleanup_status <> 'deleted'", _STAGING),
    ],
    "ck33_finding_times": [Where("found", "found_start >= found_end", _FOUND)],
    "ck34_application_links": [
        Exists("found", "applications", (_TASK, ("finding_id", "finding_id")), _FOUND),
        Exists("applications", "found", (_TASK, ("finding_id", "finding_id")), _APP),
        Unique("applications", ("task_id", "finding_id"), "pos", _APP),
    ],
    "ck35_application_policy": [
        Pair("applications", "tasks", ("task_id",), "verification = 'failed' AND disposition <> 'not_applied'", _APP),
        Exists("applications", "found", (_TASK, ("finding_id", "finding_id")), _APP, where="disposition = 'applied'", parent_where="finding_kind <> 'translation'"),
    ],
    "ck36_staging_call_links": [
        Exists("staging", "calls", (_TASK,), _STAGING, where="staging_call IS NOT NULL"),
        Exists("staging", "calls", (_TASK, ("staging_call", "call_id")), _STAGING, where="staging_call IS NOT NULL"),
    ],
    "ck37_staging_call_times": [Pair("staging", "calls", ("task_id", "pos"), "staging_call = call_id AND (created_at > call_started OR cleaned_at < call_ended)", _STAGING)],
    "ck38_chunk_ranges": [
        Over("chunks", (("before", "coalesce(lag(chunk_end) OVER (PARTITION BY task_id ORDER BY pos), 0)"),), "chunk_start <> before", _CHUNK),
        Group("chunks", ("task_id",), "(sum(bytes) > 15000000) <> (count(*) > 1)", _T),
        Where("chunks", "bytes > 15000000", _CHUNK),
    ],
    "ck39_chunk_links": [
        Over("chunks", (("skipped", "max(CASE WHEN chunk_call IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),), "chunk_call IS NOT NULL AND skipped = 1", _CHUNK),
        Unique("chunks", ("task_id", "chunk_call"), "pos", _CHUNK),
        Exists("chunks", "calls", (_TASK, ("chunk_call", "call_id")), _CHUNK, where="chunk_call IS NOT NULL"),
        Pair("chunks", "calls", ("task_id", "pos"), "chunk_call = call_id AND (chunk_outcome <> call_outcome OR coalesce(chunk_error, '') <> coalesce(call_error, ''))", _CHUNK),
    ],
    "ck40_chunk_local_only": [
        Exists("chunks", "tasks", (_TASK,), _CHUNK, parent_where="verification <> 'skipped'"),
        Pair("staging", "tasks", ("task_id",), "verification = 'skipped'", _STAGING),
    ],
    "ck41_chunk_completed": [Pair("chunks", "tasks", ("task_id",), "verification = 'completed' AND chunk_outcome <> 'completed'", _CHUNK)],
    "ck42_chunk_failed": [Group("chunks", ("task_id",), "count(CASE WHEN chunk_outcome = 'failed' THEN 1 END) <> 1", _T, where="task_id % 4 = 0")],
    "ck43_verification_unique_ids": [
        Unique("found", ("task_id", "finding_id"), "pos", _FOUND), Unique("applications", ("task_id", "application_id"), "pos", _APP), Unique("calls", ("task_id", "call_id"), "pos", _CALL),
        Unique("calls", ("task_id", "provider_request_id"), "pos", _CALL), Unique("staging", ("task_id", "staging_id"), "pos", _STAGING), Unique("staging", ("task_id", "object_uri"), "pos", _STAGING),
        Unique("chunks", ("task_id", "chunk_id"), "pos", _CHUNK),
    ],
    "ck44_cleanup_consistency": [
        ExactlyOne("staging", "errors", (_TASK, ("staging_error", "error_id")), _STAGING, "cleanup_status = 'failed'"),
        ExactlyOne("staging", "warnings", (_TASK, ("staging_id", "warning_staging")), _STAGING, "cleanup_status = 'failed'", "severity = 'high'"),
        Where("staging", "cleanup_status <> 'failed' AND staging_error IS NOT NULL", _STAGING),
    ],
    "ck45_call_times": [Where("calls", "call_ended < call_started", _CALL)],
    "ck46_created_after_records": [Pair("calls", "tasks", ("task_id",), "artifact_at < call_ended", _CALL), Pair("staging", "tasks", ("task_id",), "artifact_at < cleaned_at", _STAGING)],
    "ck47_diagnostic_links": [
        Unique("errors", ("task_id", "error_id"), "pos", _ERROR), Unique("warnings", ("task_id", "warning_id"), "pos", _WARNING),
        Exists("warnings", "errors", (_TASK, ("warning_error", "error_id")), _WARNING, where="warning_error IS NOT NULL"),
        Exists("calls", "errors", (_TASK, ("call_error", "error_id")), _CALL, where="call_error IS NOT NULL"),
        Exists("staging", "errors", (_TASK, ("staging_error", "error_id")), _STAGING, where="staging_error IS NOT NULL"),
    ],
    "ck48_staging_times": [Where("staging", "cleaned_at < created_at", _STAGING)],
    # rules across documents, and those of the later contract versions
    "val2_artifact_graph": [
        Exists("tasks", "tasks", (("transcript_ref", "transcript_id"),), _T),
        Exists("tasks", "snapshot_entries", (("snapshot_ref", "entry_id"),), _T),
        Exists("applications", "found", (_TASK, ("finding_id", "finding_id")), _APP),
        Exists("chunks", "calls", (_TASK, ("chunk_call", "call_id")), _CHUNK, where="chunk_call IS NOT NULL"),
        Pair("cues", "tasks", ("task_id",), "transcript_call = 'failed'", "task_id || '/' || pos"),
    ],
    "val3_exchange_documents": [
        Where("requests", "mode = 'provided' AND transcript_path IS NULL OR mode = 'provider' AND media_path IS NULL", "request_id || '@' || pos"),
        Where("requests", "regexp_like(media_path, '(^|/)\\\\.\\\\.(/|$)')", "request_id || '@' || pos"),
        Where("requests", "(status = 'failed') <> (error_code IS NOT NULL) OR (status = 'completed') <> (result_ref IS NOT NULL)", "request_id || '@' || pos"),
    ],
    "val4_model_v2": [
        Where("models", "role = 'asr' AND categories <> 'audio' OR enabled AND check_status <> 'passed'", _M),
        Exists("defaults", "models", (("config_id", "config_id"),), "slot", parent_where="enabled AND check_status = 'passed'"),
        Exists("needs", "capabilities", (("pos", "pos"), ("capability", "capability")), "pos || capability", where="check_status = 'passed'"),
    ],
    "val5_corrected_units": [
        Unique("proposals", ("task_id", "suggestion_id"), "pos", "task_id || '/' || pos"),
        Where("proposals", "from_ms >= to_ms OR changed <> (original_text <> suggested_text) OR n_sources + n_references = 0", "task_id || '/' || pos"),
        Group("proposals", ("task_id",), "count(CASE WHEN changed THEN 1 END) <> count(CASE WHEN original_text <> suggested_text THEN 1 END)", _T),
    ],
    "val6_job_records": [
        Where("requests", "(status = 'running') <> (worker_id IS NOT NULL)", "request_id || '@' || pos"),
        Where("requests", "(status = 'running') <> (completed_at IS NULL) OR completed_at < started_at", "request_id || '@' || pos"),
    ],
    "val7_task_records": [
        Where("requests", "revision < 1 OR pause_requested AND cancel_requested OR status <> 'running' AND (pause_requested OR cancel_requested)", "request_id || '@' || pos"),
        Where("requests", "status = 'completed' AND error_code IS NOT NULL OR status = 'failed' AND result_ref IS NOT NULL", "request_id || '@' || pos"),
    ],
    "val10_calibrated_shape": [
        Over("cues", (("before", _PREVIOUS.format("cue_end")),), "cue_start < before OR cue_start >= cue_end", "task_id || '/' || pos"),
        Where("cues", "trim(cue_text) = ''", "task_id || '/' || pos"),
        Exists("proposals", "cues", (_TASK, ("pos", "pos")), "task_id || '/' || pos"),
    ],
    "val11_reference_timeline": [
        Over("cues", (("before", _PREVIOUS.format("cue_end")),), "cue_start < before OR cue_end <= cue_start", "task_id || '/' || pos"),
        Where("cues", "length(cue_text) > 23", "task_id || '/' || pos"),
    ],
}


def test_sql(t: V.Test) -> str:
    """The rows of `ref` that a test finds, as SQL."""
    if isinstance(t, Where):
        return f"SELECT {t.ref} AS ref FROM {t.table} WHERE {t.condition}"
    if isinstance(t, Unique):
        keys = ", ".join(t.keys)
        filled = " AND ".join(f"{k} IS NOT NULL" for k in t.keys)
        return f"SELECT {t.ref} AS ref FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {t.order}) AS nth FROM {t.table} WHERE {filled}) WHERE nth > 1"
    if isinstance(t, Exists | ExactlyOne):
        same = " AND ".join(f"p.{p} = c.{c}" for c, p in t.on)
        parent = f"(SELECT * FROM {t.parent} WHERE {t.parent_where}) p WHERE {same}"
        test = f"NOT EXISTS (SELECT 1 FROM {parent})" if isinstance(t, Exists) else f"(SELECT count(*) FROM {parent}) <> 1"
        return f"SELECT {t.ref} AS ref FROM (SELECT * FROM {t.table} WHERE {t.where}) c WHERE {test}"
    if isinstance(t, Group):
        return f"SELECT {t.ref} AS ref FROM {t.table} WHERE {t.where} GROUP BY {', '.join(t.keys)} HAVING {t.having}"
    if isinstance(t, Over):
        return f"SELECT {t.ref} AS ref FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in t.columns)} FROM {t.table}) WHERE {t.condition}"
    return f"SELECT {t.ref} AS ref FROM {t.table} {'LEFT ' if t.left else ''}JOIN {t.right} USING ({', '.join(t.on)}) WHERE {t.condition}"


def rule_sql(check: str, tests: list[V.Test]) -> str:
    found = " UNION ALL ".join(f"(SELECT CAST(ref AS VARCHAR) AS ref FROM ({test_sql(t)}))" for t in tests)
    return C.duck(f"WITH {C.SQL} SELECT '{check}' AS \"check\", ref FROM ({found})").replace("regexp_like(", "regexp_matches(").replace("\\\\.", "\\.")


def _register(check: str, tests: list[V.Test]) -> None:
    query(check, rule_sql(check, tests))(lambda spark, d: V.issues(check, tests, C.frames(spark, d, written=len(tests) > 3)))


for _check, _tests in CHECKS.items():
    _register(_check, _tests)


@query("val1_issue_counts", f"WITH issues AS (SELECT DISTINCT * FROM ({' UNION ALL '.join('(' + rule_sql(c, CHECKS[c]) + ')' for c in ('ck01_unique_model_config_ids', 'ck20_transcript_segment_order', 'ck43_verification_unique_ids', 'ck45_call_times'))})) SELECT \"check\", count(*) AS issues FROM issues GROUP BY \"check\"")
def val1(spark, d):
    """UDF5: rules by name from a registry, one report over several of them."""
    chosen = ("ck01_unique_model_config_ids", "ck20_transcript_segment_order", "ck43_verification_unique_ids", "ck45_call_times")
    return V.report({c: CHECKS[c] for c in chosen}, C.frames(spark, d)).groupBy("check").count().withColumnRenamed("count", "issues")
