"""Rules on nested documents: clean documents have no issue, and each rule finds what it should at its path."""

import copy
import json

import pytest

from cuelake.operators import documents as D
from cuelake.plans import contracts


def t(second):
    return f"2026-03-04T05:06:{second:02d}.000+08:00"


def call(n=1, **more):
    return {"call_id": f"call-{n}", "started_at": t(10 * n), "ended_at": t(10 * n + 5), "outcome": "completed", "provider_request_id": f"req-{n}", "error_ref": None} | more


TRANSCRIPT = {
    "created_at": t(30), "audio": {"duration_ms": 5000}, "full_text": "one two\nthree",
    "segments": [
        {"segment_id": "s1", "index": 0, "start_ms": 0, "end_ms": 2500, "text": "one two", "words": [{"word_id": "w1", "index": 0, "start_ms": 0, "end_ms": 900, "text": "one"}, {"word_id": "w2", "index": 1, "start_ms": 900, "end_ms": 2500, "text": "two"}]},
        {"segment_id": "s2", "index": 1, "start_ms": 2500, "end_ms": 5000, "text": "three", "words": [{"word_id": "w3", "index": 0, "start_ms": 2500, "end_ms": 4000, "text": "three"}]},
    ],
    "call": call(), "warnings": [], "errors": [],
}
CALIBRATION = {
    "created_at": t(40), "status": "completed", "request": {"reference_srt_ref": "in/a.srt", "mode": "text-only"}, "call": call(),
    "suggestions": [{"suggestion_id": "g1", "kind": "text_correction", "start_ms": 0, "end_ms": 10}, {"suggestion_id": "g2", "kind": "text_correction", "start_ms": 5, "end_ms": 10}], "warnings": [], "errors": [],
}
VERIFICATION = {
    "created_at": t(50), "status": "completed", "calls": [call(1), call(2)],
    "staging": [{"staging_id": "st1", "call_ref": "call-1", "object_uri": "gs://b/1", "created_at": t(1), "cleanup_status": "completed", "cleanup_finished_at": t(40), "error_ref": None}],
    "findings": [{"finding_id": "f1", "kind": "text_correction", "start_ms": 0, "end_ms": 9}, {"finding_id": "f2", "kind": "translation", "start_ms": 0, "end_ms": 9}],
    "application_results": [{"application_id": "a1", "finding_ref": "f1", "disposition": "applied", "reason": "accepted_by_rules"}, {"application_id": "a2", "finding_ref": "f2", "disposition": "not_applied", "reason": "kind"}],
    "warnings": [], "errors": [],
}
FAILED = copy.deepcopy(VERIFICATION) | {
    "status": "failed", "calls": [call(1), call(2, outcome="failed", error_ref="e1")], "staging": [], "findings": [], "application_results": [],
    "errors": [{"error_id": "e1", "stage": "audio_verification", "code": "MODEL_CALL_FAILED"}],
    "local_chunking": {"source_bytes": 16_000_000, "parts": [
        {"chunk_id": "c1", "bytes": 9_000_000, "start_ms": 0, "end_ms": 10, "outcome": "completed", "call_ref": "call-1", "error_ref": None},
        {"chunk_id": "c2", "bytes": 6_000_000, "start_ms": 10, "end_ms": 20, "outcome": "failed", "call_ref": "call-2", "error_ref": "e1"},
        {"chunk_id": "c3", "bytes": 1_000_000, "start_ms": 20, "end_ms": 30, "outcome": "not_called", "call_ref": None, "error_ref": None},
    ]},
}
CLEANUP = copy.deepcopy(VERIFICATION) | {
    "status": "failed", "application_results": [{"application_id": f"a{k}", "finding_ref": f"f{k}", "disposition": "not_applied", "reason": "verification_failed"} for k in (1, 2)],
    "staging": [VERIFICATION["staging"][0] | {"cleanup_status": "failed", "error_ref": "e9"}],
    "errors": [{"error_id": "e9", "stage": "gcs_cleanup", "code": "GCS_CLEANUP_FAILED", "remediation": "delete it"}],
    "warnings": [{"warning_id": "w1", "code": "GCS_CLEANUP_FAILED", "stage": "gcs_cleanup", "severity": "high", "related_error_ref": "e9", "related_staging_ref": "st1"}],
}
CLEAN = {"transcript": [TRANSCRIPT], "calibration": [CALIBRATION, CALIBRATION | {"request": {"reference_srt_ref": None, "mode": None}}], "verification": [VERIFICATION, FAILED, CLEANUP]}


def put(path, value):
    """A change of one value, or the removal of a key."""

    def change(doc):
        *way, key = [int(k) if k.isdigit() else k for k in path.strip("/").split("/")]
        at = doc
        for k in way:
            at = at[k]
        if value is DROP:
            del at[key]
        else:
            at[key] = value

    return change


DROP = object()
ONE, LAST = "/segments/0", "/segments/1"
#: (rule, kind, clean document, changes, the paths of its issues).
CASES = [
    ("transcript-content-consistency", "transcript", TRANSCRIPT, [put("/full_text", "one two three")], ["/full_text"]),
    ("transcript-segment-order", "transcript", TRANSCRIPT, [put("/segments/1/index", 2), put("/segments/1/start_ms", 2400), put("/segments/1/words", [])], ["/segments/1/index", "/segments/1/start_ms"]),
    ("transcript-segment-time-ranges", "transcript", TRANSCRIPT, [put("/segments/0/end_ms", 0), put("/segments/0/words", []), put("/segments/1/end_ms", 5001)], [ONE, LAST]),
    ("transcript-word-time-ranges", "transcript", TRANSCRIPT, [put("/segments/0/words/1/start_ms", 800), put("/segments/1/words/0/index", 1), put("/segments/1/words/0/start_ms", 2400)], ["/segments/0/words/1", "/segments/1/words/0", "/segments/1/words/0/index"]),
    ("transcript-word-time-ranges", "transcript", TRANSCRIPT, [put("/segments/0/words/1/end_ms", 2501), put("/segments/1/words/0/end_ms", 2500)], ["/segments/0/words/1", "/segments/1/words/0"]),
    ("transcript-unique-ids", "transcript", TRANSCRIPT, [put("/segments/1/segment_id", "s1"), put("/segments/1/words/0/word_id", "w2")], ["/segments/1/segment_id", "/segments/*/words/2/word_id"]),
    ("transcript-call-success", "transcript", TRANSCRIPT, [put("/call/outcome", "failed")], ["/call/outcome"]),
    ("transcript-call-success", "transcript", TRANSCRIPT, [put("/errors", [{"error_id": "e"}])], ["/call/outcome"]),
    ("calibration-request-mode", "calibration", CALIBRATION, [put("/request/mode", None)], ["/request/mode"]),
    ("calibration-request-mode", "calibration", CLEAN["calibration"][1], [put("/request/mode", "text-only")], ["/request/mode"]),
    ("calibration-suggestion-time-ranges", "calibration", CALIBRATION, [put("/suggestions/1/end_ms", 5)], ["/suggestions/1"]),
    ("calibration-text-only-policy", "calibration", CALIBRATION, [put("/suggestions/0/kind", "segmentation"), put("/suggestions/1/kind", DROP)], ["/suggestions/0/kind", "/suggestions/1/kind"]),
    ("calibration-unique-ids", "calibration", CALIBRATION, [put("/suggestions/1/suggestion_id", "g1")], ["/suggestions/1/suggestion_id"]),
    ("calibration-completed-consistency", "calibration", CALIBRATION, [put("/call/error_ref", DROP)], ["/call"]),
    ("calibration-failed-consistency", "calibration", CALIBRATION | {"status": "failed", "suggestions": [], "call": call(outcome="failed", error_ref="e1")}, [put("/errors", [{"error_id": "e2"}]), put("/call/error_ref", "e3")], ["/call"]),
    ("calibration-failed-consistency", "calibration", CALIBRATION | {"call": call(outcome="failed", error_ref="e1"), "errors": [{"error_id": "e1"}]}, [put("/status", "failed")], ["/call"]),
    ("audio-verification-failed-consistency", "verification", VERIFICATION, [put("/status", "failed"), put("/application_results/0/disposition", "not_applied"), put("/application_results/1/reason", "verification_failed")], ["/errors", "/application_results/0"]),
    ("audio-verification-failed-consistency", "verification", FAILED, [put("/errors", [{"error_id": "e1", "stage": "gcs_upload"}, {"error_id": "e4", "stage": "parse"}])], ["/calls", "/errors/1"]),
    ("audio-verification-completed-consistency", "verification", VERIFICATION, [put("/calls/1/outcome", "failed"), put("/staging/0/cleanup_status", "pending")], ["/calls", "/staging"]),
    ("audio-verification-finding-time-ranges", "verification", VERIFICATION, [put("/findings/1/start_ms", 9)], ["/findings/1"]),
    ("audio-verification-application-links", "verification", VERIFICATION, [put("/application_results/1/finding_ref", "f1")], ["/application_results/1/finding_ref", "/application_results"]),
    ("audio-verification-application-links", "verification", VERIFICATION, [put("/application_results/0/finding_ref", "f8")], ["/application_results/0/finding_ref", "/application_results"]),
    ("audio-verification-application-policy", "verification", VERIFICATION, [put("/application_results/1/disposition", "applied")], ["/application_results/1"]),
    ("audio-verification-staging-call-links", "verification", VERIFICATION, [put("/staging/0/call_ref", "call-9")], ["/staging/0/call_ref"]),
    ("audio-verification-staging-call-links", "verification", VERIFICATION, [put("/staging/0/call_ref", None)], ["/staging/0/call_ref"]),
    ("audio-verification-staging-call-times", "verification", VERIFICATION, [put("/staging/0/created_at", t(11)), put("/staging/0/cleanup_finished_at", t(14))], ["/staging/0/created_at", "/staging/0/cleanup_finished_at"]),
    ("audio-verification-chunk-ranges", "verification", FAILED, [put("/local_chunking/parts/1/start_ms", 11), put("/local_chunking/parts/2/end_ms", 20), put("/local_chunking/source_bytes", 14_000_000)], ["/local_chunking/parts/1", "/local_chunking/parts/2", "/local_chunking/source_bytes", "/local_chunking/parts"]),
    ("audio-verification-chunk-links", "verification", FAILED, [put("/local_chunking/parts/0/outcome", "not_called")], ["/local_chunking/parts/1", "/calls"]),
    ("audio-verification-chunk-links", "verification", FAILED, [put("/local_chunking/parts/1/call_ref", "call-1")], ["/local_chunking/parts/1/call_ref", "/calls"]),
    ("audio-verification-chunk-links", "verification", FAILED, [put("/local_chunking/parts/0/error_ref", "e7")], ["/local_chunking/parts/0", "/local_chunking/parts/0/error_ref"]),
    ("audio-verification-chunk-local-only", "verification", FAILED, [put("/status", "skipped"), put("/staging", [{"staging_id": "x", "call_ref": "call-1"}])], ["/staging", "/local_chunking"]),
    ("audio-verification-chunk-completed-status", "verification", FAILED, [put("/status", "completed")], ["/local_chunking/parts"]),
    ("audio-verification-chunk-failed-status", "verification", FAILED, [put("/local_chunking/parts/0/outcome", "failed")], ["/local_chunking/parts"]),
    ("audio-verification-chunk-failed-status", "verification", FAILED, [put("/local_chunking/parts/1/outcome", "completed")], ["/local_chunking/parts"]),
    ("audio-verification-unique-ids", "verification", VERIFICATION, [put("/calls/1/call_id", "call-1"), put("/calls/1/provider_request_id", "req-1"), put("/findings/1/finding_id", "f1"), put("/application_results/1/application_id", "a1")], ["/calls/1/call_id", "/calls/1/provider_request_id", "/findings/1/finding_id", "/application_results/1/application_id"]),
    ("audio-verification-unique-ids", "verification", FAILED, [put("/local_chunking/parts/2/chunk_id", "c1")], ["/local_chunking/parts/2/chunk_id"]),
    ("audio-verification-cleanup-consistency", "verification", CLEANUP, [put("/warnings/0/severity", "low")], ["/staging/0/error_ref"]),
    ("audio-verification-cleanup-consistency", "verification", CLEANUP, [put("/errors/0/resource_uri", "gs://b/1")], ["/staging/0/error_ref"]),
    ("audio-verification-cleanup-consistency", "verification", CLEANUP, [put("/staging/0/staging_kind", "gemini_file")], ["/staging/0/error_ref"]),
    ("call-record-time-consistency", "verification", VERIFICATION, [put("/calls/1/ended_at", t(19))], ["/calls/1/ended_at"]),
    ("call-record-time-consistency", "transcript", TRANSCRIPT, [put("/call/ended_at", t(9))], ["/call/ended_at"]),
    ("artifact-created-after-terminal-records", "verification", VERIFICATION, [put("/created_at", t(39))], ["/created_at"]),
    ("artifact-created-after-terminal-records", "transcript", TRANSCRIPT, [put("/created_at", t(14))], ["/created_at"]),
    ("artifact-diagnostic-links", "verification", CLEANUP, [put("/warnings/0/related_error_ref", "e0"), put("/warnings/0/related_staging_ref", "st0"), put("/calls/0/error_ref", "e8"), put("/staging/0/error_ref", "e5")], ["/warnings/0/related_error_ref", "/warnings/0/related_staging_ref", "/calls/0/error_ref", "/staging/0/error_ref"]),
    ("artifact-diagnostic-links", "transcript", TRANSCRIPT, [put("/call/error_ref", "e1"), put("/errors", [{"error_id": "e2"}, {"error_id": "e2"}])], ["/calls/0/error_ref", "/errors/1/error_id"]),
    ("staging-time-consistency", "verification", VERIFICATION, [put("/staging/0/cleanup_finished_at", t(0))], ["/staging/0/cleanup_finished_at"]),
    ("document", "transcript", None, [], ["/"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"clean/{kind}/{i}", kind, json.dumps(doc)) for kind, docs in CLEAN.items() for i, doc in enumerate(docs)]
    for i, (_, kind, clean, changes, _) in enumerate(CASES):
        doc = copy.deepcopy(clean)
        for change in changes:
            change(doc)
        rows.append((f"case/{i}", kind, json.dumps(doc) if doc else "{not json"))
    out = {}
    for r in D.issues(spark.createDataFrame(rows, "doc_id string, kind string, body string")).collect():
        out.setdefault(r["doc_id"], {}).setdefault(r["check"], set()).add(r["path"])
    return out


def test_clean_documents_have_no_issue(found):
    assert {k: v for k, v in found.items() if k.startswith("clean")} == {}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rule_finds_the_paths(found, i):
    rule, _, _, _, paths = CASES[i]
    assert found.get(f"case/{i}", {}).get(rule, set()) == set(paths), found.get(f"case/{i}")


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(D.RULES)


def test_odd_documents(spark):
    rows = [(1, "transcript", "null"), (2, "verification", "[]"), (3, None, None), (4, "verification", '{"calls": 5, "staging": {"a": 1}, "errors": [1, null, "x", []], "warnings": null}'), (5, "transcript", json.dumps(TRANSCRIPT)), (5, "transcript", json.dumps(TRANSCRIPT))]
    D.issues(spark.createDataFrame(rows, "doc_id long, kind string, body string")).collect()
    assert D.issues(spark.createDataFrame([], "doc_id long, kind string, body string")).count() == 0


def test_documents_and_their_rules_broadcast_nothing(spark):
    """Lists of a document, and relations of which a rule reads few columns, are taken for small whatever their size."""
    made = contracts.documents(spark, "/root/testdata/sf0.001")
    for df in (made, D.issues(made.where("kind = 'verification'"))):
        plan = str(df._jdf.queryExecution().executedPlan())
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
