"""Contract rules on nested documents, with the path of each issue.

A document is a row (doc_id, kind, body) whose body is JSON: a transcript, a calibration or a verification. The bodies are
parsed once, to VARIANT, and written; a relation unfolds one list of all documents, each row with its place, its path and
what the rules compare. Rules are the tests of `validate` over these relations, so a rule is a scan or a shuffle on the
document and a key, whatever a document's size, and an issue is a row (doc_id, check, path).

A body that isn't JSON has the one issue `document` at its root. Values are read by type: a value that can't be read as the wanted type
counts as missing, and what is missing breaks no rule about its value. A list that isn't one is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import validate as V
from cuelake.operators.validate import Exists, Group, Over, Pair, Unique, Where
from cuelake.sources.storage import fresh

#: Largest audio that is sent in one part; fixed value.
PART_BYTES = 15_000_000

_TEXT, _NUMBER, _TIME, _NULL, _ANY = "string", "double", "time", "null", "any"

#: relation -> (lists to unfold, name -> (place in the item, type)). `null`: whether it is there as null.
RELATIONS: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]] = {
    "document": ((), {
        "full_text": ("$.full_text", _TEXT), "call_outcome": ("$.call.outcome", _TEXT), "call_error": ("$.call.error_ref", _TEXT), "call_error_null": ("$.call.error_ref", _NULL),
        "reference_null": ("$.request.reference_srt_ref", _NULL), "mode_null": ("$.request.mode", _NULL), "created_at": ("$.created_at", _TIME),
        "source_bytes": ("$.local_chunking.source_bytes", _NUMBER), "local": ("$.local_chunking.parts", _ANY),
    }),
    "segment": (("segments",), {"idx": ("$.index", _NUMBER), "start_ms": ("$.start_ms", _NUMBER), "end_ms": ("$.end_ms", _NUMBER), "segment_id": ("$.segment_id", _TEXT)}),
    "word": (("segments", "words"), {"idx": ("$.index", _NUMBER), "start_ms": ("$.start_ms", _NUMBER), "end_ms": ("$.end_ms", _NUMBER), "word_id": ("$.word_id", _TEXT)}),
    "suggestion": (("suggestions",), {"start_ms": ("$.start_ms", _NUMBER), "end_ms": ("$.end_ms", _NUMBER), "kind_of": ("$.kind", _TEXT), "suggestion_id": ("$.suggestion_id", _TEXT)}),
    "finding": (("findings",), {"start_ms": ("$.start_ms", _NUMBER), "end_ms": ("$.end_ms", _NUMBER), "finding_kind": ("$.kind", _TEXT), "finding_id": ("$.finding_id", _TEXT)}),
    "application": (("application_results",), {"finding_ref": ("$.finding_ref", _TEXT), "disposition": ("$.disposition", _TEXT), "reason": ("$.reason", _TEXT), "application_id": ("$.application_id", _TEXT)}),
    "call": (("calls",), {
        "call_id": ("$.call_id", _TEXT), "provider_request_id": ("$.provider_request_id", _TEXT), "outcome": ("$.outcome", _TEXT), "error_ref": ("$.error_ref", _TEXT),
        "call_started": ("$.started_at", _TIME), "call_ended": ("$.ended_at", _TIME),
    }),
    "staging": (("staging",), {
        "staging_id": ("$.staging_id", _TEXT), "object_uri": ("$.object_uri", _TEXT), "staging_kind": ("$.staging_kind", _TEXT), "call_ref": ("$.call_ref", _TEXT), "call_ref_null": ("$.call_ref", _NULL),
        "cleanup_status": ("$.cleanup_status", _TEXT), "error_ref": ("$.error_ref", _TEXT), "staged_at": ("$.created_at", _TIME), "cleaned_at": ("$.cleanup_finished_at", _TIME),
    }),
    "error": (("errors",), {"error_id": ("$.error_id", _TEXT), "stage": ("$.stage", _TEXT), "code": ("$.code", _TEXT), "remediation": ("$.remediation", _TEXT), "resource_uri": ("$.resource_uri", _ANY)}),
    "warning": (("warnings",), {
        "warning_id": ("$.warning_id", _TEXT), "code": ("$.code", _TEXT), "stage": ("$.stage", _TEXT), "severity": ("$.severity", _TEXT), "related_error": ("$.related_error_ref", _TEXT), "related_staging": ("$.related_staging_ref", _TEXT),
    }),
    "part": (("local_chunking.parts",), {
        "chunk_id": ("$.chunk_id", _TEXT), "bytes": ("$.bytes", _NUMBER), "start_ms": ("$.start_ms", _NUMBER), "end_ms": ("$.end_ms", _NUMBER),
        "outcome": ("$.outcome", _TEXT), "call_ref": ("$.call_ref", _TEXT), "error_ref": ("$.error_ref", _TEXT),
    }),
}


def _read(item: str, place: str, kind: str) -> str:
    if kind == _TIME:
        return f"try_to_timestamp(try_variant_get({item}, '{place}', 'string'))"
    if kind == _NULL:
        return f"coalesce(is_variant_null(try_variant_get({item}, '{place}', 'variant')), FALSE)"
    if kind == _ANY:
        return f"try_variant_get({item}, '{place}', 'variant') IS NOT NULL"
    return f"try_variant_get({item}, '{place}', '{kind}')"


#: What every relation has of its document.
_ROOT = {"status": ("$.status", _TEXT), "mode": ("$.request.mode", _TEXT), "duration_ms": ("$.audio.duration_ms", _NUMBER)}
_LIST = "coalesce(try_variant_get({}, '$.{}', 'array<variant>'), array())"


#: A document has one call, or a list of them.
_CALLS = "CASE WHEN schema_of_variant(try_variant_get(item, '$.call', 'variant')) LIKE 'OBJECT%' THEN array(try_variant_get(item, '$.call', 'variant')) ELSE " + _LIST.format("item", "calls") + " END"


def unfold(parsed: DataFrame, name: str) -> DataFrame:
    """One relation of parsed documents (doc_id, kind, doc): (doc_id, kind, status, mode, duration_ms, at, path, columns); words also have their segment's."""
    lists, columns = RELATIONS[name]
    rows = parsed.select("doc_id", "kind", *[F.expr(_read("doc", *c)).alias(k) for k, c in _ROOT.items()], F.col("doc").alias("item"), F.lit("").alias("path"), F.lit(0).alias("at"))
    base = ["doc_id", "kind", *_ROOT]
    for depth, at in enumerate(lists):
        outer = [F.col("at").alias("parent_at"), F.expr(_read("item", "$.start_ms", _NUMBER)).alias("parent_start"), F.expr(_read("item", "$.end_ms", _NUMBER)).alias("parent_end")] if depth else []
        more = ["parent_at", "parent_start", "parent_end"][: 3 * bool(depth)]
        step = F.concat(F.lit(f"/{at.replace('.', '/')}/"), F.col("at").cast("string"))
        if name == "call":
            more, outer, step = ["single"], [F.expr("schema_of_variant(try_variant_get(item, '$.call', 'variant')) LIKE 'OBJECT%'").alias("single")], F.when(F.col("single"), "/call").otherwise(step)
        rows = rows.select(*base, *outer, "path", F.posexplode(F.expr(_CALLS if name == "call" else _LIST.format("item", at))).alias("at", "item"))
        rows = rows.select(*base, *more, "at", "item", F.concat("path", step).alias("path"))
    own = [F.expr(_read("item", *c)).alias(k) for k, c in columns.items()]
    if name == "document":
        own.append(F.expr("array_join(transform(" + _LIST.format("item", "segments") + ", s -> coalesce(try_variant_get(s, '$.text', 'string'), '')), '\\n')").alias("joined"))
        sizes = {"errors": "errors", "suggestions": "suggestions", "staging": "staging", "calls": "calls", "parts": "local_chunking.parts"}
        own += [F.size(F.expr(_LIST.format("item", at))).alias(f"n_{n}") for n, at in sizes.items()]
    return rows.select(*[c for c in rows.columns if c != "item"], *own)


def frames(documents: DataFrame):
    """A function from a relation's name to its rows. The bodies are parsed once and each list is unfolded once; both are written.
    Their joins are sorted: of a relation's file a rule reads two or three columns, which Spark takes for so small that it would
    broadcast millions of rows, for all rules at once."""
    spark, paths = documents.sparkSession, {}

    def written(name: str, rows: DataFrame) -> DataFrame:
        if name not in paths:
            paths[name] = fresh(spark, f"documents-{name}")
            rows.write.parquet(paths[name])
        return spark.read.parquet(paths[name]).hint("merge")

    parsed = written("parsed", documents.select("doc_id", "kind", F.try_parse_json("body").alias("doc")))

    def last(name: str, key: str, columns: dict[str, str]) -> DataFrame:
        """Of the rows of a key the last one counts."""
        row = F.max_by(F.struct(*[F.col(c).alias(k) for c, k in columns.items()]), "at").alias("r")
        return get(name).where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(row).select("doc_id", key, "r.*")

    def failed_cleanup() -> DataFrame:
        """Each with the first error of its id, and the number of warnings that tell of it."""
        own = F.col("staging_kind") == "gemini_file"
        rows = get("staging").where("cleanup_status = 'failed' AND error_ref IS NOT NULL").select(
            "doc_id", "path", "staging_id", "error_ref", F.when(own, "staging_cleanup").otherwise("gcs_cleanup").alias("want_stage"), F.when(own, "STAGING_CLEANUP_FAILED").otherwise("GCS_CLEANUP_FAILED").alias("want_code")
        )
        keys = {"staging_id": "related_staging", "error_ref": "related_error", "want_stage": "stage", "want_code": "code"}
        told = get("warning").where("severity = 'high'").groupBy("doc_id", *[F.col(c).alias(k) for k, c in keys.items()]).agg(F.count("*").alias("told"))
        first = get("error").where("error_id IS NOT NULL").groupBy("doc_id", F.col("error_id").alias("error_ref")).agg(F.min_by(F.struct("stage", "code", "remediation", "resource_uri"), "at").alias("r"))
        return rows.join(told, ["doc_id", *keys], "left").join(first.select("doc_id", "error_ref", "r.*"), ["doc_id", "error_ref"], "left")

    def linked() -> DataFrame:
        """Errors that a failed call or clean-up names."""
        calls = get("call").where("outcome = 'failed'").select("doc_id", "error_ref")
        return calls.union(get("staging").where("cleanup_status = 'failed'").select("doc_id", "error_ref")).where("error_ref IS NOT NULL").distinct()

    derived = {
        "unread": lambda: parsed.where("doc IS NULL").select("doc_id"),
        "loose": lambda: get("error").where("error_id IS NOT NULL").join(linked().withColumnRenamed("error_ref", "error_id"), ["doc_id", "error_id"], "left_anti"),
        "reason_to_fail": lambda: get("call").where("outcome = 'failed'").select("doc_id").union(get("staging").where("cleanup_status = 'failed'").select("doc_id")).union(get("loose").where(_UPLOAD).select("doc_id")).distinct(),
        "upload_failure": lambda: get("error").where(_UPLOAD).select("doc_id").distinct(),
        "known_call": lambda: last("call", "call_id", {"outcome": "call_outcome", "error_ref": "call_error", "call_started": "call_started", "call_ended": "call_ended"}),
        "known_finding": lambda: last("finding", "finding_id", {"finding_kind": "finding_kind"}),
        "some_call": lambda: get("known_call").select("doc_id").distinct(),
        "applied": lambda: get("application").where("disposition = 'applied'").withColumnRenamed("finding_ref", "finding_id"),
        "linked_application": lambda: get("application").join(get("known_finding").select("doc_id", F.col("finding_id").alias("finding_ref")), ["doc_id", "finding_ref"], "left_semi"),
        "null_staging": lambda: get("staging").where("call_ref_null"),
        "called_staging": lambda: get("staging").where("call_ref IS NOT NULL").withColumnRenamed("call_ref", "call_id"),
        "failed_cleanup": failed_cleanup,
        "part_bytes": lambda: get("part").groupBy("doc_id").agg(F.sum("bytes").alias("part_bytes"), F.count_if(F.col("bytes").isNull()).alias("lacking")).where("lacking = 0"),
        "failed_parts": lambda: get("part").where("outcome = 'failed'").groupBy("doc_id").agg(F.count("*").alias("n_failed")),
        "called_part": lambda: get("part").where("outcome IS NULL OR outcome <> 'not_called'").join(get("known_call").withColumnRenamed("call_id", "call_ref"), ["doc_id", "call_ref"], "left"),
        "first_called": lambda: get("called_part").where("call_outcome IS NOT NULL").withColumn("nth", F.expr("row_number() OVER (PARTITION BY doc_id, call_ref ORDER BY at)")).where("nth = 1"),
        "local_call": lambda: get("known_call").join(get("document").where("local").select("doc_id"), "doc_id", "left_semi"),
        "creation": lambda: get("document").select("doc_id", "created_at"),
    }

    def get(name: str) -> DataFrame:
        return derived[name]().hint("merge") if name in derived else written(name, unfold(parsed, name))

    return get


def _at(path: str) -> str:
    return f"named_struct('doc_id', doc_id, 'path', {path})"


_P, _UPLOAD = _at("path"), "stage IN ('gcs_upload', 'staging_upload')"
_BEFORE = "lag({0}) OVER (PARTITION BY doc_id ORDER BY at)"
_DOC = ("doc_id", "doc_id")


def _unique(table: str, key: str) -> Unique:
    return Unique(table, ("doc_id", key), "at", _at(f"path || '/{key}'"))


def _range(table: str) -> Where:
    return Where(table, "start_ms >= end_ms", _P)


#: A rule's name -> its tests.
RULES: dict[str, list[V.Test]] = {
    "document": [Where("unread", "TRUE", _at("'/'"))],
    "transcript-content-consistency": [Where("document", "kind = 'transcript' AND NOT (full_text <=> joined)", _at("'/full_text'"))],
    "transcript-segment-order": [
        Where("segment", "NOT (idx <=> CAST(at AS DOUBLE))", _at("path || '/index'")),
        Over("segment", (("before", _BEFORE.format("end_ms")),), "start_ms < before", _at("path || '/start_ms'")),
    ],
    "transcript-segment-time-ranges": [_range("segment"), Where("segment", "start_ms IS NOT NULL AND end_ms > duration_ms", _P)],
    "transcript-word-time-ranges": [
        _range("word"),
        Where("word", "start_ms IS NOT NULL AND end_ms > parent_end", _P),
        Where("word", "NOT (idx <=> CAST(at AS DOUBLE))", _at("path || '/index'")),
        Over("word", (("before", "coalesce(last_value(end_ms) IGNORE NULLS OVER (PARTITION BY doc_id, parent_at ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), parent_start, 0)"),), "start_ms < coalesce(parent_start, 0) OR start_ms < before", _P),
    ],
    "transcript-unique-ids": [
        _unique("segment", "segment_id"),
        Over("word", (("flat", "row_number() OVER (PARTITION BY doc_id ORDER BY parent_at, at) - 1"), ("nth", "row_number() OVER (PARTITION BY doc_id, word_id ORDER BY parent_at, at)")), "word_id IS NOT NULL AND nth > 1", _at("'/segments/*/words/' || flat || '/word_id'")),
    ],
    "transcript-call-success": [Where("document", "kind = 'transcript' AND NOT (call_outcome <=> 'completed' AND n_errors = 0)", _at("'/call/outcome'"))],
    "calibration-request-mode": [Where("document", "kind = 'calibration' AND reference_null <> mode_null", _at("'/request/mode'"))],
    "calibration-suggestion-time-ranges": [_range("suggestion")],
    "calibration-text-only-policy": [Where("suggestion", "mode = 'text-only' AND NOT (kind_of <=> 'text_correction')", _at("path || '/kind'"))],
    "calibration-unique-ids": [_unique("suggestion", "suggestion_id")],
    "calibration-completed-consistency": [Where("document", "kind = 'calibration' AND status = 'completed' AND NOT (call_outcome <=> 'completed' AND call_error_null AND n_errors = 0)", _at("'/call'"))],
    "calibration-failed-consistency": [
        Where("document", "kind = 'calibration' AND status = 'failed' AND NOT (call_outcome <=> 'failed' AND call_error IS NOT NULL AND n_suggestions = 0)", _at("'/call'")),
        Exists("document", "error", (_DOC, ("call_error", "error_id")), _at("'/call'"), where="kind = 'calibration' AND status = 'failed' AND call_error IS NOT NULL"),
    ],
    "audio-verification-failed-consistency": [
        Exists("document", "reason_to_fail", (_DOC,), _at("'/errors'"), where="kind = 'verification' AND status = 'failed'"),
        Pair("document", "upload_failure", ("doc_id",), "kind = 'verification' AND status = 'failed' AND n_calls > 0", _at("'/calls'")),
        Where("loose", f"kind = 'verification' AND status = 'failed' AND NOT coalesce({_UPLOAD}, FALSE)", _P),
        Where("application", "status = 'failed' AND NOT (disposition <=> 'not_applied' AND reason <=> 'verification_failed')", _P),
    ],
    "audio-verification-completed-consistency": [
        Where("document", "kind = 'verification' AND status = 'completed' AND n_calls = 0", _at("'/calls'")),
        Where("call", "status = 'completed' AND NOT (outcome <=> 'completed')", _at("'/calls'")),
        Where("staging", "status = 'completed' AND NOT (cleanup_status <=> 'completed')", _at("'/staging'")),
    ],
    "audio-verification-finding-time-ranges": [_range("finding")],
    "audio-verification-application-links": [
        Exists("application", "finding", (_DOC, ("finding_ref", "finding_id")), _at("path || '/finding_ref'")),
        Unique("linked_application", ("doc_id", "finding_ref"), "at", _at("path || '/finding_ref'")),
        Exists("finding", "application", (_DOC, ("finding_id", "finding_ref")), _at("'/application_results'"), where="finding_id IS NOT NULL"),
    ],
    "audio-verification-application-policy": [Pair("applied", "known_finding", ("doc_id", "finding_id"), "status = 'failed' OR finding_kind = 'translation'", _P)],
    "audio-verification-staging-call-links": [
        Exists("staging", "known_call", (_DOC, ("call_ref", "call_id")), _at("path || '/call_ref'"), where="NOT call_ref_null"),
        Pair("null_staging", "some_call", ("doc_id",), "TRUE", _at("path || '/call_ref'")),
    ],
    "audio-verification-staging-call-times": [
        Pair("called_staging", "known_call", ("doc_id", "call_id"), "staged_at > call_started", _at("path || '/created_at'")),
        Pair("called_staging", "known_call", ("doc_id", "call_id"), "cleaned_at < call_ended", _at("path || '/cleanup_finished_at'")),
    ],
    "audio-verification-chunk-ranges": [
        Pair("document", "part_bytes", ("doc_id",), "NOT (source_bytes <=> part_bytes)", _at("'/local_chunking/source_bytes'")),
        Where("document", f"local AND (source_bytes > {PART_BYTES}) <> (n_parts > 1)", _at("'/local_chunking/parts'")),
        Over("part", (("before", _BEFORE.format("end_ms")),), "at = 0 AND NOT (start_ms <=> 0D) OR at > 0 AND NOT (start_ms <=> before) OR end_ms <= start_ms", _P),
    ],
    "audio-verification-chunk-links": [
        Over("part", (("stopped", "max(CASE WHEN outcome = 'not_called' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY at)"),), "stopped = 1 AND NOT (outcome <=> 'not_called')", _P),
        Over("called_part", (("nth", "row_number() OVER (PARTITION BY doc_id, call_ref ORDER BY at)"),), "call_ref IS NULL OR call_outcome IS NULL OR nth > 1", _at("path || '/call_ref'")),
        Over("called_part", (("nth", "row_number() OVER (PARTITION BY doc_id, call_ref ORDER BY at)"),), "call_outcome IS NOT NULL AND nth = 1 AND NOT (outcome <=> call_outcome AND error_ref <=> call_error)", _P),
        Exists("first_called", "error", (_DOC, ("error_ref", "error_id")), _at("path || '/error_ref'"), where="error_ref IS NOT NULL"),
        Exists("local_call", "called_part", (_DOC, ("call_id", "call_ref")), _at("'/calls'")),
    ],
    "audio-verification-chunk-local-only": [
        Where("document", "local AND n_staging > 0", _at("'/staging'")),
        Where("document", "local AND n_parts > 0 AND status IN ('not_requested', 'skipped')", _at("'/local_chunking'")),
    ],
    "audio-verification-chunk-completed-status": [Where("part", "status = 'completed' AND NOT (outcome <=> 'completed')", _at("'/local_chunking/parts'"))],
    "audio-verification-chunk-failed-status": [
        Pair("document", "failed_parts", ("doc_id",), "local AND status = 'failed' AND coalesce(n_failed, 0) <> 1", _at("'/local_chunking/parts'"), left=True),
    ],
    "audio-verification-unique-ids": [
        _unique("finding", "finding_id"), _unique("application", "application_id"), _unique("call", "call_id"), _unique("call", "provider_request_id"), _unique("staging", "staging_id"),
        _unique("staging", "object_uri"), _unique("part", "chunk_id"),
    ],
    "audio-verification-cleanup-consistency": [
        Where("failed_cleanup", "NOT (stage <=> want_stage AND code <=> want_code AND remediation IS NOT NULL AND NOT coalesce(resource_uri, FALSE) AND coalesce(told, 0) = 1)", _at("path || '/error_ref'")),
    ],
    "call-record-time-consistency": [Where("call", "call_ended < call_started", _at("path || '/ended_at'"))],
    "artifact-created-after-terminal-records": [
        Pair("call", "creation", ("doc_id",), "call_ended > created_at", _at("'/created_at'")),
        Pair("staging", "creation", ("doc_id",), "cleaned_at > created_at", _at("'/created_at'")),
    ],
    "artifact-diagnostic-links": [
        _unique("error", "error_id"), _unique("warning", "warning_id"),
        Exists("warning", "error", (_DOC, ("related_error", "error_id")), _at("path || '/related_error_ref'"), where="related_error IS NOT NULL"),
        Exists("warning", "staging", (_DOC, ("related_staging", "staging_id")), _at("path || '/related_staging_ref'"), where="related_staging IS NOT NULL"),
        Exists("call", "error", (_DOC, ("error_ref", "error_id")), _at("'/calls/' || at || '/error_ref'"), where="error_ref IS NOT NULL"),
        Exists("staging", "error", (_DOC, ("error_ref", "error_id")), _at("path || '/error_ref'"), where="error_ref IS NOT NULL"),
    ],
    "staging-time-consistency": [Where("staging", "cleaned_at < staged_at", _at("path || '/cleanup_finished_at'"))],
}


def issues(documents: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(doc_id, check, path) of all issues of documents (doc_id, kind, body), each once."""
    get, chosen = frames(documents), RULES if rules is None else {r: RULES[r] for r in rules}
    found = [t.refs(get).select(F.lit(name).alias("check"), "ref") for name, tests in chosen.items() for t in tests]
    return reduce(DataFrame.unionByName, found).select("ref.doc_id", "check", "ref.path").distinct()
