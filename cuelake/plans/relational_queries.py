"""Joins, windows, aggregates, orders and sets over the derived relations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import relational as R
from cuelake.operators import terms as TM
from cuelake.plans import workload as D
from cuelake.plans.registry import query
from cuelake.plans.workload import sql

KEY = ("task_id", "idx")


# --- joins -----------------------------------------------------------------------------------------------


@query("jn1_suggestion_segments", sql("SELECT s.task_id, suggestion_id, g.idx AS segment_idx, g.idx IS NULL AS missing FROM suggestions s LEFT JOIN segments g ON g.task_id = s.task_id AND g.segment_id = s.segment_ref"))
def jn1(spark, d):
    cues = D.segments(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"), F.col("idx").alias("segment_idx"))
    return D.suggestions(spark, d).join(cues, ["task_id", "segment_ref"], "left").select("task_id", "suggestion_id", "segment_idx", F.col("segment_idx").isNull().alias("missing"))


@query("jn1_missing_references", sql("SELECT s.task_id, suggestion_id, segment_ref FROM suggestions s WHERE NOT EXISTS (SELECT 1 FROM segments g WHERE g.task_id = s.task_id AND g.segment_id = s.segment_ref)"))
def jn1_missing(spark, d):
    cues = D.segments(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"))
    return D.suggestions(spark, d).join(cues, ["task_id", "segment_ref"], "left_anti").select("task_id", "suggestion_id", "segment_ref")


def _relations(spark, d):
    """Each cue relates to the reference cue of the same number, and every fourth to the next one as well."""
    cues = D.segments(spark, d)
    refs = F.when(F.col("idx") % 4 == 0, F.array(F.col("idx"), F.col("idx") + 1)).otherwise(F.array("idx"))
    return cues.select("task_id", F.col("idx").alias("pos"), F.array("segment_id").alias("asr_refs"), F.transform(refs, lambda x: F.format_string("reference-%04d", x + 1)).alias("reference_refs"), "start_ms", "end_ms")


_RELATIONS = """, relations AS (
  SELECT task_id, idx AS pos, [segment_id] AS asr_refs, CASE WHEN idx % 4 = 0 THEN [printf('reference-%04d', idx + 1), printf('reference-%04d', idx + 2)] ELSE [printf('reference-%04d', idx + 1)] END AS reference_refs, start_ms, end_ms FROM segments
)"""


@query("jn2_unit_references", f"WITH {D.SQL}{_RELATIONS} SELECT g.task_id, g.segment_id, list_distinct(flatten(list(r.reference_refs ORDER BY r.pos))) AS reference_refs FROM segments g JOIN relations r ON r.task_id = g.task_id AND list_contains(r.asr_refs, g.segment_id) GROUP BY ALL".replace("list_distinct(", "list_sort(list_distinct(").replace("r.pos)))", "r.pos))))"))
def jn2(spark, d):
    each = _relations(spark, d).select("task_id", "pos", F.explode("asr_refs").alias("segment_id"), "reference_refs")
    joined = D.segments(spark, d).select("task_id", "segment_id").join(each, ["task_id", "segment_id"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "reference_refs")))
    refs = F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["reference_refs"])))
    return joined.groupBy("task_id", "segment_id").agg(F.sort_array(refs).alias("reference_refs"))


@query("jn3_unit_completeness", f"WITH {D.SQL}" + ("""
, input AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY idx) AS pos, segment_id FROM segments),
returned AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY idx) AS pos, segment_id FROM segments WHERE (task_id + idx) % 17 <> 0)
SELECT coalesce(i.task_id, r.task_id) AS task_id, count(*) FILTER (i.segment_id IS DISTINCT FROM r.segment_id)::BIGINT AS wrong, count(i.pos) AS expected, count(r.pos) AS got
FROM input i FULL JOIN returned r ON r.task_id = i.task_id AND r.pos = i.pos GROUP BY 1"""))
def jn3(spark, d):
    """Returned units must be the sent ones, in order: a full join by position."""
    def placed(df, name):
        return df.select("task_id", F.row_number().over(R.in_order()).alias("pos"), F.col("segment_id").alias(name))

    sent, back = placed(D.segments(spark, d), "sent"), placed(D.segments(spark, d).where("(task_id + idx) % 17 <> 0"), "back")
    return sent.join(back, ["task_id", "pos"], "full").groupBy("task_id").agg(
        F.count_if(~F.col("sent").eqNullSafe(F.col("back"))).alias("wrong"), F.count("sent").alias("expected"), F.count("back").alias("got")
    )


@query("jn4_mapped_references", f"WITH {D.SQL}{_RELATIONS} SELECT s.task_id, s.suggestion_id, list_sort(list_distinct(flatten(list(r.reference_refs)))) AS refs FROM suggestions s JOIN relations r ON r.task_id = s.task_id AND list_contains(r.asr_refs, s.segment_ref) AND r.end_ms > s.start_ms AND r.start_ms < s.end_ms GROUP BY ALL")
def jn4(spark, d):
    each = _relations(spark, d).select("task_id", F.explode("asr_refs").alias("segment_ref"), "reference_refs", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    joined = D.suggestions(spark, d).join(each, ["task_id", "segment_ref"]).where("re > start_ms AND rs < end_ms")
    return joined.groupBy("task_id", "suggestion_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("reference_refs")))).alias("refs"))


@query("jn5_mapped_sources", f"WITH {D.SQL}{_RELATIONS} SELECT task_id, ref, list_sort(list_distinct(flatten(list(asr_refs)))) AS asr_refs FROM (SELECT task_id, asr_refs, unnest(reference_refs) AS ref FROM relations) GROUP BY ALL")
def jn5(spark, d):
    each = _relations(spark, d).select("task_id", F.explode("reference_refs").alias("ref"), "asr_refs")
    return each.groupBy("task_id", "ref").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("asr_refs")))).alias("asr_refs"))


@query("jn8_finding_segments", sql("SELECT f.task_id, finding_id, segment_id FROM findings f JOIN segments s ON s.task_id = f.task_id AND s.start_ms < f.end_ms AND s.end_ms > f.start_ms"))
def jn8(spark, d):
    return R.overlapping(D.findings(spark, d), D.segments(spark, d)).select("task_id", "finding_id", "segment_id")


@query("jn8_long_spans", sql("SELECT s.task_id, s.segment_id, count(*) AS findings, max(f.end_ms) AS last_end FROM (SELECT task_id, segment_id, start_ms, start_ms + 600000 AS end_ms FROM segments) s JOIN findings f ON f.task_id = s.task_id AND f.start_ms < s.end_ms AND f.end_ms > s.start_ms GROUP BY ALL"))
def jn8_long(spark, d):
    """The findings of the ten minutes from each cue on."""
    spans = D.segments(spark, d).select("task_id", "segment_id", "start_ms", (F.col("start_ms") + 600_000).alias("end_ms"))
    pairs = R.overlapping_any_length(spans, D.findings(spark, d))
    return pairs.groupBy("task_id", "segment_id").agg(F.count("*").alias("findings"), F.max("r_end_ms").alias("last_end"))


@query("jn9_chunk_evidence", sql("SELECT f.task_id, finding_id, string_agg(segment_id || ': ' || text, chr(10) ORDER BY idx) AS evidence FROM findings f JOIN segments s ON s.task_id = f.task_id AND s.start_ms < f.end_ms AND s.end_ms > f.start_ms GROUP BY ALL"))
def jn9(spark, d):
    pairs = R.overlapping(D.findings(spark, d), D.segments(spark, d))
    return pairs.groupBy("task_id", "finding_id").agg(R.ordered_text(F.concat("segment_id", F.lit(": "), "text"), F.col("idx")).alias("evidence"))


@query("jn10_findings_with_source", sql("SELECT task_id, finding_id FROM findings f WHERE EXISTS (SELECT 1 FROM segments s WHERE s.task_id = f.task_id AND s.start_ms < f.end_ms AND s.end_ms > f.start_ms AND s.idx % 2 = 0)"))
def jn10(spark, d):
    return R.overlapping(D.findings(spark, d), D.segments(spark, d).where("idx % 2 = 0")).select("task_id", "finding_id").distinct()


@query("jn11_changes", sql("""SELECT g.task_id, g.segment_id, max(s.suggestion_id) AS suggestion_id FROM segments g
JOIN suggestions s ON s.task_id = g.task_id AND s.start_ms = g.start_ms AND s.end_ms = g.end_ms AND s.original_text = split_part(g.text, ' ', 1) WHERE s.kind = 'text_correction' GROUP BY ALL"""))
def jn11(spark, d):
    """A changed unit finds its suggestion by times and text; of several the last one."""
    units = D.segments(spark, d).select("task_id", "segment_id", "start_ms", "end_ms", F.substring_index("text", " ", 1).alias("original_text"))
    last = D.suggestions(spark, d).where("kind = 'text_correction'").groupBy("task_id", "start_ms", "end_ms", "original_text").agg(F.max_by("suggestion_id", "idx").alias("suggestion_id"))
    return units.join(last, ["task_id", "start_ms", "end_ms", "original_text"]).select("task_id", "segment_id", "suggestion_id")


@query("jn12_unknown_dictionaries", sql("SELECT DISTINCT c_mktsegment, 'dict-' || (c_custkey % 60) AS selected FROM customer WHERE 'dict-' || (c_custkey % 60) NOT IN (SELECT dictionary_id FROM entries WHERE enabled)"))
def jn12(spark, d):
    selected = D.table(spark, d, "customer").select("c_mktsegment", F.concat(F.lit("dict-"), (F.col("c_custkey") % 60).cast("string")).alias("selected")).distinct()
    known = D.entries(spark, d).where("enabled").select(F.col("dictionary_id").alias("selected")).distinct()
    return selected.join(known, "selected", "left_anti").select("c_mktsegment", "selected")


_TERMS = ("the", "and", "tion", "eau", "heit", "ción", "that", "qui")


@query("jn13_term_matches", f"SELECT conv_id, turn, term FROM conversations, (SELECT unnest({list(_TERMS)!r}) AS term) WHERE contains(lower(text), term)")
def jn13(spark, d):
    """Terms contained in a text. The dictionary is a snapshot of at most ten thousand terms, so each text is searched where it is."""
    turns = D.table(spark, d, "conversations")
    found = F.filter(F.array(*[F.lit(t) for t in _TERMS]), lambda t: F.contains(F.lower("text"), t))
    return turns.select("conv_id", "turn", F.explode(found).alias("term"))


_HAS = "contains(CASE WHEN case_sensitive THEN x.text ELSE lower(x.text) END, CASE WHEN case_sensitive THEN form ELSE lower(form) END)"


@query("jn13_dictionary_matches", sql(f"SELECT DISTINCT conv_id, turn, entry_id FROM conversations x, dictionary_forms WHERE {_HAS}"))
def jn13_dictionary(spark, d):
    """Each turn and the entries of the dictionary that have a form in it, by either case policy."""
    return TM.term_matches(D.table(spark, d, "conversations"), ["conv_id", "turn"], D.dictionary_forms(spark, d))


@query("jn13_matched_entries", sql(f"SELECT task_id, count(DISTINCT entry_id)::BIGINT AS entries, min(entry_id) AS first_entry FROM (SELECT DISTINCT task_id, entry_id FROM segments x, dictionary_forms WHERE {_HAS}) GROUP BY task_id"))
def jn13_entries(spark, d):
    """The entries that a task's transcript calls for: no form has a line's end in it, so its cues are searched one by one."""
    return TM.entry_counts(D.segments(spark, d), ["task_id"], D.dictionary_forms(spark, d))


@query("jn14_import_diff", """SELECT coalesce(a.p_partkey, b.p_partkey) AS part, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.n = b.n THEN 'unchanged' ELSE 'updated' END AS change
FROM (SELECT p_partkey, p_name AS n FROM part WHERE p_partkey % 10 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END AS n FROM part WHERE p_partkey % 13 <> 0) b ON a.p_partkey = b.p_partkey""")
def jn14(spark, d):
    part = D.table(spark, d, "part")
    old = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("old"))
    new = part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("part"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return old.join(new, "part", "full").select("part", change.alias("change"))


@query("jn15_timeline_mapping", sql("SELECT a.task_id, count(*) FILTER (b.task_id IS NULL OR a.start_ms <> b.start_ms OR a.end_ms <> b.end_ms)::BIGINT AS differing FROM segments a LEFT JOIN (SELECT * FROM segments WHERE (task_id + idx) % 23 <> 0) b ON a.task_id = b.task_id AND a.idx = b.idx GROUP BY a.task_id"))
def jn15(spark, d):
    out = D.segments(spark, d).where("(task_id + idx) % 23 <> 0").select(*KEY, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    joined = D.segments(spark, d).join(out, list(KEY), "left")
    return joined.groupBy("task_id").agg(F.count_if(~(F.col("s").eqNullSafe(F.col("start_ms")) & F.col("e").eqNullSafe(F.col("end_ms")))).alias("differing"))


@query("jn16_finding_applications", sql("""
SELECT task_id, finding_id, 'unapplied' AS issue FROM findings WHERE start_ms % 15000 = 0
UNION ALL SELECT task_id, finding_id, 'applied_twice' FROM findings WHERE start_ms % 20000 = 5000 AND start_ms % 15000 <> 0"""))
def jn16(spark, d):
    """Each finding has exactly one application: an anti-join one way, a count the other."""
    found = D.findings(spark, d).select("task_id", "finding_id", "start_ms")
    times = F.when(F.col("start_ms") % 15_000 == 0, 0).when(F.col("start_ms") % 20_000 == 5_000, 2).otherwise(1)
    applied = found.select("task_id", "finding_id", F.explode(F.array_repeat(F.lit(1), times)).alias("n")).drop("n")
    missing = found.select("task_id", "finding_id").join(applied, ["task_id", "finding_id"], "left_anti").withColumn("issue", F.lit("unapplied"))
    twice = applied.groupBy("task_id", "finding_id").count().where("count > 1").select("task_id", "finding_id", F.lit("applied_twice").alias("issue"))
    return missing.unionByName(twice)


@query("jn21_dispositions", sql("SELECT s.task_id, s.suggestion_id, bool_or(g.segment_id IS NOT NULL AND s.kind = 'text_correction') AS applied, count(g.segment_id) AS modifications FROM suggestions s LEFT JOIN segments g ON g.task_id = s.task_id AND g.segment_id = s.segment_ref GROUP BY ALL"))
def jn21(spark, d):
    cues = D.segments(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"), F.lit(True).alias("hit"))
    joined = D.suggestions(spark, d).join(cues, ["task_id", "segment_ref"], "left")
    return joined.groupBy("task_id", "suggestion_id").agg(F.bool_or(F.col("hit").isNotNull() & (F.col("kind") == "text_correction")).alias("applied"), F.count("hit").alias("modifications"))


@query("jn23_reference_range", sql("SELECT s.task_id, s.suggestion_id, coalesce(min(w.start_ms), s.start_ms) AS range_start, coalesce(max(w.end_ms), s.end_ms) AS range_end FROM suggestions s LEFT JOIN words w ON w.task_id = s.task_id AND w.segment_id = s.segment_ref GROUP BY s.task_id, s.suggestion_id, s.start_ms, s.end_ms"))
def jn23(spark, d):
    spoken = D.words(spark, d).groupBy("task_id", F.col("segment_id").alias("segment_ref")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    return D.suggestions(spark, d).join(spoken, ["task_id", "segment_ref"], "left").select("task_id", "suggestion_id", F.coalesce("a", "start_ms").alias("range_start"), F.coalesce("b", "end_ms").alias("range_end"))


@query("jn24_evidence_words", sql("SELECT s.task_id, s.suggestion_id, string_agg(w.text, '' ORDER BY w.idx, w.word) AS evidence FROM suggestions s JOIN words w ON w.task_id = s.task_id AND w.segment_id = s.segment_ref AND w.end_ms > s.start_ms AND w.start_ms < s.start_ms + 1000 GROUP BY ALL"))
def jn24(spark, d):
    """Words of the suggestion's cue within its first second."""
    spoken = D.words(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"), "idx", "word", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"), F.col("text").alias("said"))
    hit = D.suggestions(spark, d).drop("idx").join(spoken, ["task_id", "segment_ref"]).where("we > start_ms AND ws < start_ms + 1000")
    return hit.groupBy("task_id", "suggestion_id").agg(R.ordered_text(F.col("said"), F.struct("idx", "word"), "").alias("evidence"))


@query("jn22_arrays_overlap", f"WITH {D.SQL}{_RELATIONS} SELECT a.task_id, a.pos AS a_pos, b.pos AS b_pos FROM relations a JOIN relations b ON a.task_id = b.task_id AND a.pos < b.pos AND list_has_any(a.reference_refs, b.reference_refs)")
def jn22(spark, d):
    """Relations that share a reference: joined by each reference, not by trying all pairs of a task."""
    each = _relations(spark, d).select("task_id", "pos", F.explode("reference_refs").alias("ref"))
    other = each.select("task_id", "ref", F.col("pos").alias("b_pos"))
    return each.withColumnRenamed("pos", "a_pos").join(other, ["task_id", "ref"]).where("a_pos < b_pos").select("task_id", "a_pos", "b_pos").distinct()


@query("jn25_ledger", """
WITH calls AS (SELECT l_orderkey AS call_id, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, l_linestatus AS status FROM lineitem)
SELECT call_id, count(*) AS attempts, count(*) FILTER (number <> nth)::BIGINT AS misnumbered, count(*) FILTER (status = 'F')::BIGINT AS finished FROM calls GROUP BY call_id""")
def jn25(spark, d):
    """Attempts of a call are numbered from one without gaps."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    calls = D.table(spark, d, "lineitem").withColumn("nth", F.row_number().over(order))
    return calls.groupBy(F.col("l_orderkey").alias("call_id")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("l_linenumber") != F.col("nth")).alias("misnumbered"), F.count_if(F.col("l_linestatus") == "F").alias("finished")
    )


@query("jn28_suggestion_bounds", sql("SELECT s.task_id, s.suggestion_id, s.start_ms >= min(g.start_ms) AND s.end_ms <= max(g.end_ms) AS inside FROM suggestions s JOIN segments g ON g.task_id = s.task_id AND g.segment_id = s.segment_ref GROUP BY s.task_id, s.suggestion_id, s.start_ms, s.end_ms"))
def jn28(spark, d):
    bounds = D.segments(spark, d).groupBy("task_id", F.col("segment_id").alias("segment_ref")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    return D.suggestions(spark, d).join(bounds, ["task_id", "segment_ref"]).select("task_id", "suggestion_id", F.expr("start_ms >= a AND end_ms <= b").alias("inside"))


@query("flt3_suggestion_allowed", sql("""SELECT s.task_id, s.suggestion_id, CASE WHEN s.kind <> 'text_correction' THEN 'kind' WHEN g.segment_id IS NULL THEN 'unknown_cue'
 WHEN NOT (s.end_ms > g.start_ms AND s.start_ms < g.end_ms) THEN 'no_overlap' WHEN s.start_ms <> g.start_ms OR s.end_ms <> g.end_ms THEN 'other_time' END AS problem
FROM suggestions s LEFT JOIN segments g ON g.task_id = s.task_id AND g.segment_id = s.segment_ref"""))
def flt3(spark, d):
    """The first failure wins."""
    cues = D.segments(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    joined = D.suggestions(spark, d).join(cues, ["task_id", "segment_ref"], "left")
    problem = F.when(F.col("kind") != "text_correction", "kind").when(F.col("a").isNull(), "unknown_cue").when(~F.expr("end_ms > a AND start_ms < b"), "no_overlap").when(F.expr("start_ms <> a OR end_ms <> b"), "other_time")
    return joined.select("task_id", "suggestion_id", problem.alias("problem"))


# --- aggregates ------------------------------------------------------------------------------------------


@query("ag1_review_counts", sql("SELECT task_id, count(*) AS total, count(*) FILTER (idx % 4 = 0)::BIGINT AS pending, count(*) FILTER (idx % 4 = 1)::BIGINT AS accepted, count(*) FILTER (idx % 4 = 2)::BIGINT AS rejected, count(*) FILTER (idx % 4 = 3)::BIGINT AS edited, CASE WHEN count(*) FILTER (idx % 4 = 0) = count(*) THEN 'pending' WHEN count(*) FILTER (idx % 4 = 0) > 0 THEN 'in_progress' ELSE 'approved' END AS status FROM suggestions GROUP BY task_id"))
def ag1(spark, d):
    kinds = ("pending", "accepted", "rejected", "edited")
    counts = D.suggestions(spark, d).groupBy("task_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("idx") % 4 == k).alias(n) for k, n in enumerate(kinds)])
    status = F.when(F.col("pending") == F.col("total"), "pending").when(F.col("pending") > 0, "in_progress").otherwise("approved")
    return counts.withColumn("status", status)


@query("ag3_full_text", sql("SELECT task_id, string_agg(text, chr(10) ORDER BY idx) AS full_text FROM segments GROUP BY task_id"))
def ag3(spark, d):
    return D.segments(spark, d).groupBy("task_id").agg(R.ordered_text(F.col("text"), F.col("idx")).alias("full_text"))


@query("ag4_envelope", sql("SELECT task_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM segments GROUP BY task_id"))
def ag4(spark, d):
    return D.segments(spark, d).groupBy("task_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("ag6_merge_findings", """
WITH f AS (SELECT l_suppkey AS task_id, l_returnflag AS kind, l_quantity::BIGINT AS start_ms, l_quantity::BIGINT + 10 AS end_ms, l_linestatus AS current_text, CASE WHEN l_tax > 0.05 THEN 'a' WHEN l_tax > 0.02 THEN 'b' END AS suggested_text,
  'r' || (l_partkey % 9) AS ref, ['low', 'medium', 'high'][l_linenumber % 3 + 1] AS confidence, 'because ' || (l_partkey % 5) AS rationale FROM lineitem)
SELECT task_id, kind, start_ms, end_ms, current_text, list_sort(list_distinct(list(ref))) AS refs, arg_min(confidence, k) AS confidence, arg_min(rationale, k) AS rationale, count(DISTINCT coalesce(suggested_text, '~')) > 1 AS conflict
FROM (SELECT *, CASE confidence WHEN 'high' THEN 'a' WHEN 'medium' THEN 'b' ELSE 'c' END || rationale AS k FROM f) GROUP BY task_id, kind, start_ms, end_ms, current_text""")
def ag6(spark, d):
    items = D.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("task_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("start_ms"), (F.col("l_quantity").cast("long") + 10).alias("end_ms"),
        F.col("l_linestatus").alias("current_text"), F.when(F.col("l_tax") > 0.05, "a").when(F.col("l_tax") > 0.02, "b").alias("suggested_text"),
        F.array(F.concat(F.lit("r"), (F.col("l_partkey") % 9).cast("string"))).alias("refs"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("confidence"),
        F.concat(F.lit("because "), (F.col("l_partkey") % 5).cast("string")).alias("rationale"),
    )
    return R.merge_findings(items)


_PRIORITY = "CASE WHEN scope = 'project' AND explicit THEN 2 WHEN scope = 'project' AND is_default THEN 3 WHEN scope = 'global' AND explicit THEN 4 WHEN scope = 'global' AND is_default THEN 5 END"
_CANDIDATES = f", candidates AS (SELECT *, {_PRIORITY} AS priority FROM entries WHERE enabled AND {_PRIORITY} IS NOT NULL), winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY priority, dictionary_id, part) AS k FROM candidates) WHERE k = 1)"


def _winners(spark, d):
    priority = R.dictionary_priority(F.col("scope"), F.col("explicit"), F.col("is_default"))
    return R.dictionary_winners(D.entries(spark, d).where("enabled").withColumn("priority", priority).where("priority is not null"))


@query("ag7_dictionary_winner", f"WITH {D.SQL}{_CANDIDATES} SELECT entry_id, dictionary_id, priority, canonical, part FROM winners")
def ag7(spark, d):
    return _winners(spark, d).select("entry_id", "dictionary_id", "priority", "canonical", "part")


@query("ag8_spelling_conflicts", f"WITH {D.SQL}{_CANDIDATES} SELECT form, list_sort(list(DISTINCT entry_id)) AS entry_ids, count(DISTINCT canonical) AS spellings FROM (SELECT entry_id, canonical, CASE WHEN case_sensitive THEN canonical ELSE lower(canonical) END AS form FROM winners UNION ALL SELECT entry_id, canonical, variant FROM winners) GROUP BY form HAVING count(DISTINCT canonical) > 1")
def ag8(spark, d):
    forms = _winners(spark, d).select("entry_id", "canonical", F.explode(F.array(F.when(F.col("case_sensitive"), F.col("canonical")).otherwise(F.lower("canonical")), F.col("variant"))).alias("form"))
    groups = forms.groupBy("form").agg(F.sort_array(F.collect_set("entry_id")).alias("entry_ids"), F.count_distinct("canonical").alias("spellings"))
    return groups.where("spellings > 1").select("form", "entry_ids", "spellings")


@query("ag8_policy_conflicts", f"WITH {D.SQL}{_CANDIDATES} SELECT lower(canonical) AS term, list_sort(list(entry_id)) AS entry_ids FROM winners GROUP BY 1 HAVING count(DISTINCT case_sensitive) > 1")
def ag8_policy(spark, d):
    groups = _winners(spark, d).groupBy(F.lower("canonical").alias("term")).agg(F.sort_array(F.collect_list("entry_id")).alias("entry_ids"), F.count_distinct("case_sensitive").alias("n"))
    return groups.where("n > 1").select("term", "entry_ids")


@query("ag9_duplicate_keys", "SELECT l_orderkey, l_linenumber, n AS occurrence FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)::INT AS n FROM lineitem) WHERE n > 1")
def ag9(spark, d):
    return R.duplicates(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "occurrence")


@query("ag10_islands", sql("""SELECT task_id, type, min(sequence) AS first, max(sequence) AS last, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY sequence) AS island FROM (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY task_id ORDER BY sequence) = type THEN 0 ELSE 1 END AS fresh FROM task_events)
) GROUP BY task_id, type, island"""))
def ag10(spark, d):
    events = D.task_events(spark, d)
    runs = R.islands(events, F.lag("type").over(R.in_order(by="sequence")) != F.col("type"), "sequence")
    return runs.groupBy("task_id", "type", "island").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n")).drop("island")


@query("ag13_lowest_confidence", sql("SELECT task_id, CASE min(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS confidence FROM suggestions GROUP BY task_id"))
def ag13(spark, d):
    rank = F.expr("CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END")
    least = D.suggestions(spark, d).groupBy("task_id").agg(F.min(rank).alias("r"))
    return least.select("task_id", F.expr("CASE r WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END").alias("confidence"))


@query("ag15_part_sizes", "SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS bytes, max(l_quantity::BIGINT) AS largest, count(*) AS parts, (sum(l_quantity::BIGINT) > 100) = (count(*) > 1) AS consistent FROM lineitem GROUP BY l_orderkey")
def ag15(spark, d):
    size = F.col("l_quantity").cast("long")
    sums = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.count("*").alias("parts"))
    return sums.withColumn("consistent", (F.col("bytes") > 100) == (F.col("parts") > 1))


@query("ag16_warning_dedup", sql("SELECT task_id, type, min(sequence) AS first, arg_max(value, sequence) AS value FROM task_events GROUP BY ALL"))
def ag16(spark, d):
    """One warning an id: the last value, at the first one's place."""
    return D.task_events(spark, d).groupBy("task_id", "type").agg(F.min("sequence").alias("first"), F.max_by("value", "sequence").alias("value"))


@query("ag17_report_totals", sql("SELECT task_id, count(*) FILTER (kind = 'text_correction')::BIGINT AS applied, count(*) FILTER (kind <> 'text_correction')::BIGINT AS unapplied, count(*) FILTER (confidence <> 'high')::BIGINT AS to_review FROM suggestions GROUP BY task_id"))
def ag17(spark, d):
    return D.suggestions(spark, d).groupBy("task_id").agg(
        F.count_if(F.col("kind") == "text_correction").alias("applied"), F.count_if(F.col("kind") != "text_correction").alias("unapplied"), F.count_if(F.col("confidence") != "high").alias("to_review")
    )


_CLASS = "CASE WHEN kind = 'segmentation' THEN 'split' WHEN regexp_matches(o || r, '[0-9]|%') THEN 'number_unit' WHEN regexp_replace(o, '[\\p{P}\\p{S} ]', '', 'g') = regexp_replace(r, '[\\p{P}\\p{S} ]', '', 'g') THEN 'punctuation' ELSE 'recognition_error' END"


@query("ag18_modification_classes", sql(f"SELECT task_id, {_CLASS} AS class, count(*) AS n FROM (SELECT task_id, kind, original_text AS o, CASE WHEN idx % 2 = 0 THEN original_text || ',' ELSE suggested_text END AS r FROM suggestions) GROUP BY ALL"))
def ag18(spark, d):
    rows = D.suggestions(spark, d).select("task_id", "kind", F.col("original_text").alias("o"), F.when(F.col("idx") % 2 == 0, F.concat("original_text", F.lit(","))).otherwise(F.col("suggested_text")).alias("r"))
    bare = lambda c: F.regexp_replace(c, r"[\p{P}\p{S}\s]", "")
    kind = F.when(F.col("kind") == "segmentation", "split").when(F.concat("o", "r").rlike(r"\d|[０-９]|%|％|[年月日时分秒元角]"), "number_unit").when(bare("o") == bare("r"), "punctuation").otherwise("recognition_error")
    return rows.groupBy("task_id", kind.alias("class")).agg(F.count("*").alias("n"))


@query("ag22_latest_state", sql("SELECT task_id, type, sequence, value FROM task_events QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY sequence DESC) = 1"))
def ag22(spark, d):
    return R.latest_by(D.task_events(spark, d).select("task_id", "type", "sequence", "value"), ["task_id"], ["sequence"]).select("task_id", "type", "sequence", "value")


@query("ag23_attempt_deltas", sql("SELECT task_id, a.sequence AS attempt, b.k - a.k AS new_calls FROM task_events a JOIN task_events b USING (task_id) WHERE b.sequence = a.sequence + 1 AND a.type = 'click'".replace("SELECT task_id", "SELECT a.task_id")))
def ag23(spark, d):
    """Ending counts less starting counts, each attempt once."""
    events = D.task_events(spark, d)
    ended = events.withColumn("after", F.lead("k").over(R.in_order(by="sequence")))
    return ended.where("type = 'click' and after is not null").select("task_id", F.col("sequence").alias("attempt"), (F.col("after") - F.col("k")).alias("new_calls"))


# --- windows ---------------------------------------------------------------------------------------------


@query("wn1_overlap", sql("SELECT task_id, idx, start_ms < lag(e2) OVER (PARTITION BY task_id ORDER BY idx) AS overlaps FROM (SELECT *, end_ms + CASE WHEN idx % 6 = 2 THEN 300 ELSE 0 END AS e2 FROM segments)"))
def wn1(spark, d):
    late = D.segments(spark, d).withColumn("e2", F.col("end_ms") + F.when(F.col("idx") % 6 == 2, 300).otherwise(0))
    return late.select(*KEY, (F.col("start_ms") < F.lag("e2").over(R.in_order())).alias("overlaps"))


@query("wn2_monotonic", sql("SELECT task_id, sequence, value < lag(value) OVER (PARTITION BY task_id ORDER BY sequence) AS falls FROM task_events"))
def wn2(spark, d):
    return D.task_events(spark, d).select("task_id", "sequence", (F.col("value") < F.lag("value").over(R.in_order(by="sequence"))).alias("falls"))


@query("wn3_contiguous", sql("SELECT task_id, bool_and(n = sequence) AS contiguous FROM (SELECT task_id, sequence, row_number() OVER (PARTITION BY task_id ORDER BY sequence) AS n FROM task_events WHERE event_id % 97 <> 0) GROUP BY task_id"))
def wn3(spark, d):
    kept = D.task_events(spark, d).where("event_id % 97 <> 0").withColumn("n", F.row_number().over(R.in_order(by="sequence")))
    return kept.groupBy("task_id").agg(F.bool_and(F.col("n") == F.col("sequence")).alias("contiguous"))


@query("wn4_increasing_with_gaps", "SELECT o_custkey, o_orderkey, o_orderkey > coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS rises FROM orders")
def wn4(spark, d):
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return D.table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") > F.coalesce(before, F.lit(0))).alias("rises"))


@query("wn5_word_order", sql("SELECT task_id, idx, word, start_ms < coalesce(max(end_ms) OVER (PARTITION BY task_id, idx ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS early FROM (SELECT task_id, idx, word, start_ms, end_ms + CASE WHEN word = 1 THEN 400 ELSE 0 END AS end_ms FROM words)"))
def wn5(spark, d):
    """A word may not start before any earlier one of its cue has ended: a running maximum."""
    spoken = D.words(spark, d).withColumn("end_ms", F.col("end_ms") + F.when(F.col("word") == 1, 400).otherwise(0))
    ended = F.max("end_ms").over(W.partitionBy("task_id", "idx").orderBy("word").rowsBetween(W.unboundedPreceding, -1))
    return spoken.select(*KEY, "word", (F.col("start_ms") < F.coalesce(ended, F.lit(0))).alias("early"))


@query("wn6_dense_ids", sql("SELECT task_id, suggestion_id, printf('modification-%04d', row_number() OVER (PARTITION BY task_id ORDER BY idx)) AS modification_id FROM suggestions"))
def wn6(spark, d):
    return D.suggestions(spark, d).select("task_id", "suggestion_id", F.format_string("modification-%04d", F.row_number().over(R.in_order())).alias("modification_id"))


@query("wn7_running_offset", sql("SELECT task_id, idx, coalesce(sum(length(text)) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin, sum(length(text)) OVER (PARTITION BY task_id ORDER BY idx)::BIGINT AS finish FROM segments"))
def wn7(spark, d):
    size = F.length("text").cast("long")
    before = F.sum(size).over(R.in_order().rowsBetween(W.unboundedPreceding, -1))
    return D.segments(spark, d).select(*KEY, F.coalesce(before, F.lit(0).cast("long")).alias("begin"), F.sum(size).over(R.in_order()).alias("finish"))


@query("wn8_nearest_evidence", sql("SELECT task_id, idx, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(e IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS evidence FROM (SELECT *, CASE WHEN (task_id + idx) % 3 = 1 THEN segment_id END AS e FROM segments)"))
def wn8(spark, d):
    some = D.segments(spark, d).withColumn("e", F.when((F.col("task_id") + F.col("idx")) % 3 == 1, F.col("segment_id")))
    back = F.last("e", ignorenulls=True).over(R.in_order().rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("e", ignorenulls=True).over(R.in_order().rowsBetween(0, W.unboundedFollowing))
    return some.select(*KEY, F.coalesce(back, ahead).alias("evidence"))


@query("wn9_called_prefix", sql("SELECT task_id, sequence, k > 10 AND coalesce(bool_or(k <= 10) OVER (PARTITION BY task_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS after_gap FROM task_events"))
def wn9(spark, d):
    """Called parts must come first: none after one that wasn't."""
    gap = F.max(F.col("k") <= 10).over(R.in_order(by="sequence").rowsBetween(W.unboundedPreceding, -1))
    return D.task_events(spark, d).select("task_id", "sequence", ((F.col("k") > 10) & F.coalesce(gap, F.lit(False))).alias("after_gap"))


@query("wn10_contiguous_ranges", sql("SELECT task_id, idx, coalesce(lag(end_ms) OVER (PARTITION BY task_id ORDER BY idx), 0) = start_ms AS joined FROM segments"))
def wn10(spark, d):
    return D.segments(spark, d).select(*KEY, (F.lag("end_ms", 1, 0).over(R.in_order()) == F.col("start_ms")).alias("joined"))


@query("wn11_uncovered_ranges", sql("SELECT task_id, e AS gap_start, start_ms AS gap_end FROM (SELECT task_id, start_ms, coalesce(max(end_ms) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM segments WHERE idx % 3 <> 1) WHERE start_ms > e"))
def wn11(spark, d):
    """What no range covers: where the next starts after all before it have ended."""
    ended = F.max("end_ms").over(R.in_order().rowsBetween(W.unboundedPreceding, -1))
    gaps = D.segments(spark, d).where("idx % 3 <> 1").select("task_id", F.coalesce(ended, F.lit(0).cast("long")).alias("gap_start"), F.col("start_ms").alias("gap_end"))
    return gaps.where("gap_end > gap_start")


# --- order, sets -----------------------------------------------------------------------------------------


@query("tk1_oldest_queued", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def tk1(spark, d):
    return D.table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@query("tk2_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_orderkey = (SELECT median(o_orderkey)::BIGINT FROM (SELECT max(o_orderkey) AS o_orderkey FROM orders))) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def tk2(spark, d):
    """Newest first, the fifty after a cursor."""
    orders = D.table(spark, d, "orders")
    at = orders.agg(F.max_by(F.struct("o_orderdate", "o_orderkey"), "o_orderkey").alias("cursor"))
    return orders.join(at).where(F.struct("o_orderdate", "o_orderkey") < F.col("cursor")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("tk3_review_page", sql("SELECT task_id, suggestion_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY idx) AS n FROM suggestions WHERE idx > 1) WHERE n <= 2"))
def tk3(spark, d):
    page = D.suggestions(spark, d).where("idx > 1").withColumn("n", F.row_number().over(R.in_order()))
    return page.where("n <= 2").select("task_id", "suggestion_id")


@query("tk4_first_pending", sql("SELECT task_id, arg_min(suggestion_id, idx) AS suggestion_id FROM suggestions WHERE idx % 4 = 0 GROUP BY task_id"))
def tk4(spark, d):
    return D.suggestions(spark, d).where("idx % 4 = 0").groupBy("task_id").agg(F.min_by("suggestion_id", "idx").alias("suggestion_id"))


@query("tk6_stable_issues", sql("SELECT DISTINCT task_id, type FROM task_events ORDER BY task_id, type"))
def tk6(spark, d):
    return D.task_events(spark, d).select("task_id", "type").distinct().orderBy("task_id", "type")


@query("tk7_nearest_boundary", sql("SELECT task_id, arg_min(segment_id, abs(end_ms - 9000) * 100000 + idx) AS segment_id FROM segments GROUP BY task_id"))
def tk7(spark, d):
    return D.segments(spark, d).groupBy("task_id").agg(F.min_by("segment_id", F.struct(F.abs(F.col("end_ms") - 9000), "idx")).alias("segment_id"))


@query("tk9_hints", sql("SELECT dictionary_id, list(entry_id ORDER BY entry_id, part)[1:5] AS hints, count(*) > 5 AS truncated FROM entries WHERE enabled GROUP BY dictionary_id"))
def tk9(spark, d):
    """The first five of each dictionary. Ranked in a window, so no dictionary's entries are gathered."""
    order = W.partitionBy("dictionary_id").orderBy("entry_id", "part")
    ranked = D.entries(spark, d).where("enabled").withColumn("n", F.row_number().over(order)).where("n <= 6")
    grouped = ranked.groupBy("dictionary_id").agg(F.array_sort(F.collect_list(F.struct("n", "entry_id"))).alias("all"))
    return grouped.select("dictionary_id", F.transform(F.slice("all", 1, 5), lambda x: x["entry_id"]).alias("hints"), (F.size("all") > 5).alias("truncated"))


@query("st_set_operations", "SELECT p_partkey, list_sort(list_distinct(list_concat(n, t))) AS united, list_sort(list_filter(list_distinct(n), lambda x: NOT list_contains(t, x))) AS missing, list_sort(list_distinct(n)) = list_sort(list_distinct(t)) AS same FROM (SELECT p_partkey, string_split(p_name, ' ') AS n, string_split(p_type, ' ') AS t FROM part)")
def st(spark, d):
    """ST1 union, ST3 difference, ST5 equality."""
    n, t = F.split("p_name", " "), F.split("p_type", " ")
    return D.table(spark, d, "part").select(
        "p_partkey", F.sort_array(F.array_union(n, t)).alias("united"), F.sort_array(F.array_except(n, t)).alias("missing"), (F.sort_array(F.array_distinct(n)) == F.sort_array(F.array_distinct(t))).alias("same")
    )


_REFS = """heard AS (SELECT task_id, idx // 5 AS part, list(segment_id ORDER BY idx) AS refs FROM segments GROUP BY ALL),
said AS (SELECT task_id, idx // 5 AS part, list(segment_ref ORDER BY idx) AS named FROM suggestions GROUP BY ALL),
both_refs AS (SELECT task_id, part, refs, coalesce(named, []) AS named FROM heard LEFT JOIN said USING (task_id, part))"""


def _reference_lists(spark, d):
    """Of each five cues: their references, and those that suggestions name there, each in order."""
    listed = lambda df, c, name: df.groupBy("task_id", F.floor(F.col("idx") / 5).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(c).alias("v")))), lambda x: x["v"]).alias(name))
    named = listed(D.suggestions(spark, d), "segment_ref", "named")
    return listed(D.segments(spark, d), "segment_id", "refs").join(named, ["task_id", "part"], "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))


@query("st1_united_references", sql(f"""SELECT task_id, part, list(v ORDER BY place) AS united FROM (
  SELECT task_id, part, v, min(place) AS place FROM (SELECT *, unnest(list_concat(named, refs)) AS v, unnest(range(len(named) + len(refs))) AS place FROM both_refs) GROUP BY ALL) GROUP BY ALL""").replace(" SELECT task_id, part, list(v", f", {_REFS} SELECT task_id, part, list(v", 1))
def st1(spark, d):
    """References united in the order in which they are first seen."""
    return _reference_lists(spark, d).select("task_id", "part", F.array_union("named", "refs").alias("united"))


@query("st3_unknown_references", sql("SELECT DISTINCT task_id, segment_ref FROM suggestions g WHERE NOT EXISTS (FROM segments s WHERE s.task_id = g.task_id AND s.segment_id = g.segment_ref)"))
def st3(spark, d):
    """Names in suggestions that no cue of the task has."""
    known = D.segments(spark, d).select("task_id", F.col("segment_id").alias("segment_ref"))
    return D.suggestions(spark, d).select("task_id", "segment_ref").distinct().join(known, ["task_id", "segment_ref"], "left_anti")


@query("st4_subset_references", sql("SELECT task_id, part, list_has_all(refs, named) AS known FROM both_refs").replace(" SELECT task_id, part, list_has_all", f", {_REFS} SELECT task_id, part, list_has_all", 1))
def st4(spark, d):
    """Whether all that is named in a part is in it; nothing named is a subset."""
    return _reference_lists(spark, d).select("task_id", "part", (F.size(F.array_except("named", "refs")) == 0).alias("known"))


_PAIRED = """SELECT task_id, idx, list_reverse(a) = b AS ordered, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS unordered
FROM (SELECT task_id, idx, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY task_id ORDER BY idx), ' ') AS b FROM cue_pairs) WHERE b IS NOT NULL"""


@query("st5_equal_lists", sql("SELECT 1").replace(" SELECT 1", f", cue_pairs AS (SELECT task_id, idx * 2 + h AS idx, CASE WHEN h = 1 AND idx % 3 > 0 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE text END AS text FROM segments, (VALUES (0), (1)) v(h)) {_PAIRED}"))
def st5(spark, d):
    """Words of neighbours, each cue being followed by itself, often backwards: equal in backward order, and equal as sets."""
    words = F.split("text", " ")
    twice = D.segments(spark, d).select("task_id", "idx", F.posexplode(F.array(words, F.when(F.col("idx") % 3 > 0, F.reverse(words)).otherwise(words))).alias("h", "a")).withColumn("idx", F.col("idx") * 2 + F.col("h"))
    pairs = twice.select("task_id", "idx", "a", F.lead("a").over(D.in_task()).alias("b")).where("b IS NOT NULL")
    return pairs.select("task_id", "idx", (F.reverse("a") == F.col("b")).alias("ordered"), (F.sort_array(F.array_distinct("a")) == F.sort_array(F.array_distinct("b"))).alias("unordered"))


@query("st2_ordered_union", sql("SELECT task_id, 1 AS list, idx AS pos, segment_id AS id FROM segments UNION ALL SELECT task_id, 2, idx, suggestion_id FROM suggestions"))
def st2(spark, d):
    first = D.segments(spark, d).select("task_id", F.lit(1).alias("list"), F.col("idx").alias("pos"), F.col("segment_id").alias("id"))
    return first.unionByName(D.suggestions(spark, d).select("task_id", F.lit(2).alias("list"), F.col("idx").alias("pos"), F.col("suggestion_id").alias("id")))


@query("st6_overwrite_by_key", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' v2' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM part")
def st6(spark, d):
    part = D.table(spark, d, "part")
    old = part.select("p_partkey", F.col("p_name").alias("name"), F.lit(1).alias("version"))
    new = part.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" v2")).alias("name"), F.lit(2).alias("version"))
    return R.latest_by(old.unionByName(new), ["p_partkey"], ["version"]).select("p_partkey", "name", "version")
