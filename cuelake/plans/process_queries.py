"""Rules that need a Python step, alignment, corrections and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import visible as V
from cuelake.operators import align as A
from cuelake.operators import review as R
from cuelake.plans import workload as D
from cuelake.plans.registry import query
from cuelake.plans.workload import sql
from cuelake.sources.storage import fresh

KEY = ("task_id", "idx")


@query("str5_visible_text")
def str5(spark, d):
    """STR5 and STR6: punctuation as space, except in links, numbers and names."""
    return D.table(spark, d, "conversations").select("conv_id", "turn", V.visible(F.col("text")).alias("v")).select("conv_id", "turn", "v.*")


_ENDS = ("", ".", "!?", ")", "(x)", "(x))", "[(x].)", "/{a}.;", "))]}")


@query("str6_trimmed_urls", sql(f"""SELECT task_id, idx, url, url_start || ['', '', '', '', '(x)', '(x)', '[(x].)', '/{{a}}', ''][k] AS trimmed FROM (
  SELECT task_id, idx, 'https://x.org/' || regexp_extract(text, '[A-Za-z]+') AS url_start, idx % 9 + 1 AS k, url_start || {list(_ENDS)!r}[k] AS url FROM segments)"""))
def str6(spark, d):
    """Links of a cue's first word, with sentence marks and with brackets that are closed, left open or never opened."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("idx") % len(_ENDS) + 1).cast("int"))
    urls = D.segments(spark, d).select("task_id", "idx", F.concat(F.lit("https://x.org/"), F.regexp_extract("text", "[A-Za-z]+", 0), end).alias("url"))
    return urls.withColumn("trimmed", V.trimmed_url("url"))


@query("str8_visible_review_text")
def str8(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", V.visible(T.flat_text(F.col("text")))["text"].alias("text"))


@query("str1_unit_text", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\r\\n\\x{2028}\\x{2029}]+', ' ', 'g'), '[\\t ]+', ' ', 'g')) AS text FROM conversations")
def str1(spark, d):
    """STR10 adds the rejection of controls to the same squeeze."""
    flat = F.regexp_replace(F.regexp_replace(V.nfc(F.col("text")), r"[\r\n\x{2028}\x{2029}]+", " "), "[\t ]+", " ")
    return D.table(spark, d, "conversations").select("conv_id", "turn", T.trim(flat).alias("text"))


@query("str15_wrapped_lines")
def str15(spark, d):
    """STR15 and STR16."""
    return D.segments(spark, d).select(*KEY, V.wrapped(F.concat("text", F.lit(" and "), "text")).alias("lines"))


@query("str17_slugs")
def str17(spark, d):
    return D.table(spark, d, "part").select("p_partkey", V.slugs(F.col("p_name")).alias("slug"))


@query("str24_origins")
def str24(spark, d):
    return D.suggestions(spark, d).select("task_id", "suggestion_id", V.origins(F.col("original_text"), F.col("suggested_text")).alias("origins"))


@query("str25_local_evidence")
def str25(spark, d):
    """FLT5's test of closeness."""
    return D.suggestions(spark, d).select("task_id", "suggestion_id", V.close_to(F.col("original_text"), F.col("suggested_text")).alias("close"))


def _sides(spark, d):
    """Each task's cues, and a reference that lacks some of them: (cues, name of their ids) of either side."""
    kept = D.segments(spark, d).where("(task_id + idx) % 5 <> 3")
    return (D.segments(spark, d), "segment_id"), (kept.withColumn("reference_id", F.format_string("reference-%04d", F.col("idx") + 1)), "reference_id")


def _aligned(spark, d):
    """(pairs, characters of the transcript, of the reference)."""
    asr, reference = _sides(spark, d)
    return A.align(A.placed(*asr), A.placed(*reference)), A.character_rows(*asr), A.character_rows(*reference)


def _matched(spark, d):
    """(runs of pairs, placed transcript, placed reference); the sides are written, since each is read again and again."""
    sides = []
    for side in _sides(spark, d):
        rows, path = A.placed(*side), fresh(spark, "placed-side")
        rows.write.parquet(path)
        sides.append(spark.read.schema(rows.schema).parquet(path))
    return A.matched_runs(*sides), *sides


_CHARS = "len(regexp_replace(upper(replace({0}, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


@query("ag2_alignment_summary", sql(f"""SELECT task_id, sum(n) FILTER ((task_id + idx) % 5 <> 3)::BIGINT AS matched, sum(n)::BIGINT AS asr_characters FROM (SELECT task_id, idx, {_CHARS.format('text')} AS n FROM segments) GROUP BY task_id HAVING count(*) FILTER ((task_id + idx) % 5 <> 3) > 0"""))
def ag2(spark, d):
    """JN6: a reference that lacks some cues matches all that it has."""
    asr, reference = (A.placed(*side) for side in _sides(spark, d))
    return A.summary(A.align(asr, reference), asr, reference).where("reference_characters > 0").select("task_id", "matched", "asr_characters")


@query("ag10_alignment_relations")
def ag10(spark, d):
    return A.relations(*_matched(spark, d))


@query("ag11_unaligned_regions")
def ag11(spark, d):
    pairs, asr, _ = _aligned(spark, d)
    return A.unaligned(pairs, asr, "l")


@query("wn14_apply_suggestions", sql("""SELECT g.task_id, g.segment_id, CASE WHEN s.segment_ref IS NOT NULL AND length(s.original_text) > 0 THEN s.suggested_text || substring(g.text, length(s.original_text) + 1) ELSE g.text END AS text,
 CASE WHEN s.segment_ref IS NOT NULL AND length(s.original_text) > 0 THEN 1 ELSE 0 END AS applied
FROM segments g LEFT JOIN suggestions s ON s.task_id = g.task_id AND s.segment_ref = g.segment_id"""))
def wn14(spark, d):
    return R.apply_suggestions(D.segments(spark, d), D.suggestions(spark, d))


def _changes(spark, d):
    """Every third cue's first word was proposed; the reviewer's text is that word twice. Some changes span two cues."""
    cues = D.segments(spark, d)
    wide = F.lead("idx").over(D.in_task()).isNotNull() & (F.col("idx") % 6 == 0)
    word = F.substring_index("text", " ", 1)
    return cues.withColumn("wide", wide).where("idx % 3 = 0").select(
        "task_id", F.format_string("chg-%04d", F.col("idx")).alias("change_id"), F.when(F.col("wide"), F.array("idx", F.col("idx") + 1)).otherwise(F.array("idx")).alias("targets"),
        F.lit(0).cast("long").alias("begin"), word.alias("proposed_text"), F.concat(word, word).alias("final_text"),
    )


@query("wn16_apply_decisions", sql("SELECT task_id, string_agg(CASE WHEN idx % 3 = 0 THEN split_part(text, ' ', 1) ELSE '' END || text, '' ORDER BY idx) AS whole FROM (SELECT task_id, idx, text FROM segments) GROUP BY task_id").replace("|| text, ''", "|| replace(text, ' ', ''), ''"))
def wn16(spark, d):
    """AG21 and NUM6 too. A task's letters are compared, since the cut between two cues moves."""
    done = R.apply_decisions(D.segments(spark, d), _changes(spark, d))
    from cuelake.operators.relational import ordered_text

    return done.groupBy("task_id").agg(F.replace(ordered_text(F.col("text"), F.col("idx"), ""), F.lit(" "), F.lit("")).alias("whole"))


@query("stm14_review_fold", sql("""
, log AS (SELECT task_id, k % 10 AS change, sequence, CASE WHEN type = 'view' THEN 'pending' ELSE type END AS decision FROM task_events WHERE type <> 'purchase'),
states AS (SELECT task_id, change, arg_max(decision, sequence) AS decision, max(sequence) AS sequence FROM log GROUP BY ALL),
approvals AS (SELECT task_id, max(sequence) AS approved_seq FROM task_events WHERE type = 'purchase' GROUP BY task_id)
SELECT s.task_id, count(*) FILTER (decision = 'pending')::BIGINT AS pending, count(*) FILTER (decision = 'pending') = 0 AND coalesce(max(approved_seq) > max(s.sequence), FALSE) AS approved FROM states s LEFT JOIN approvals a ON a.task_id = s.task_id GROUP BY s.task_id""").replace(") \n,", ")\n,"))
def stm14(spark, d):
    """The last decision of each change counts; a later decision takes an approval back."""
    events = D.task_events(spark, d)
    log = events.where("type <> 'purchase'").select("task_id", (F.col("k") % 10).alias("change_id"), "sequence", F.when(F.col("type") == "view", "pending").otherwise(F.col("type")).alias("decision"))
    return R.approval(R.fold_decisions(log), events.where("type = 'purchase'"))
