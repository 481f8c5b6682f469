"""The registered queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, chat, decontaminate, divergence, linededup, lm, pii, quality, repair, secretscan, simhash, tokenfile, toxicity
from cuelake.llm.common import materialize, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hard)
    return chat.digests(chat.format_turns(turns))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "failures"
    )


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy and rule of it, from one ledger: how many documents fail the rule, and how many it alone rejects."""
    entries = materialize(quality.ledger(table(spark, sf_dir, "documents")).select("failures"), "ledger")
    versions = [quality.ablations(entries, v).withColumn("policy", F.lit(v)) for v in quality.POLICIES]
    return reduce(DataFrame.unionByName, versions).select("policy", "rule", "n_failed", "n_alone")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "votes")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", F.col("__removed_lines").alias("removed_lines"), F.col("__removed_words").alias("removed_words"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_hits")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mended = repair.repair(repair.damage(turns)).alias("m")
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    found = ids.join(mended, F.col("i.conv_id").eqNullSafe(F.col("m.conv_id")), "left")
    figures = [F.coalesce(f"m.{c}", F.lit(0)).cast("long").alias(c) for c in repair.FIGURES]
    return found.select("i.conv_id", *figures, F.coalesce("m.audit", F.lit("")).alias("audit"), F.coalesce("m.repaired_sha256", F.lit(repair.EMPTY)).alias("repaired_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_token_files": op4_token_files,
    "op5_quality_ledger": op5_quality_ledger,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pii_spans": op10_pii_spans,
    "op11_toxicity": op11_toxicity,
    "op12_structure_repair": op12_structure_repair,
    "op13_source_divergence": op13_source_divergence,
    "quality_policies": quality_policies,
}

_WS = "[^\\x20\\x09-\\x0D]+"

_OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_WS}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS l
  FROM d
), r AS (
  SELECT doc_id,
         len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}{{2}}[^\p{{Ll}}]*$')))::BIGINT AS n_capitals
  FROM m
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), x AS (
  SELECT r.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM r LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *,
         (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 2 * n_capitals > n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, n_lines, n_capitals, failures
FROM f
"""

_POLICIES = f"""
WITH e AS ({_OP5}), r AS (
  SELECT * FROM (VALUES {", ".join(f"({v}, '{r}', {quality.bits([r])}, {quality.bits(rules)})" for v, rules in quality.POLICIES.items() for r in rules)}) t(policy, rule, bit, mask)
)
SELECT policy, rule, count(*) FILTER (failures & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failures & mask = bit)::BIGINT AS n_alone FROM e, r GROUP BY policy, rule
"""

#: All runs of at most MIN_WORDS lines, by their text: a longer repeat consists of repeats among them.
_OP8 = rf"""
WITH split AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS row FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), line AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row) AS pos
  FROM (SELECT doc_id, row, line, len(regexp_extract_all(line, '{_WS}')) AS w FROM split) WHERE w > 0
), reach AS (
  SELECT doc_id, pos, list(line) OVER f AS x, list(w) OVER f AS ws, list(row) OVER f AS rows
  FROM line WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {linededup.MIN_WORDS - 1} FOLLOWING)
), run AS (
  SELECT doc_id, pos, n, array_to_string(x[:n], chr(10)) AS g, rows[:n] AS rows
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS n FROM reach) WHERE list_sum(ws[:n]) >= {linededup.MIN_WORDS}
), later AS (
  SELECT *, first_value(doc_id) OVER e AS fd, first_value(pos) OVER e AS fp FROM run WINDOW e AS (PARTITION BY g ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, unnest(rows) AS row FROM later WHERE doc_id > fd OR (doc_id = fd AND fp + n <= pos)
), kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.row) AS text
  FROM split s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.row = s.row GROUP BY s.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n, sum(w) AS w FROM gone JOIN line USING (doc_id, row) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(lost.n, 0)::BIGINT AS removed_lines, coalesce(lost.w, 0)::BIGINT AS removed_words
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_OP2 = rf"""
WITH src AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL SELECT 1, min(item_id), text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL GROUP BY text
), word AS (
  SELECT kind, id, unnest(w) AS raw, unnest(range(len(w))) AS i FROM (SELECT kind, id, regexp_extract_all(text, '{_WS}') AS w FROM src)
), bare AS (
  SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY i) - 1 AS pos, raw, b, lower(b) AS low
  FROM (SELECT *, regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS b FROM word) WHERE b <> ''
), typed AS (
  SELECT *, coalesce(lag(regexp_matches(raw, '[.!?:][^\p{{L}}\p{{N}}]*$')) OVER t, TRUE) AS opens,
         coalesce(lag(regexp_full_match(b, '\p{{N}}[\p{{N}}.,:/]*')) OVER t, FALSE) AS after_number,
         CASE WHEN regexp_full_match(b, '\p{{N}}[\p{{N}}.,:/]*') THEN 1
              WHEN low IN ({", ".join(f"'{u}'" for u in decontaminate.UNITS)}) THEN 3
              WHEN regexp_full_match(b, '\p{{Lu}}\p{{Ll}}+') THEN 2 ELSE 0 END AS may
  FROM bare WINDOW t AS (PARTITION BY kind, id ORDER BY pos)
), canon AS (
  SELECT kind, id, pos, low, form, CASE WHEN may = 2 AND (opens OR form = 1) THEN 0 WHEN may = 3 AND NOT after_number THEN 0 ELSE may END AS place
  FROM typed, (SELECT unnest([0, 1]) AS form)
), windowed AS (
  SELECT kind, id, form, pos, list(CASE WHEN place > 0 THEN '<' || place || '>' ELSE low END) OVER f AS g,
         list(CASE WHEN place > 0 THEN place || low END) OVER f AS s, count(*) OVER f AS n, sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) OVER f AS free
  FROM canon WINDOW f AS (PARTITION BY kind, id, form ORDER BY pos ROWS BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING)
), w AS (
  SELECT kind, id, form, pos, array_to_string(g, ' ') AS g, s FROM windowed WHERE n = {decontaminate.WINDOW} AND free >= {decontaminate.LITERALS}
), item AS (
  SELECT *, count(*) OVER (PARTITION BY id, form) AS n_windows FROM w WHERE kind = 1
), pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, form, n_windows, d.pos - i.pos AS shift, i.pos AS ipos, d.s AS ds, i.s AS ss
  FROM (SELECT DISTINCT id, pos, g, s FROM w WHERE kind = 0) d JOIN item i ON d.g = i.g
), slots AS (
  SELECT doc_id, item_id, form, shift, ss[k] AS sv, ds[k] AS dv FROM pairs, (SELECT unnest(range(1, {decontaminate.WINDOW} + 1)) AS k) WHERE ss[k] IS NOT NULL
), torn AS (
  SELECT DISTINCT doc_id, item_id, form, shift FROM (SELECT doc_id, item_id, form, shift, sv FROM slots GROUP BY ALL HAVING count(DISTINCT dv) > 1)
), good AS (
  SELECT * FROM pairs ANTI JOIN torn USING (doc_id, item_id, form, shift)
), found AS (
  SELECT doc_id, item_id FROM good GROUP BY doc_id, item_id, form, n_windows HAVING count(DISTINCT ipos) >= {decontaminate.SHARE} * n_windows
  UNION SELECT doc_id, item_id FROM good WHERE form = 0 GROUP BY doc_id, item_id, shift HAVING count(DISTINCT ipos) >= {decontaminate.RUN}
  UNION SELECT doc_id, item_id FROM (
    SELECT doc_id, item_id, shift, ipos, ipos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY ipos) AS island
    FROM (SELECT DISTINCT doc_id, item_id, shift, ipos FROM good WHERE form = 1)
  ) GROUP BY doc_id, item_id, shift, island HAVING count(*) >= {decontaminate.RUN}
)
SELECT doc_id, TRUE AS contaminated, count(*)::BIGINT AS n_items, list(item_id ORDER BY item_id) AS item_ids FROM found GROUP BY doc_id
"""

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, '### ' || role || ': '
         || CASE WHEN contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>')
                 THEN replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') ELSE text END
         || '</turn>' || chr(10) AS rendered
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, rendered)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, rendered) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(rendered))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

#: The damage with a CRC-32 by its table; then a step a row, each with up to two inserts before one edit. `said` are the lines so far, each with its newline.
_OP12 = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), hit AS (
  SELECT c.conv_id, c.turn, coalesce(c.role, ' ') AS role, coalesce(c.text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(c.turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM conversations c, tab
), damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (SELECT unnest([0, 1]) AS copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)
), r AS (
  SELECT *, row_number() OVER o - 1 AS pos,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, left(role, 1) AS i, lag(left(role, 1)) OVER o AS prior
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, empty OR again AS gone, NOT empty AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS broken
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM r)
), ins(state, mid, price, made, new) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', E'user:\n'), (1, 2, 3, 'I', E'user:\n'), (3, 2, 3, 'I', E'user:\n'),
         (2, 3, 3, 'I', E'assistant:\n'), (0, 3, 6, 'II', E'user:\nassistant:\n'), (1, 3, 6, 'II', E'user:\nassistant:\n')
), edit(mid, e, i, after) AS (
  VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'K', '', 0), (1, 'K', '', 1), (2, 'K', '', 2), (3, 'K', '', 3),
         (0, 'R', '*', 2), (1, 'R', '*', 2), (3, 'R', '*', 2), (2, 'R', '*', 3), (0, 'D', '*', 0), (1, 'D', '*', 1), (2, 'D', '*', 2), (3, 'D', '*', 3)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS best FROM f
  UNION ALL
  SELECT w.conv_id, w.pos + 1, edit.after,
         min({'cost': w.best.cost + price + CASE e WHEN 'R' THEN 3 WHEN 'D' THEN 4 ELSE 0 END + CASE WHEN f.broken AND e <> 'D' THEN 3 ELSE 0 END,
              'audit': w.best.audit || made || e,
              'said': w.best.said || new || CASE e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE CASE edit.mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) END})
  FROM walk w JOIN ins ON ins.state = w.state JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos
       JOIN edit ON edit.mid = ins.mid AND (edit.i = '*' OR edit.i = f.i) AND (e = 'D' OR NOT f.gone)
  GROUP BY w.conv_id, w.pos, edit.after
), figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (empty)::BIGINT AS blank,
         count(*) FILTER (again AND NOT empty)::BIGINT AS duplicate, count(*) FILTER (broken)::BIGINT AS truncated,
         count(*) FILTER (pos > 0 AND prior || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM f GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + price, 'audit': w.best.audit || made, 'said': w.best.said || new}) AS best
  FROM walk w JOIN figures s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos JOIN ins ON ins.state = w.state AND ins.mid IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(CASE WHEN coalesce(best.said, '') = '' THEN '' ELSE left(best.said, length(best.said) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), token AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM token GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.LEAST}
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM token SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT DISTINCT lang, source FROM d
), total AS (
  SELECT lang, source, coalesce(sum(n), 0) AS t FROM grp LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (t + v)::HUGEINT AS p
  FROM total g JOIN size USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (t + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term) JOIN (SELECT lang, sum(t) AS t FROM total GROUP BY lang) USING (lang) JOIN size USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

ORACLES = {
    "op2_decontaminate": _OP2,
    "op3_chat_format": _OP3,
    "op5_quality_ledger": _OP5,
    "op8_line_dedup": _OP8,
    "op12_structure_repair": _OP12,
    "op13_source_divergence": _OP13,
    "quality_policies": _POLICIES,
}
