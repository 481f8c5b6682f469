"""Timed relations derived from the test tables, the same way in Spark and in SQL: integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: A cue: at most 24 characters that end where a word does, or a part of a longer word.
CUE = "[^ ](?:.{0,22}[^ ])?(?: |$)|[^ ]{1,24}"


def in_task():
    return W.partitionBy("task_id").orderBy("idx")



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues of each conversation, which cover its turns' whole texts: (task_id, idx, segment_id, start_ms, end_ms, text).
    A turn without text is an empty cue."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    pieces = F.transform(F.regexp_extract_all(flat, F.lit(f"({CUE})"), F.lit(1)), lambda p: F.trim(p))
    cut = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("task_id"), "turn", F.posexplode(F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)).alias("piece", "text")
    )
    order = W.partitionBy("task_id").orderBy("turn", "piece")
    turns = cut.select("task_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "text")
    lasts = (800 + 60 * F.length("text")).cast("long")
    before = F.coalesce(F.sum(lasts).over(in_task().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 100 * F.col("idx")
    timed = turns.withColumn("start_ms", before.cast("long"))
    return timed.select(
        "task_id", "idx", F.format_string("seg-%04d", F.col("idx") + 1).alias("segment_id"), "start_ms", (F.col("start_ms") + lasts).alias("end_ms"), "text"
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly timed words of each cue: (task_id, idx, segment_id, word, start_ms, end_ms, text)."""
    cut = segments(spark, sf_dir).withColumn("parts", F.split("text", " ")).withColumn("n", F.size("parts").cast("long"))
    each = cut.select("*", F.posexplode("parts").alias("word", "part"))
    step = F.expr("(end_ms - start_ms) div n")
    return each.select(
        "task_id", "idx", "segment_id", F.col("word").cast("long").alias("word"), (F.col("start_ms") + F.col("word") * step).cast("long").alias("start_ms"),
        (F.col("start_ms") + (F.col("word") + 1) * step).cast("long").alias("end_ms"), F.col("part").alias("text"),
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text correction for every third cue; some name a cue that isn't there."""
    return segments(spark, sf_dir).where("(task_id + idx) % 3 = 0").select(
        "task_id", "idx",
        F.format_string("suggestion-%04d", F.col("idx") + 1).alias("suggestion_id"),
        F.when((F.col("task_id") + F.col("idx")) % 7 == 0, "seg-9999").otherwise(F.col("segment_id")).alias("segment_ref"),
        "start_ms", F.when(F.col("idx") % 4 == 3, F.col("end_ms") + 50).otherwise(F.col("end_ms")).alias("end_ms"),
        F.substring_index("text", " ", 1).alias("original_text"),
        F.concat(F.substring_index("text", " ", 1), F.lit("x")).alias("suggested_text"),
        F.when(F.col("idx") % 5 == 4, "segmentation").otherwise("text_correction").alias("kind"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("idx") % 3 + 1).cast("int")).alias("confidence"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio findings over windows of five seconds: (task_id, finding_id, start_ms, end_ms)."""
    ends = segments(spark, sf_dir).groupBy("task_id").agg(F.max("end_ms").alias("duration_ms"))
    windows = ends.select("task_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(5000).cast("long"))).alias("start_ms"))
    return windows.select("task_id", F.format_string("finding-%06d", F.expr("start_ms div 5000")).alias("finding_id"), "start_ms", (F.col("start_ms") + 1500).alias("end_ms"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries: (dictionary_id, scope, is_default, explicit, entry_id, canonical, variant, case_sensitive, enabled)."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("dict-"), F.col("p_size").cast("string")).alias("dictionary_id"),
        F.when(F.col("p_size") % 2 == 0, "project").otherwise("global").alias("scope"),
        (F.col("p_size") % 3 == 0).alias("is_default"), (F.col("p_size") % 5 == 0).alias("explicit"),
        F.concat(F.lit("entry-"), (F.col("p_partkey") % 97).cast("string")).alias("entry_id"),
        F.col("p_type").alias("canonical"), F.lower("p_brand").alias("variant"),
        (F.col("p_partkey") % 4 == 0).alias("case_sensitive"), (F.col("p_partkey") % 11 != 0).alias("enabled"), F.col("p_partkey").alias("part"),
    )


def dictionary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of dictionary entries, one for each part: (entry_id, form, case_sensitive). Besides its type and its brand an entry may
    have words that begin a conversation."""
    part, first = table(spark, sf_dir, "part"), table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    said = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("text", " ", 1)).otherwise(F.trim(F.substring("text", 1, 14)))
    named = part.join(first, F.col("p_partkey") % 1000 == F.col("conv_id"), "left").select("p_partkey", F.array("p_type", F.lower("p_brand"), said).alias("forms"))
    each = named.select(F.concat(F.lit("entry-"), F.col("p_partkey").cast("string")).alias("entry_id"), F.explode("forms").alias("form"), (F.col("p_partkey") % 4 == 0).alias("case_sensitive"))
    return each.where("form <> ''")


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log: (task_id, sequence, occurred_at, type, value, k)."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.row_number().over(order).cast("long").alias("sequence"), F.col("ts").alias("occurred_at"),
        F.col("event_type").alias("type"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id",
    )


#: The same relations as common table expressions.
SQL = """
pieces AS (
  SELECT conv_id, turn, regexp_extract_all(replace(coalesce(text, ''), chr(10), ' '), '""" + CUE + """') AS p FROM conversations
), cut AS (
  SELECT conv_id, turn, unnest(range(greatest(len(p), 1))) AS piece, unnest(CASE WHEN len(p) = 0 THEN [''] ELSE p END) AS text FROM pieces
), turns AS (
  SELECT conv_id AS task_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, piece) - 1)::BIGINT AS idx, trim(text) AS text
  FROM cut
), timed AS (
  SELECT *, (coalesce(sum(800 + 60 * length(text)) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 * idx)::BIGINT AS start_ms FROM turns
), segments AS (
  SELECT task_id, idx, printf('seg-%04d', idx + 1) AS segment_id, start_ms, (start_ms + 800 + 60 * length(text))::BIGINT AS end_ms, text FROM timed
), words AS (
  SELECT task_id, idx, segment_id, word::BIGINT AS word, (start_ms + word * ((end_ms - start_ms) // n))::BIGINT AS start_ms, (start_ms + (word + 1) * ((end_ms - start_ms) // n))::BIGINT AS end_ms, part AS text
  FROM (SELECT *, len(parts) AS n, unnest(parts) AS part, unnest(range(len(parts))) AS word FROM (SELECT *, string_split(text, ' ') AS parts FROM segments))
), suggestions AS (
  SELECT task_id, idx, printf('suggestion-%04d', idx + 1) AS suggestion_id, CASE WHEN (task_id + idx) % 7 = 0 THEN 'seg-9999' ELSE segment_id END AS segment_ref,
         start_ms, CASE WHEN idx % 4 = 3 THEN end_ms + 50 ELSE end_ms END AS end_ms, split_part(text, ' ', 1) AS original_text, split_part(text, ' ', 1) || 'x' AS suggested_text,
         CASE WHEN idx % 5 = 4 THEN 'segmentation' ELSE 'text_correction' END AS kind, ['low', 'medium', 'high'][idx % 3 + 1] AS confidence
  FROM segments WHERE (task_id + idx) % 3 = 0
), findings AS (
  SELECT task_id, printf('finding-%06d', start_ms // 5000) AS finding_id, start_ms::BIGINT AS start_ms, (start_ms + 1500)::BIGINT AS end_ms
  FROM (SELECT task_id, unnest(range(0, max(end_ms) + 1, 5000)) AS start_ms FROM segments GROUP BY task_id)
), entries AS (
  SELECT 'dict-' || p_size AS dictionary_id, CASE WHEN p_size % 2 = 0 THEN 'project' ELSE 'global' END AS scope, p_size % 3 = 0 AS is_default, p_size % 5 = 0 AS explicit,
         'entry-' || (p_partkey % 97) AS entry_id, p_type AS canonical, lower(p_brand) AS variant, p_partkey % 4 = 0 AS case_sensitive, p_partkey % 11 <> 0 AS enabled, p_partkey AS part
  FROM part
), dictionary_forms AS (
  SELECT * FROM (
    SELECT 'entry-' || p_partkey AS entry_id, unnest([p_type, lower(p_brand), CASE WHEN p_partkey % 3 = 0 THEN split_part(c.text, ' ', 1) ELSE trim(left(c.text, 14)) END]) AS form, p_partkey % 4 = 0 AS case_sensitive
    FROM part LEFT JOIN (SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0) c ON c.conv_id = p_partkey % 1000
  ) WHERE form <> ''
), task_events AS (
  SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, ts AS occurred_at, event_type AS type, value,
         (props ->> '$.k')::BIGINT AS k, event_id
  FROM events
)
"""


def sql(body: str) -> str:
    return f"WITH {SQL} {body}"
