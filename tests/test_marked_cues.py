"""The checks of finished files on cues with marks, digits and tags: each in a file of its own, the failing checks written by hand."""

import pytest

from cuelake.functions import visible as V
from cuelake.operators import srt_checks
from cuelake.sources import subtitles as S

#: text -> checks of the text that fail or warn
CASES = {
    "plain words": set(),
    "one, two": {"SRT_VISIBLE_SUBTITLE_STYLE"},
    "Really?": {"SRT_VISIBLE_SUBTITLE_STYLE"},
    "at 3.14 or 10:30": set(),
    "see https://x.org/a,b": set(),
    "see https://x.org/a.": {"SRT_VISIBLE_SUBTITLE_STYLE"},
    "今天，很好": {"SRT_VISIBLE_SUBTITLE_STYLE"},
    "今天很好": set(),
    "一二三四五六七八九十一二三四五六七八九十": {"SRT_LINE_LENGTH"},
    "一二三四五六七八九十一二三四五六七八九十一二三四五": {"SRT_LINE_LENGTH", "SRT_HARD_CHARACTER_LIMIT"},
    "<i>leaning</i>": {"SRT_TEXT", "SRT_VISIBLE_SUBTITLE_STYLE"},
    " untrimmed": {"SRT_TEXT"},
    "a​b": {"SRT_TEXT"},
    '{"a": 1}': {"SRT_TEXT", "SRT_VISIBLE_SUBTITLE_STYLE"},
    "one\ntwo": set(),
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9": {"SRT_LINE_LENGTH"},
}
OF_TEXT = {"SRT_TEXT", "SRT_VISIBLE_SUBTITLE_STYLE", "SRT_LINE_LENGTH", "SRT_HARD_CHARACTER_LIMIT", "SRT_LINE_COUNT"}


def test_checks_of_marked_cues(spark):
    cues = spark.createDataFrame([(k, 0, 0, 5_000, t, 0, 5_000) for k, t in enumerate(CASES)], "key long, idx long, start_ms long, end_ms long, text string, reference_start long, reference_end long")
    files = S.write_srt(cues.withColumnRenamed("key", "task_id"), final_blank=False).selectExpr("key", "source", "false AS bom", "5000L AS duration_ms")
    got = {k: set() for k in range(len(CASES))}
    for r in srt_checks.validate(files, cues).where("n > 0").collect():
        got[r["key"]].add(r["check"])
    assert {t: got[k] & OF_TEXT for k, t in enumerate(CASES)} == CASES


@pytest.mark.parametrize(("url", "kept"), [("", ""), ("http://a.b/(c)", "http://a.b/(c)"), ("http://a.b/c).", "http://a.b/c"), ("http://a.b/[c]]}!", "http://a.b/[c]"), ("...", ""), ("http://a.b/)(", "http://a.b/)(")])
def test_trimmed_urls(spark, url, kept):
    assert spark.createDataFrame([(url,), (None,)], "u string").select(V.trimmed_url("u").alias("t")).collect() == [(kept,), (None,)]
