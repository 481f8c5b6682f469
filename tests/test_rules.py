"""Golden vectors, brute force and defined cases of the reference's rules."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import visible as V
from cuelake.operators import adapters, align, process, relational, review, srt_checks, validate
from cuelake.sources import mp3
from cuelake.sources import subtitles as S
from cuelake.streaming import events as E


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text_vectors(spark):
    assert one(spark, "ＡｂＣ， 水星 １２！", T.match_text) == "ABC水星12"
    assert one(spark, "水星 12 ABC def", T.characters) == 6
    assert one(spark, "97202003", lambda c: T.srt_time(c.cast("long"))) == "27:00:02,003"
    assert one(spark, "straße", T.match_text) == "STRASSE"
    assert one(spark, "00:61:00,000", T.parse_time) is None and one(spark, "00:01:02,003", T.parse_time) == 62_003
    assert one(spark, "a b\nc，\n，d", T.flat_text) == "a b c，，d"
    assert one(spark, None, T.match_text) is None


def test_coverage_is_exact(spark):
    rows = spark.createDataFrame([(8, 10), (79, 100), (0, 0), (4, 5)], "m long, n long").select(T.passes_coverage(F.col("m"), F.col("n")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, True]


def test_visible_text():
    assert V.visible_text("Hello, world!")[:2] == ("Hello world", 2)
    assert V.visible_text("v0.3.0，see https://a.b/c).")[0] == "v0.3.0 see https://a.b/c"
    assert V.visible_text("1,000.5 and C++ don't 10:30") == ("1,000.5 and C++ don't 10:30", 0, 4)
    assert V.visible_text("……。")[0] == "" and V.visible_text(" a \n\n b ")[0] == "a\nb"


def test_wrapping_keeps_words_and_quantities():
    assert V.wrap("short") == ["short"]
    two = V.wrap("这是一个很长的句子需要，分成两行来显示才可以")
    assert len(two) == 2 and two[0].endswith("，") and "".join(two) == "这是一个很长的句子需要，分成两行来显示才可以"
    text = "今天早上我们一共走了１２３公里的山路才到"
    assert not any(a.endswith("１２３") for a in V.wrap(text)[:1])


def brute_lcs(a, b):
    best = 0
    for n in range(min(len(a), len(b)), 0, -1):
        for pick in combinations(range(len(a)), n):
            it = iter(b)
            if all(a[i] in it for i in pick):
                return n
        best = 0
    return best


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(150):
        a, b = [[rng.randrange(3) for _ in range(rng.randint(0, 8))] for _ in range(2)]
        pairs = sorted(align.matched_pairs(np.array(a, np.int64), np.array(b, np.int64)))
        assert len(pairs) == brute_lcs(a, b) == V.lcs_length("".join(map(str, a)), "".join(map(str, b)))
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_source_indexes_follow_a_least_edit():
    assert V.source_indexes("abc", "abc") == [0, 1, 2]
    assert V.source_indexes("abc", "axc") == [0, 1, 2]
    assert V.source_indexes("abc", "abxc") == [0, 1, 1, 2] and V.source_indexes("abc", "ac") == [0, 2]


def test_replace_across_cues():
    assert V.replace_across(["ab", "cd"], "bc", "XYZ") == ["aXY", "Zd"] or "".join(V.replace_across(["ab", "cd"], "bc", "XYZ")) == "aXYZd"
    assert V.replace_across(["aa", "a"], "a", "b") is None and V.replace_across(["ab"], "", "x") is None


def test_distribution_keeps_every_cue():
    assert review.distribute(["ab", "cd"], [(0, 1, "xx")]) == ["xxb", "cd"]
    assert "".join(review.distribute(["ab", "cd"], [(1, 3, "wxyz")])) == "awxyzd"
    with pytest.raises(ValueError):
        review.distribute(["ab", "cd"], [(0, 2, "x"), (1, 3, "y")])


def test_strict_srt(spark):
    good = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\nthere\r\n\r\n5\r\n00:00:02,000 --> 00:00:03,000\r\nyou\r\n"
    files = spark.createDataFrame([("good", good), ("order", "2\n00:00:01,000 --> 00:00:02,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n"), ("empty", ""), ("time", "1\n00:00:01,000 --> 00:99:02,000\na\n")], "key string, source string")
    rows = {k: [r for r in S.parse_srt(files).collect() if r["key"] == k] for k in ("good", "order", "empty", "time")}
    assert [(r["sequence"], r["start_ms"], r["text"], r["problem"]) for r in sorted(rows["good"], key=lambda r: r["block"])] == [(1, 1000, "hi\nthere", None), (5, 2000, "you", None)]
    assert {r["problem"] for r in rows["order"]} == {"sequence_order"} and rows["empty"][0]["problem"] == "no_blocks" and rows["time"][0]["problem"] == "bad_timeline"


def test_bad_words_are_dropped(spark):
    doc = '{"text": "a", "segments": [{"index": 0, "start_ms": 0, "end_ms": 1000, "text": "a", "words": [{"text": "w1", "start_ms": 0, "end_ms": 300}, {"text": "w2", "start_ms": 200, "end_ms": 500}, {"text": "w3", "start_ms": 300, "end_ms": 600}, {"text": "w4", "start_ms": 600, "end_ms": 2000}]}]}'
    row = S.import_transcript_json(spark.createDataFrame([("f", doc)], "key string, source string")).first()
    assert [w["text"] for w in row["words"]] == ["w1", "w3"] and row["dropped"] == 2 and row["problem"] is None


def test_finished_file_is_checked(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nabcdefg h\n\n2\n00:00:01,500 --> 00:00:03,000\n一二三四五六七八九十一二三四五六七八九十一二三四五\n"
    files = spark.createDataFrame([("f", text, False, 10_000), ("none", "", False, 10)], "key string, source string, bom boolean, duration_ms long")
    cues = spark.createDataFrame([("f", 0, 1000, 2000, "abcdefg h", 1000, 2000), ("f", 1, 1500, 3000, "一二三四五六七八九十一二三四五六七八九十一二三四五", 1500, 3000)], "key string, idx long, start_ms long, end_ms long, text string, reference_start long, reference_end long")
    got = {(r["key"], r["check"]): r["status"] for r in srt_checks.validate(files, cues).collect()}
    assert got["f", "SRT_HARD_CHARACTER_LIMIT"] == "failed" and got["f", "SRT_TIMELINE"] == "failed" and got["f", "SRT_LINE_LENGTH"] == "warning"
    assert got["f", "SRT_CALIBRATED_MAPPING"] == "passed" and got["f", "SRT_TEXT_ONLY_TIMELINE"] == "passed" and got["none", "SRT_BLOCKS"] == "failed"
    strict = {(r["key"], r["check"]): r["status"] for r in srt_checks.validate(files, cues, mode="text-and-segmentation").collect()}
    assert strict["f", "SRT_LINE_LENGTH"] == "failed" and ("f", "SRT_TEXT_ONLY_TIMELINE") not in strict
    transcribed = {(r["key"], r["check"]): r["status"] for r in srt_checks.validate(files, cues, purpose="transcribed").collect()}
    assert ("f", "SRT_HARD_CHARACTER_LIMIT") not in transcribed


def test_mp3_frames_and_chunks():
    frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(413)
    assert mp3.frames(frame)[0][:2] == (0, 417) and mp3.duration_ms(frame * 2) == 52 and mp3.duration_ms(b"no") is None
    assert len(mp3.frames(frame * 3)) == 3 and len(mp3.frames(frame * 3 + b"TAG" + bytes(125))) == 3
    # 384 samples at 32 kHz and 32 kbit/s are 12 ms and 48 bytes; 576 at 22,050 Hz and 8 kbit/s are 26 bytes
    assert mp3.frames((bytes([0xFF, 0xFF, 0x18, 0]) + bytes(44)) * 2) == [(0, 48, 12.0), (48, 96, 12.0)]
    assert [f[1] for f in mp3.frames((bytes([0xFF, 0xF3, 0x10, 0]) + bytes(22)) * 2)] == [26, 52]
    assert mp3.duration_ms(b"\xff\xfb" + b"junk" + frame * 4 + b"end") == 104
    with pytest.raises(ValueError):
        mp3.frames(b"noise")
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(50, 200) for _ in range(rng.randint(1, 40))]
        cuts = mp3.boundaries(sizes, [26.0] * len(sizes), sum(sizes), 26 * len(sizes))
        ends = sorted(rng.sample(range(1, 26 * len(sizes) + 1), min(5, len(sizes))))
        try:
            chunks = mp3.pack(cuts, ends, 400, 500)
        except ValueError:
            continue
        assert chunks[0][0] == 0 and chunks[-1][1] == sum(sizes) and all(a[1] == b[0] and a[3] == b[2] for a, b in zip(chunks, chunks[1:]))
        assert all(b - a <= 500 for a, b, _, _ in chunks)


def test_intervals_meet_like_brute_force(spark):
    rng = random.Random(3)
    a, b = [[(t, i, s, s + rng.randint(1, 30_000)) for t in range(3) for i, s in enumerate(rng.sample(range(50_000), 12))] for _ in range(2)]
    left = spark.createDataFrame(a, "task_id long, l long, start_ms long, end_ms long")
    right = spark.createDataFrame(b, "task_id long, r long, start_ms long, end_ms long")
    got = sorted((x["task_id"], x["l"], x["r"]) for x in relational.overlapping(left, right).select("task_id", "l", "r").collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] > x[2] and y[2] < x[3])


def test_states_in_stream_and_batch_are_the_same(spark):
    rng = random.Random(4)
    rows = [(t, s, rng.choice(list(E.TRANSITIONS))) for t in range(6) for s in range(1, 15)]
    log = spark.createDataFrame(rows, "task_id long, sequence long, wanted string")
    path = E.fresh(spark, "states")
    log.union(log.where("sequence % 3 = 0")).repartition(5).write.parquet(path)
    streamed = E.run(E.follow_states(E.follow(spark, path, log.schema, files_a_batch=1)), "states")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, E.fold_states(log).collect()))
    for t in range(6):
        status = E.FIRST
        mine = {r["sequence"]: r["status"] for r in E.fold_states(log).where(f"task_id = {t}").collect()}
        for _, s, wanted in [r for r in rows if r[0] == t]:
            status = wanted if wanted in E.TRANSITIONS[status] else status
            assert mine[s] == status


def test_a_gap_waits(spark):
    log = spark.createDataFrame([(1, 1, "running"), (1, 3, "completed")], "task_id long, sequence long, wanted string")
    path = E.fresh(spark, "gap")
    log.write.parquet(path)
    assert [r["sequence"] for r in E.run(E.follow_states(E.follow(spark, path, log.schema)), "gap").collect()] == [1]


def test_rules_with_nulls_and_empty_relations(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), (None, 3, "y"), (None, 4, None)], "id string, pos long, parent string")
    frames = {"t": rows, "p": rows.select(F.lit("x").alias("key")), "none": rows.where("false")}.__getitem__
    refs = lambda *tests: sorted(r["ref"] for r in validate.issues("c", list(tests), frames).collect())
    assert refs(validate.Unique("t", ("id",), "pos", "pos")) == ["2"]
    assert refs(validate.Exists("t", "p", (("parent", "key"),), "pos")) == ["1", "3", "4"]
    assert refs(validate.ExactlyOne("t", "p", (("parent", "key"),), "pos", where="parent IS NOT NULL")) == ["2", "3"]
    assert refs(validate.Where("t", "parent = 'x'", "pos"), validate.Group("none", ("id",), "count(*) > 0", "id")) == ["2"]


def test_requests_and_retries(spark):
    got = process.idempotent_requests(spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 3)], "request_id string, fingerprint string, at long")).orderBy("at").collect()
    assert [r["outcome"] for r in got] == ["accepted", "replay", "conflict"]
    tasks = spark.createDataFrame([(1, "failed", "known_terminal", False, None, False, True, False, 0), (2, "failed", "outcome_unknown", False, None, False, False, False, 0), (3, "failed", "known_terminal", False, "input", True, True, False, 0)],
                                  "task_id long, status string, outcome string, response_persisted boolean, error_category string, provided boolean, chat_known boolean, asr_known boolean, updated_at long")
    plans = {r["task_id"]: r for r in process.retry_plan(tasks, F.lit(90_000)).collect()}
    assert plans[1]["allowed"] and plans[1]["asr_calls"] == 0 and plans[1]["valid_from"] == 86_400
    assert plans[2]["reason"] == "outcome_unknown" and plans[3]["reason"] == "user_input"


def test_adapters_are_chosen_by_capability():
    adapter = adapters.dictionary_proofreader({})
    adapters.register(adapter)
    assert adapters.choose("calibration", {"text"}) is adapter
    with pytest.raises(LookupError):
        adapters.choose("calibration", {"audio"})
    with pytest.raises(ValueError):
        adapters.register(adapter)


def test_json_budget_and_canonical_form():
    assert V.canonical_json('{"b":1,"a":[2]}') == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'
    assert V.json_problem("[" * 30 + "]" * 30) == "depth" and V.json_problem("{") == "not_json" and V.json_problem('{"a": 1}') is None
    assert V.json_problem(str([1] * 5), nodes=5) == "nodes" and V.json_problem('["aaaa"]', string_bytes=3) == "string" and V.json_problem("[1,2]", items=1) == "array"
    assert V.redacted_json('{"a":[{"apiKey":"x"}]}') == '{"a":[{"apiKey":"[REDACTED]"}]}'


def test_files_with_other_bytes_are_problems(spark):
    import tempfile

    folder = tempfile.mkdtemp()
    with open(f"{folder}/bad.srt", "wb") as f:
        f.write(b"\xff\xfe1")
    with open(f"{folder}/good.srt", "wb") as f:
        f.write(b"\xef\xbb\xbf1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\n")
    rows = {r["key"].rsplit("/", 1)[1]: r for r in S.read_files(spark, f"{folder}/*").collect()}
    assert rows["bad.srt"]["problem"] == "encoding" and rows["good.srt"]["problem"] is None and rows["good.srt"]["source"].startswith("1\n00")


def test_folds_in_blocks_are_folds(spark):
    rng = random.Random(12)
    statuses = list(E.TRANSITIONS)
    rows = [(t, s, rng.choice(statuses)) for t in range(6) for s in range(1, rng.randint(2, 60))]
    want = []
    for task in range(6):
        now = E.FIRST
        for _, s, wanted in sorted(r for r in rows if r[0] == task):
            ok = wanted in E.TRANSITIONS[now]
            now = wanted if ok else now
            want.append((task, s, now, ok))
    frame = spark.createDataFrame(rows, "task_id long, sequence long, wanted string")
    for block in (1, 7, 500):
        assert sorted(tuple(r) for r in E.fold_states(frame, block).select("task_id", "sequence", "status", "accepted").collect()) == want


def test_sums_before(spark):
    from cuelake.functions import text as T

    rng = random.Random(13)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 3, 4, 5, 40])]
    frame = spark.createDataFrame(rows, "i int, s array<int>").select("i", T.sums_before(F.col("s"), block=4).alias("b"))
    assert {r["i"]: r["b"] for r in frame.collect()} == {i: [sum(s[:k]) for k in range(len(s))] for i, s in rows}
