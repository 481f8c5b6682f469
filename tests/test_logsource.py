"""The event log source: the rows of a plain read for any block size, conditions taken over, and torn lines held back."""

import json
import random

import pytest

from cuelake.sources import logsource, subtitles
from cuelake.sources.storage import fresh
from cuelake.streaming import events as E


def local(uri):
    return uri.removeprefix("file://")


def entry(task, n, **more):
    return json.dumps({"event_id": f"e{task}-{n}", "task_id": f"t{task}", "sequence": n, "occurred_at": f"at {n}", "type": "view", "data": {"é": [n, "ß\n"]}} | more, ensure_ascii=False)


def rows_of(df):
    return sorted(map(tuple, df.select("event_id", "task_id", "sequence", "occurred_at", "type", "data").collect()))


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 20])
def test_batch_is_a_plain_read(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(logsource, "CHUNK", 64)
    rng = random.Random(block)
    for task in range(3):
        text = [entry(task, n) for n in range(1, rng.randint(2, 9))]
        text.insert(1, rng.choice(["", "{torn", "[]", '{"sequence": "x"}', "null"]))
        (tmp_path / f"log{task}.jsonl").write_text("\n".join(text) + rng.choice(["", "\n", "\n{\"half"]))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text(entry(9, 9))
    logsource.register(spark)
    uri = f"file://{tmp_path}"
    got = spark.read.format("event_log").option("blockSize", block).load(uri)
    want = [r for r in rows_of(subtitles.read_event_log(spark, f"{uri}/*.jsonl"))]
    assert rows_of(got) == want and len(want) > 5
    assert rows_of(got.where("sequence > 2 AND task_id = 't1' AND type = 'view'")) == [r for r in want if r[2] > 2 and r[1] == "t1"]
    plan = got.where("sequence >= 2")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and ">= 2" in x]
    if block == 7:
        assert got.rdd.getNumPartitions() > 20


def test_a_stream_holds_back_a_torn_line_until_it_is_whole(spark):
    logsource.register(spark)
    uri, checkpoint, seen = (fresh(spark, n) for n in ("tail", "tail-checkpoint", "tail-rows"))
    import pathlib

    folder = pathlib.Path(local(uri))
    folder.mkdir(parents=True)
    whole, late = entry(1, 3), entry(2, 1)
    steps = [("a.jsonl", entry(1, 1) + "\n" + entry(1, 2) + "\n" + whole[:10]), ("a.jsonl", whole[10:25]), ("b.jsonl", late), ("a.jsonl", whole[25:] + "\n"), ("b.jsonl", "\n" + entry(2, 2)[:5])]
    counts, batches = [], []
    for k, (name, text) in enumerate(steps):
        with open(folder / name, "a") as f:
            f.write(text)
        stream = spark.readStream.format("event_log").option("blockSize", 50).load(uri)
        E.run(stream, "tail", write=lambda df, n, k=k: df.write.mode("overwrite").parquet(f"{seen}/step={k}/batch={n}"), checkpoint=checkpoint)
        got = rows_of(spark.read.parquet(f"{seen}/step=*/batch=*"))
        counts.append(len(got))
    assert counts == [2, 2, 2, 3, 4]
    assert [r[0] for r in got] == ["e1-1", "e1-2", "e1-3", "e2-1"] and got[2][5] == '{"é": [3, "ß\\n"]}'


def test_no_log_is_no_row(spark):
    logsource.register(spark)
    assert spark.read.format("event_log").load(fresh(spark, "nowhere")).count() == 0


def test_small_blocks_of_a_large_log_are_few_tasks():
    """The number of tasks follows from the bytes; what they have is each byte once, in order."""
    files = [("a", 0, 600_000_000), ("b", 0, 10), ("c", 5, 9), ("d", 0, 0), ("e", 0, 90_000_000)]
    parts = logsource.planned(files, 4096, True)
    assert 64 <= len(parts) < 140 and all(r.start % 4096 == 0 or r.path == "c" for p in parts for r in p.ranges)
    flat = [r for p in parts for r in p.ranges]
    for path, start, end in files:
        own = [(r.start, r.end) for r in flat if r.path == path]
        assert [a for a, _ in own] == [start, *(b for _, b in own[:-1])][: len(own)] and (own[-1][1] == end if own else start == end)
    assert len(logsource.planned([(f"{k}", 0, 100) for k in range(10_000)], 1 << 20, True)) <= 2
    assert [len(logsource.planned([("a", 0, n << 30)], 16 << 20, True)) for n in (1, 100)] == [64, 6400]


@pytest.mark.parametrize("block", [1, 5, 64, 1000])
def test_each_line_is_in_the_range_that_it_begins_in(tmp_path, block, monkeypatch):
    monkeypatch.setattr(logsource, "CHUNK", 16)
    text = "\n".join("x" * (k * 7 % 40) for k in range(60)).encode()
    (tmp_path / "log.jsonl").write_bytes(text)
    system, path = logsource._system(f"file://{tmp_path}/log.jsonl")
    ranges = [logsource.Range(path, a, min(a + block, len(text)), True) for a in range(0, len(text), block)]
    assert [x for r in ranges for x in logsource.lines(system, r)] == text.split(b"\n")


def test_values_that_are_no_texts_are_kept_as_they_stand():
    line = b'{"event_id": 7, "sequence": 2, "task_id": null, "data": {"a":  [1.0]}, "type": "x\\u00e9"}'
    assert logsource.event(line) == ("7", None, 2, None, "xé", '{"a":  [1.0]}')
    assert logsource.event(b'{"sequence": 3, "type": "y", "sequence": 4}') == (None, None, 4, None, "y", None)
    assert [logsource.event(x) for x in (b"[]", b"3", b'{"sequence": true}', b'{"sequence": 1.0}', b'{"sequence": 1} x', b"")] == [None] * 6
