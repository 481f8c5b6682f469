"""Chunks found by doubling, against the walk over one recording's lists."""

import random

import pytest

from cuelake.operators import packing as K
from cuelake.sources import mp3


def walk(sizes, lengths, file_bytes, file_ms, cues, target, hard):
    """The chunks of `mp3.pack`; None if it gives up."""
    try:
        return [tuple(map(int, c)) for c in mp3.pack(mp3.boundaries(sizes, lengths, file_bytes, file_ms), cues, target, hard)]
    except ValueError:
        return None


def frames_of(spark, tasks):
    return spark.createDataFrame([(t, n, b, float(m)) for t, (sizes, lengths, *_) in tasks.items() for n, (b, m) in enumerate(zip(sizes, lengths))], "task_id long, n long, bytes long, length_ms double")


def files_of(spark, tasks):
    return spark.createDataFrame([(t, fb, fm) for t, (_, _, fb, fm, _) in tasks.items()], "task_id long, file_bytes long, file_ms long")


def cues_of(spark, tasks):
    return spark.createDataFrame([(t, c) for t, x in tasks.items() for c in x[4]] + [(1, None), (-5, 10)], "task_id long, end_ms long")


@pytest.mark.parametrize(("target", "hard", "stretch"), [(300, 400, (4_096, 600_000)), (90, 350, (3, 50)), (1_000, 1_000, (7, 200))])
def test_chunks_are_those_of_the_walk(spark, monkeypatch, target, hard, stretch):
    monkeypatch.setattr(K, "FRAMES", stretch[0])
    monkeypatch.setattr(K, "SPAN_MS", stretch[1])
    rng, tasks = random.Random(target), {}
    for t in range(40):
        n = rng.choice([1, 2, 5, 30, 80, 150])
        most = 420 if t % 13 == 5 else 340
        sizes, lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, most)]) for _ in range(n)], [rng.choice([1, 8, 26, 64]) for _ in range(n)]
        file_ms = max(1, int(sum(lengths) * rng.choice([0.25, 1, 1, 1.5])))
        tasks[t] = (sizes, lengths, sum(sizes), file_ms, sorted(rng.randint(0, file_ms + 50) for _ in range(rng.choice([0, 1, n // 4, n, 2 * n]))))
    cut = K.cuts(frames_of(spark, tasks), files_of(spark, tasks))
    got = {}
    for r in K.packed(cut, cues_of(spark, tasks), target, hard).orderBy("task_id", "chunk").collect():
        got.setdefault(r["task_id"], []).append(r)
    assert set(got) == set(tasks)
    failed = 0
    for t, task in tasks.items():
        want = walk(*task, target, hard)
        assert [r["chunk"] for r in got[t]] == list(range(len(got[t])))
        if want is None:
            failed += 1
            assert got[t][-1]["problem"] in ("frame_too_large", "no_time") and got[t][-1]["end"] is None
        else:
            assert [(r["start"], r["end"], r["start_ms"], r["end_ms"]) for r in got[t]] == want and not any(r["problem"] for r in got[t]), t
    assert failed < len(tasks) / 2


def test_no_frames(spark):
    none = spark.createDataFrame([], "task_id long, n long, offset long, at long")
    assert K.packed(none, spark.createDataFrame([(1, 5)], "task_id long, end_ms long"), 10, 20).count() == 0
