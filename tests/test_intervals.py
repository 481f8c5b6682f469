"""Interval joins against all pairs, for lengths from a millisecond to a day, and the number of rows that long ones take."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import relational as R

A, B = "task_id long, a long, start_ms long, end_ms long", "task_id long, b long, start_ms long, end_ms long"


@pytest.mark.parametrize("shape", [(R.BLOCK_MS, R.RADIX, R.LEVELS), (10, 2, 6), (1000, 3, 1), (7, 4, 0)])
def test_pairs_are_all_that_overlap(spark, shape):
    rng = random.Random(sum(shape))
    day = 86_400_000 if shape[0] > 100 and shape[2] > 1 else 3_000

    def rows(n):
        out = []
        for i in range(n):
            start = rng.randrange(-day // 10, day)
            out.append((rng.randrange(3), i, start, start + rng.choice([0, 1, 5, 700, 3_000, day // 20, day])))
        return out

    left, right = rows(120), rows(120)
    got = R.overlapping_any_length(spark.createDataFrame(left, A), spark.createDataFrame(right, B), *shape).select("task_id", "a", "b").collect()
    want = {(t, i, j) for t, i, s, e in left for u, j, x, y in right if t == u and y > s and x < e}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_rows_grow_with_the_logarithm_of_a_length(spark):
    sizes = [1, 16, 256, 4096, 50_000]
    frame = spark.createDataFrame([(n, 13 + n) for n in sizes], "n long, hi long")
    cover, part = R._blocks(F.lit(13), F.col("hi"), R.RADIX, R.LEVELS)
    rows = {r["n"]: r["k"] for r in frame.select("n", (F.size(cover) + F.size(part)).alias("k")).collect()}
    assert all(rows[n] <= 2 * 15 * (k + 1) + 8 for k, n in enumerate(sizes)) and rows[50_000] < 150
