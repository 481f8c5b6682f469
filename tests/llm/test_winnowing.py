"""Winnowing: every window has its least line as fingerprint, few lines are fingerprints where lines are short, and names may clash."""

import random

import xxhash

from cuelake.llm import linededup

DOCS = "doc_id long, text string"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def lines_of(text):
    return [(signed(xxhash.xxh64(x.encode(), seed=42).intdigest()), len(x.split())) for x in text.split("\n") if x.split()]


def least(run, start):
    k = min(range(len(run)), key=lambda i: (run[i][0], i))
    return start + k, run[k][0]


def fingerprints(text, need):
    """(place, hash) of the least line of each shortest run that begins or ends at a line."""
    ls, out = lines_of(text), set()
    for i in range(len(ls)):
        for step in (1, -1):
            j, n = i, 0
            while 0 <= j < len(ls) and n < need:
                n += ls[j][1]
                j += step
            if n >= need:
                a, b = (i, j) if step > 0 else (j + 1, i + 1)
                out.add(least(ls[a:b], a))
    return out


def test_fingerprints_are_the_least_lines_and_few_of_short_ones(spark):
    rng = random.Random(3)
    short = "\n".join(f"w{rng.randrange(9999)}" for _ in range(4000))
    mixed = "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 5, 9]))) for _ in range(300))
    got = linededup.windows(spark.createDataFrame([(1, short), (2, mixed)], DOCS)).select("d", "at", "h").distinct().collect()
    for d, text in ((1, short), (2, mixed)):
        assert {(r["at"], r["h"]) for r in got if r["d"] == d} == fingerprints(text, linededup.MIN_WORDS)
    assert len([r for r in got if r["d"] == 1]) < 4000 / 3


def test_the_fingerprint_decides(spark, monkeypatch):
    """Lines are told apart by the fingerprint's hashes alone where they are windows by themselves."""
    texts = ["one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert [r["text"] for r in linededup.deduplicate(docs).orderBy("doc_id").collect()] == texts
    real = linededup.windows
    from pyspark.sql import functions as F

    monkeypatch.setattr(linededup, "windows", lambda *a: real(*a).withColumns({"h": F.lit(0).cast("long"), "g": F.lit(0).cast("long")}))
    assert [r["text"] for r in linededup.deduplicate(docs).orderBy("doc_id").collect()] == [texts[0], ""]


def test_names_may_clash(spark):
    line = "one two three four five six seven eight"
    names = ["d", "k", "rows", "split", "left", "__d", "__k", "__rows", "__split", "__left", "___rows", "h", "g", "right", "at", "pos", "__removed_lines", "a.b"]
    docs = spark.createDataFrame([(1, line), (2, line)], DOCS).selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)])
    kept = linededup.deduplicate(docs, counts=False)
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"], r["__rows"], r["__removed_lines"]) for r in kept.collect()} == {(1, line, 7, 16), (2, "", 7, 16)}
    counted = linededup.deduplicate(docs)
    assert sorted((r["doc_id"], r["__removed_lines"], r["__removed_words"]) for r in counted.collect()) == [(1, 0, 0), (2, 1, 8)]
