"""Delivered files: repeated and broken jobs give the files and the history of one that ran through."""

import hashlib
import pathlib

import pytest

from cuelake.sources import delivery as L
from cuelake.sources.storage import fresh


def state(spark, uri):
    """Files of names, the history, and how many manifests and lists there are."""
    root = pathlib.Path(uri.removeprefix("file://"))
    files = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and L.OWN not in p.parts}
    count = lambda n: sum(1 for p in (root / L.OWN / n).glob("*"))
    return files, sorted(map(tuple, L.delivery_history(spark, uri).collect())), count("manifests")


def rows(spark, *pairs, parts=3):
    return spark.createDataFrame(list(pairs), "name string, content string").repartition(parts)


PAIRS = [(f"talk.{k}.srt", f"1\n{'ü' * k}\n") for k in range(9)] + [("sub/é 1.srt", ""), ("talk.1.srt", "1\nü\n")]
FACTS = sorted((n, hashlib.sha256(c.encode()).hexdigest(), len(c.encode()), False) for n, c in set(PAIRS))


def test_a_job_that_runs_again_adds_nothing(spark):
    uri = fresh(spark, "deliver")
    for parts in (3, 1, 5):
        L.write_deliveries(rows(spark, *PAIRS, parts=parts), uri)
        files, history, manifests = state(spark, uri)
        assert files == {n: c.encode() for n, c in PAIRS} and history == FACTS and manifests == 1
    read = {r["name"]: bytes(r["content"]) for r in L.read_delivered(spark, uri).collect()}
    assert read == files


@pytest.mark.parametrize("where", ["commit", "write"])
def test_a_job_that_died_and_is_run_again(spark, where, monkeypatch):
    uri = fresh(spark, "deliver")
    if where == "commit":
        # the driver dies between the tasks' ends and the manifest
        writer = L.DeliveryWriter(uri)
        writer.write(iter([{"name": n, "content": c} for n, c in PAIRS[:6]]))
        assert state(spark, uri)[1:] == ([], 0) and len(state(spark, uri)[0]) == 6
    else:
        # a row that can't be delivered fails the job, after others were
        with pytest.raises(Exception, match="below the path"):
            L.write_deliveries(rows(spark, *PAIRS, ("../out.srt", "x"), parts=1), uri)
        assert state(spark, uri)[1:] == ([], 0)
    L.write_deliveries(rows(spark, *PAIRS), uri)
    files, history, manifests = state(spark, uri)
    assert files == {n: c.encode() for n, c in PAIRS} and history == FACTS and manifests == 1


def test_other_bytes_under_a_name_are_a_conflict(spark):
    uri = fresh(spark, "deliver")
    L.write_deliveries(rows(spark, ("a", "one"), ("b", "two")), uri)
    L.write_deliveries(rows(spark, ("a", "other"), ("b", "two"), ("c", "x"), ("c", "y")), uri)
    files, history, manifests = state(spark, uri)
    sha = lambda c: hashlib.sha256(c.encode()).hexdigest()
    first, second = sorted(("x", "y"), key=sha)
    assert files == {"a": b"one", "b": b"two", "c": first.encode()} and manifests == 2
    assert history == sorted([("a", sha("one"), 3, False), ("a", sha("other"), 5, True), ("b", sha("two"), 3, False), ("c", sha(first), 1, False), ("c", sha(second), 1, True)])


def test_names_outside_and_empty_jobs(spark):
    assert [L.safe_name(n) for n in (None, "", "/a", "a/../b", "a//b", ".", f"{L.OWN}/x", "a/b", "..a")] == [False] * 7 + [True] * 2
    uri = fresh(spark, "deliver")
    L.write_deliveries(rows(spark, ("a", "x")).where("false"), uri)
    assert state(spark, uri) == ({}, [], 0)
    with pytest.raises(Exception, match="never replaced"):
        rows(spark, ("a", "x")).write.format("delivery").mode("overwrite").option("path", uri).save()
