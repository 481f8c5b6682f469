"""Secret scans against a plain Python version: candidates, contexts, features and votes; recall on planted secrets."""

import random
import re

import numpy as np
import pytest

from cuelake.llm import secretscan, trees

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def forest(spark):
    return secretscan.train(spark)


def brute_features(value, before, after):
    share = lambda pattern: len(re.findall(pattern, value)) / len(value)
    common = "(" + "|".join(sorted(secretscan.COMMON, key=len, reverse=True)) + ")"
    return [
        min(len(value), 200), share("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]"), share("[a-z]"), share("[A-Z]"), share("[0-9]"), share("[^A-Za-z0-9]"),
        float(bool(re.search("^([0-9a-f]+|[0-9A-F]+)$", value))), (len(value) - len(re.sub(common, "", value.lower()))) / len(value),
        value.count("/"), len(re.findall("[-_]", value)), max(map(len, re.findall("[A-Za-z]+", value)), default=0), len({*value}),
        *(float(bool(re.search(p, before))) for p in secretscan.CUES.values()),
        float(after[:1] in ("\"", "'") and after != ""), float(bool(re.match(r"\.[A-Za-z]", after))), float(bool(re.search(secretscan.KNOWN, value))),
    ]


def brute(text, forest):
    out = []
    for m in re.finditer(secretscan.CANDIDATE, text):
        last = max((n.end() for n in re.finditer(secretscan.CANDIDATE, text) if n.end() <= m.start()), default=None)
        # the candidate before counts as context, and what stands before that one doesn't
        start = 0 if last is None else [n.start() for n in re.finditer(secretscan.CANDIDATE, text) if n.end() == last][0]
        nexts = [n.start() for n in re.finditer(secretscan.CANDIDATE, text) if n.start() >= m.end()]
        before, after = text[start : m.start()][-secretscan.CONTEXT :], text[m.end() : min([len(text), *nexts])][: secretscan.CONTEXT]
        x = np.array([brute_features(m[0], before, after)])
        votes = sum(int(trees.predict(t, x)[0] > 0.5) for t in forest)
        if 2 * votes > len(forest):
            out.append((m.start(), m[0], votes))
    return out


def test_scan_matches_brute_force(spark, forest):
    rng = random.Random(1)
    lines = [line for _, line, _ in secretscan.findings(400, seed=5)]
    texts = [rng.choice([" ", "\n", ""]).join(rng.sample(lines, rng.randint(1, 9))) for _ in range(80)] + ["", "😀 token=" + "a1" * 20 + "==x", "no secret"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in secretscan.scan(frame, forest).orderBy("doc_id", "start").collect():
        assert r["length"] == len(r["value"])
        got[r["doc_id"]].append((r["start"], r["value"], r["votes"]))
    assert got == {i: brute(t, forest) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def test_planted_secrets_are_found(spark, forest):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = {(r["doc_id"], m[1]) for r in docs.collect() for m in re.finditer(r"token = \"([0-9a-f]{40})\"", r["text"] or "")}
    found = {(r["doc_id"], r["value"]) for r in secretscan.scan(docs, forest).collect()}
    assert len(planted) > 5 and len(planted & found) >= 0.95 * len(planted)


def test_very_many_candidates_take_time_in_proportion(spark, forest):
    value = "0123456789abcdef0123456789abcdef01234567"
    text = f'token = "{value}" ' * 20_000
    starts = [r["start"] for r in secretscan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).select("start").orderBy("start").collect()]
    assert starts == [9 + 51 * k for k in range(20_000)]
