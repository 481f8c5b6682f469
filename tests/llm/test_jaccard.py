"""The pipeline's near-duplicates against all pairs at a Jaccard similarity of 0.8 of five-word shingles."""

import random

import pytest

import corpus_pipeline
from cuelake.llm import jaccard, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """doc_id -> the least doc_id of its group, by all pairs."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def edited_texts():
    rng = random.Random(11)
    word = lambda: rng.choice("bcdfgklmn") + rng.choice("aeiou") + rng.choice("rstvz") + rng.choice("aeiou")
    passage, texts = [word() for _ in range(30)], [None, "", " \n", "one two", "One  two", "one two three four five six"]
    for base in ([word() for _ in range(n)] for n in (6, 12, 40, 90, 150)):
        for k in range(24):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5]) * len(base) // 60 + (k % 3 == 0)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + [word() for _ in range(rng.choice([0, 0, 1, 4]))]))
    texts += [" ".join([*passage, *(word() for _ in range(rng.randrange(4, 60)))]) for _ in range(40)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("wide", [32, 1])
def test_near_duplicates_are_all_pairs_at_four_fifths(spark, wide):
    texts = edited_texts()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame, wide).collect()}
    want = brute_groups(texts)
    assert got == want and 20 < len(set(want.values())) < len(want) - 40


def test_pipeline_stage_removes_edited_copies(spark):
    texts = edited_texts()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, "one two", "en", "s", 0)], DOCS)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(brute_groups(texts).values())) and kept.count(None) == 1
    none = frame.where("false")
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0


@pytest.mark.parametrize("full", [512, 1])
def test_fingerprints_meet_in_blocks_before_prefixes(spark, monkeypatch, full):
    """Every pair of sets within the distance is compared by way of its fingerprints, and none of their components again."""
    texts, asked = edited_texts(), []
    sets = {s.tobytes(): s for s in (jaccard.shingles((t or "").encode()) for t in texts.values())}
    prints = {int(jaccard.xxhash.xxh64_intdigest(b, jaccard.SEED)): simhash.fingerprint(s) for b, s in sets.items()}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    prints = {signed(n): fp for n, fp in prints.items()}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= jaccard.DISTANCE}
    alike, close_pairs = jaccard._alike, jaccard.close_pairs

    def seen(pairs, *more):
        asked.append({tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()})
        return alike(pairs, *more)

    monkeypatch.setattr(jaccard, "_alike", seen)
    monkeypatch.setattr(jaccard, "close_pairs", lambda nodes: close_pairs(nodes, full))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute_groups(texts) and len(near) >= 20
    by_node = dict(zip(prints, sets.values(), strict=True))
    similar = {(a, b) for a, b in asked[0] if 9 * len(jaccard.np.intersect1d(by_node[a], by_node[b])) >= 4 * (len(by_node[a]) + len(by_node[b]))}
    assert asked[0] <= near and similar and not similar & asked[1]
    assert full == 1 or asked[0] == near


def test_blocks_are_sized_for_the_fingerprints():
    assert [simhash.blocks_for(n, 6, 256) for n in (0, 100_000, 200_000, 10_000_000, 60_000_000)] == [8, 8, 8, 8, 9]


def test_close_fingerprints_meet_once(spark):
    """A pair comes from one of the keys that it shares, not from all."""
    frame = spark.createDataFrame([(0,), (1,), (2**40 + 1,), (127,)], "fp long")
    masks = simhash._masks(8, 6)
    rows = simhash._pairs(simhash._shared_keys(frame, masks), 6, masks).collect()
    assert sorted(map(tuple, rows)) == [(0, 1), (0, 2**40 + 1), (1, 127), (1, 2**40 + 1)]


def test_each_text_of_a_repeated_doc_id_is_judged_by_itself(spark):
    """A copy of an earlier document goes, though its doc_id stays with another text; rows that repeat both stay."""
    one, two, three = (" ".join(f"{a}{i}" for i in range(30)) for a in "abc")
    rows = [(3, one), (5, two), (5, two), (5, one + " end"), (7, two + " end"), (7, three), (8, None), (9, ""), (9, three + " end")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, "").collect() if r["doc_id"] != 8)
    assert kept == sorted([(3, one), (5, two), (5, two), (7, three)])
