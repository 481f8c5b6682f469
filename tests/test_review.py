"""Review decisions: components of changes that share targets against a plain search, and their effect on cues."""

import random

import pytest

from cuelake.operators import review

CHANGES = "task_id long, change_id string, targets array<bigint>, begin long, proposed_text string, final_text string"
CUES = "task_id long, idx long, text string"


def components(targets):
    """The least member of the group of each list; lists that share an index, in steps, are in one group."""
    groups = [set(t) for t in targets]
    merged = True
    while merged:
        merged = False
        for a in groups:
            for b in groups:
                if a is not b and a & b and a != b:
                    a |= b
                    b |= a
                    merged = True
    return [min(g) for g in groups]


def test_plain_components():
    assert components([[1, 2], [4], [2, 3]]) == [1, 4, 1]


@pytest.mark.parametrize("seed", range(4))
def test_changes_that_share_targets_are_one_component(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for task in range(4):
        width = [12, 60, 200, 200][task]
        for k in range(40):
            start = rng.randrange(width)
            near = list(range(start, start + rng.randint(1, 3)))
            rows[task, f"c{k:02}"] = near if rng.random() < 0.6 or task == 3 else rng.sample(range(width), rng.randint(2, 4))
    if seed == 0:  # a chain of scattered changes, each linked to the next one only
        rows |= {(9, f"c{k:03}"): [k * 10, (k + 1) * 10] for k in range(60)}
    frame = spark.createDataFrame([(t, c, x, 0, "", "") for (t, c), x in rows.items()], CHANGES)
    got = {(r["task_id"], r["change_id"]): r["component"] for r in review.change_components(frame).collect()}
    for task in {t for t, _ in rows}:
        own = [k for k in rows if k[0] == task]
        want = components([rows[k] for k in own])
        names = dict(zip(own, want, strict=True))
        assert {(a, b) for a in own for b in own if got[a] == got[b]} == {(a, b) for a in own for b in own if names[a] == names[b]}


def test_decisions_take_effect_or_name_their_problem(spark):
    cues = [(1, i, t) for i, t in enumerate(["one two", "three", "four five", "six", "seven", "eight", "nine", "ten"])]
    changes = [
        (1, "a", [0], 0, "one", "1"), (1, "b", [0, 1], 4, "twothree", "2 and 3"),  # one component
        (1, "c", [2], 0, "wrong", "x"), (1, "d", [3, 5], 0, "six", "6"), (1, "e", [5], 0, "eight", "8"), (1, "f", [4], 0, "seven", "7"), (1, "g", [7, 8], 0, "ten", "10"),
        (2, "a", [0], 0, "z", "y"),
    ]
    got = {r["idx"]: (r["text"], r["problem"]) for r in review.apply_decisions(spark.createDataFrame(cues, CUES), spark.createDataFrame(changes, CHANGES)).collect()}
    assert got[0][0] + got[1][0] == "1 2 and 3" and got[0][1] is None
    assert got[2] == ("four five", "the text has changed") and got[6] == ("nine", None) and got[4] == ("7", None)
    assert got[3] == ("six", "targets aren't neighbouring cues") and got[5][0] == "eight" and got[7] == ("ten", "targets aren't neighbouring cues")


def test_boundaries_move_as_a_plain_count_says():
    rng = random.Random(2)
    for _ in range(300):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        whole, patches, at = "".join(pieces), [], 0
        while at < len(whole) and rng.random() < 0.7:
            a = rng.randint(at, len(whole))
            b = rng.randint(a, min(len(whole), a + 3))
            patches.append((a, b, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5)))))
            at = b + 1
        text, shift = whole, 0
        for a, b, new in patches:
            text = text[: a + shift] + new + text[b + shift :]
            shift += len(new) - (b - a)
        try:
            out = review.distribute(pieces, patches)
        except ValueError:
            continue
        assert "".join(out) == text and len(out) == len(pieces) and all(out)
