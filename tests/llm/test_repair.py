"""Conversation repair against a plain search over all edits, pieces of any size, and the cases that the docstring defines."""

import hashlib
import itertools
import random
import re

import pytest
from compare import difference

from cuelake.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) rows: every edit sequence, cheapest cost first."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, *_ in rows if t is not None]
    kinds, seen = [], set()
    for _, r, x in rows:
        said = x.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not said else "duplicate" if (r, x) in seen else "ok" if said[-1] in ".!?" else "truncated")
        seen.add((r, x))
    ends = []

    def go(i, left, cost, audit, said):
        if left < 0:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)):
                ends.append((cost, audit, "\n".join(f"{r}:{x}" for r, x in said)))
        for role in ("user", "assistant"):
            if left >= 3:
                go(i, left - 3, cost + 3, audit + "I", [*said, (role, "")])
        if i < len(rows):
            _, r, x = rows[i]
            go(i + 1, left - 4, cost + 4, audit + "D", said)
            if kinds[i] in ("ok", "truncated"):
                more = 3 * (kinds[i] == "truncated")
                go(i + 1, left - more, cost + more, audit + "K", [*said, (r, x)])
                for role in ("user", "assistant"):
                    go(i + 1, left - more - 3, cost + more + 3, audit + "R", [*said, (role, x)])

    for limit in itertools.count():
        go(0, limit, 0, "", [])
        if ends:
            break
    cost, audit, text = min(ends)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(seed, n, most):
    rng, out = random.Random(seed), {}
    for c in range(n):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "tool", "", None]])
        turns = [rng.choice([None, *range(-3, 9)]) for _ in range(rng.randint(1, most))]
        out[c if c else None] = [(t, rng.choice(roles), rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "Why?", "so. "])) for t in turns]
    return out


@pytest.mark.parametrize("segment", [1, 2, 3, repair.SEGMENT])
def test_repair_is_the_cheapest_and_least_of_all_edits(spark, segment):
    made = conversations(5, 70, 4)
    frame = spark.createDataFrame([(c, *r) for c, rows in made.items() for r in rows], TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame, segment).collect()}
    assert got == {c: plain(rows) for c, rows in made.items()}


def test_pieces_of_any_size_give_the_same(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['a', 'b', 'c'])}{t % 7}{rng.choice(['.', '.', ''])}") for c in range(4) for t in range(300)]
    rows += [(9, 5, "user", f"tie {i}.") for i in range(20)] + [(9, 5, "user", "same.")] * 20
    frame = spark.createDataFrame(rows, TURNS)
    whole, cut = ({r["conv_id"]: tuple(r) for r in repair.repair(frame, s).collect()} for s in (100_000, 7))
    assert whole == cut and len(whole) == 5
    lines = repair.repaired_turns(frame, 7).orderBy("conv_id", "seg", "k", "pos").collect()
    for c, row in whole.items():
        mine = [r for r in lines if r["conv_id"] == c]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == row[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in mine))


def test_query_on_small_tables_and_awkward_rows(spark, tmp_path):
    assert difference(queries.QUERIES["op12_structure_repair"](spark, SF), queries.ORACLES["op12_structure_repair"], SF) is None
    rows = [(None, None, None, None), (1, None, "user", ""), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, 3, "assistant", "x" * 200_000 + ".")]
    spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as seg", "2 as k", "3 as mark", "'x' as key", "4 as hit", "5 as whole").write.parquet(f"{tmp_path}/conversations.parquet")
    path = str(tmp_path)
    assert difference(queries.op12_structure_repair(spark, path), queries.ORACLES["op12_structure_repair"].replace("FROM conversations", f"FROM '{path}/conversations.parquet/*.parquet'"), SF) is None
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(empty).count() == 0 and repair.repaired_turns(empty).count() == 0
