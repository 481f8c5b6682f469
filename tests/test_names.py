"""The nearest names against a comparison of every typed text with every name."""

import random

from cuelake.operators import names as N


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def suggestion(typed, names):
    distance, name = min((edits(typed, n), n) for n in names)
    return (typed, name, distance) if distance <= max(1, min(3, max(len(typed), len(name)) // 3)) else None


def test_nearest_is_the_least_of_all(spark):
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("abß字") for _ in range(rng.randint(low, high)))
    names = [word(0, 4) for _ in range(12)] + [word(4, 13) for _ in range(80)]
    typed = [word(0, 12) for _ in range(250)] + names[:9] + ["", "abababab", "zzzzzzzzzzzz"]
    for n in names[20:70]:
        t = list(n)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "字"])
        typed.append("".join(t))
    got = N.nearest(spark.createDataFrame([(t,) for t in typed + [None, "", "ab"]], "typed string"), spark.createDataFrame([(n, 1) for n in names + names[:3] + [None]], "name string, typed int"))
    want = {s for t in {*typed, "ab"} if (s := suggestion(t, names))}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[2] for r in rows} == {0, 1, 2, 3} and len(want) < len(set(typed))


def test_no_names_or_nothing_typed(spark):
    none, some = spark.createDataFrame([], "typed string"), spark.createDataFrame([("ab",)], "name string")
    assert N.nearest(none, some).count() == 0
    assert N.nearest(some.toDF("typed"), some.where("false")).count() == 0


def test_left_out_counts_every_choice_once(spark):
    got = spark.createDataFrame([("abcdefgh",), ("",), ("aa",)], "t string").select(*[N.left_out(N.F.col("t"), k) for k in (1, 3)]).collect()
    assert [[len(c) for c in r] for r in got] == [[9, 93], [1, 1], [2, 3]]
