"""The divergence audit against exact sums in plain Python, tiles of any size, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from compare import difference

from cuelake.llm import divergence, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def plain(rows):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")), lang or "", s or "") for _, t, lang, s, _ in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own, count, df = {d[2] for d in docs if d[1] == lang}, defaultdict(Counter), Counter()
        for terms, la, s in docs:
            if la == lang:
                count[s].update(terms)
                df.update({*terms})
        kept = [t for t in df if df[t] >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(count[s]) for s in own}
        q = share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own - {s}))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:200])]
    return sorted(out)


def documents(seed, n, n_sources, n_terms):
    rng = random.Random(seed)
    terms = [f"{a}{b}{c}" for a in "aBéß中" for b in ("x", "Yz", "ö") for c in (*"klmnopqrst", "Σ")][:n_terms]
    return [
        (i, rng.choice([None, "", *[", ".join(rng.choices(terms, weights=range(1, len(terms) + 1), k=rng.randint(1, 40))) + " 12#a_b" for _ in range(9)]]), rng.choice(["en", "en", "de", None, "xx"] if i else ["solo"]), rng.choice([None, *map(str, range(n_sources))]), 0)
        for i in range(n)
    ]


def test_audit_is_the_plain_sum(spark, monkeypatch):
    rows = documents(3, 240, 9, 165)
    rows.append((999, "lonely words here", "tiny", "a", 1))
    rows.append((998, None, "tiny", "b", 1))
    want = plain(rows)
    assert any(r[0] == "tiny" and r[4] == 0 for r in want)
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as term", "2 as block", "3 as tile", "4 as g")
    assert sorted(map(tuple, divergence.audit(frame).collect())) == want
    for name, value in (("CELLS", 40), ("GROUPS", 4), ("AT_ONCE", 64), ("HELD", 10), ("LANGS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(frame).collect())) == want


def test_only_two_hundred_terms_of_ties(spark):
    rows = [(i, " ".join(f"t{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abc'[k // 100]}" for k in range(260)), "en", "a", 0) for i in range(3)] + [(9 + i, "other", "en", "b", 0) for i in range(3)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == plain(rows) and sum(r[2] == "term" and r[1] == "a" for r in got) == 200


def test_shares_are_exact_for_very_large_counts():
    rng = random.Random(1)
    counts = [0, 1, 10**13, 4 * 10**14] + [rng.randrange(10**14) for _ in range(50)]
    total = [9 * 10**15 - 7] * len(counts)
    got = divergence.shares(np.array(counts), np.array(total))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, total)]


def test_query_is_its_sql_and_an_empty_table_is_empty(spark):
    assert difference(queries.QUERIES["op13_source_divergence"](spark, SF), queries.ORACLES["op13_source_divergence"], SF) is None
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
