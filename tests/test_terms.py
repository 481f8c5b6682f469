"""Dictionary terms against a plain search, with one automaton and with many shards."""

import random
import time
import unicodedata

from cuelake.operators import terms

TEXTS, FORMS = "doc long, part long, text string", "entry_id string, form string, case_sensitive boolean"


def plain(texts, forms):
    key = lambda x, exact: (lambda y: y if exact else y.lower())(unicodedata.normalize("NFC", x))
    return {(d, p, e) for d, p, t in texts if t for e, f, exact in forms if f and key(f, exact) in key(t, exact)}


def test_terms_are_those_of_a_plain_search(spark):
    rng = random.Random(8)
    letters = ["a", "b", "A", "B", "é", "É", "é", "中", " ", "ß", "İ"]
    texts = [(i, i % 3, None if i % 17 == 0 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    forms = [(f"e{i % 40}", None if i % 23 == 0 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))), rng.choice([True, False, None])) for i in range(160)]
    frames = spark.createDataFrame(texts, TEXTS).selectExpr("*", "1 as form", "2 as entry_id"), spark.createDataFrame(forms, FORMS)
    want = plain(texts, forms)
    assert len(want) > 500
    for shard in (terms.SHARD, 30):
        got = terms.term_matches(frames[0], ["doc", "part"], frames[1], shard).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_dictionary_and_no_texts(spark):
    texts, forms = spark.createDataFrame([(1, 1, "abc")], TEXTS), spark.createDataFrame([("e", "b", True)], FORMS)
    assert terms.term_matches(texts, ["doc"], forms.where("false")).count() == 0
    assert terms.term_matches(texts.where("false"), ["doc"], forms).count() == 0
    assert terms.term_matches(texts, ["doc"], forms).count() == 1


def test_a_large_dictionary_takes_one_scan(spark):
    """Ten thousand entries of a hundred forms each: the most that one dictionary may have."""
    forms = spark.range(10_000).selectExpr("concat('entry-', id) as entry_id", "explode(transform(sequence(0, 99), k -> concat(hex(id * 100 + k), 'x', k))) as form", "id % 2 = 0 as case_sensitive")
    texts = spark.range(2_000).selectExpr("id as doc", "0L as part", "concat('some words ', hex(id * 100 + 7), 'x7 and more words ', lower(hex(id * 100 + 9)), 'x9') as text")
    began = time.time()
    got = {(r["doc"], r["entry_id"]) for r in terms.term_matches(texts, ["doc"], forms, 1 << 24).collect()}
    assert {(i, f"entry-{i}") for i in range(2_000)} <= got and time.time() - began < 120


def shared_forms():
    """Forty entries that share forms, in texts of which some keys have several."""
    rng = random.Random(3)
    texts = [(i % 25, 0, "".join(rng.choice("abcdX ") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return texts, [(f"e{i}", f, i % 4 == 0) for i in range(40) for f in rng.sample(["a", "b", "ab", "cd", "X", "never there"], 3)]


def test_entries_of_a_class_follow_without_another_look(spark, monkeypatch):
    """Rows of texts and entries aren't made distinct one by one, and a class's entries are dealt out in lists."""
    monkeypatch.setattr(terms, "TOGETHER", 2)
    texts, forms = shared_forms()
    found = terms.term_matches(spark.createDataFrame(texts, TEXTS), ["doc"], spark.createDataFrame(forms, FORMS), 4)
    plan = str(found._jdf.queryExecution().executedPlan())
    assert "HashAggregate" not in plan.split("SortMergeJoin")[0]
    got, want = [tuple(r) for r in found.collect()], {(d, e) for d, _, e in plain(texts, forms)}
    assert set(got) == want and len(got) == len(want) > 300


def test_counts_of_entries_need_no_row_an_entry(spark):
    texts, forms = shared_forms()
    found = terms.entry_counts(spark.createDataFrame(texts, TEXTS), ["doc"], spark.createDataFrame(forms, FORMS))
    want = {}
    for d, _, e in plain(texts, forms):
        want.setdefault(d, set()).add(e)
    assert sorted(map(tuple, found.collect())) == sorted((d, len(e), min(e)) for d, e in want.items())
