"""The toxicity lexicon: held-out accuracy, folding and matching against brute force, copies, exceptions, awkward rows."""

import random
import zlib

from cuelake.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.1"
PLAIN = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st")]


def prose(rng, n):
    return " ".join(rng.choice(PLAIN) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_held_out_documents_are_judged_rightly(spark):
    got = queries.QUERIES["op11_toxicity"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 10_000
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic, clean = [r for r in held if r["toxic"]], [r for r in held if not r["toxic"]]
    # some labels are noise: junk that no word tells
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.9 and sum(r["predicted"] for r in clean) / len(clean) < 0.005


def labelled(spark, rng, n=600):
    """Toxic ones have insults, some spelled oddly, and word beginnings; all may be copies of one another. `vile` is toxic but in `vile weather`."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(rng, rng.randint(20, 120)).split()
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["dolt", "D0LT!", "doІt", "vile", "grump" + rng.choice(PLAIN)]))
        elif i % 12 == 0:
            words[4:4] = ["vile", "weather"]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    copied = "unseenword " + prose(rng, 60) + " dolt vile dolt"
    for i in range(n, n + 40):
        rows.append((i, copied + (" " + rng.choice(PLAIN)), "en", "s", 1))
        labels.append((i, 1, 1))
    return rows, labels


def test_lexicon_has_words_beginnings_and_exceptions_but_no_words_of_copies(spark):
    rows, labels = labelled(spark, random.Random(4))
    lexicon = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"dolt ", "vlle ", "grump"} <= {*lexicon.weights} and ("vlle ", 1, "weather") in lexicon.phrases
    assert not any(p.startswith("unseen") for p in lexicon.weights) and len(lexicon.weights) < 8
    texts = ["You d0lt, you gгumpfish dоlt", prose(random.Random(9), 50) + " vile weather", prose(random.Random(9), 50) + " vile, vile dolt", "", None, "1 0 5 " * 50, "grump" * 2]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), lexicon).collect()}
    assert got[0] > 0.5 and got[2] > 0.5 and got[1] < 0.5 and got[3] == got[4] == got[5] == min(got.values())


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(2)
    patterns = ["abl ", "ab", "cabba ", "bbc", "cc "]
    found = toxicity.automaton(patterns)
    for _ in range(300):
        text = "".join(rng.choice("aAbBcC4@ ,.аéＢ") for _ in range(rng.randint(0, 60)))
        folded = toxicity.fold(text)
        assert len(folded) == len(text)
        want, at = [], 0
        words = folded.split()
        for k, w in enumerate(words):
            at = folded.index(w, at)
            fits = [p for p in patterns if (p[:-1] == w if p.endswith(" ") else w.startswith(p))]
            if fits and any(c.isalpha() for c in text[at : at + len(w)]):
                want.append((max(fits, key=len), words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
            at += len(w)
        n, hits = toxicity.matches(text, found)
        assert n == len(words) and sorted(hits) == sorted(want), text


def test_folding():
    assert toxicity.fold("Ѕtuріd 1D10T p@thetic ＩＤＩＯＴ $cum") == "stupld ldlot pathetlc ldlot scum"


def test_without_labels_of_both_kinds_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, None), (None, None, None, None, None), (1, "a b c", "x", "y", 2), (2, "x" * 300_000, "x", "y", 2)], DOCS).selectExpr("*", "1 as toxic", "2 as score", "3 as hits")
    for labels in ([], [(2, None, None), (None, 1, 1)], [(2, 1, 0), (1, 1, 0)]):
        lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert lexicon.weights == {} and [r["score"] for r in toxicity.score(docs, lexicon).collect()] == [0.0] * 4
    assert toxicity.score(docs.where("false"), lexicon).count() == 0
    assert toxicity.fit(docs.where("false"), spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")).share == 0.0
