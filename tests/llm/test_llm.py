"""Small tables against brute force, and the cases that each docstring defines."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuelake.llm import bpe, chat, decontaminate, linededup, lm, pii, quality, secretscan, simhash, tokenfile
from cuelake.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def awkward(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    long = " ".join(WORDS[i * i % 19] + str(i % 97) for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", None, None, 1), (3, long, "en", "s", 5), (4, " \n\t \n", "en", "s", 5)]
    rows += [(5, "same text\nsame text", "en", "s", 1)] * 3 + [(6, "\n".join(["a line of several words that is said again"] * 4), None, "x", 2), (7, "é Σ 中 😀 x", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


# --- quality ---------------------------------------------------------------------------------------------

def test_quality_measures_match_brute_force(spark):
    import re

    rng = random.Random(1)
    texts = ["\n".join(prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts += ["TO!! BE!! OR!! | # x\nTO!! BE!! OR!!\nTO!! BE!! OR!!", "a b c a b c a b c", "x"]
    got = {r["doc_id"]: r for r in quality.ledger(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 4))
    texts = [good, good.upper(), " ".join(w + "***" for w in good.split()), "short", None]
    entries = quality.ledger(docs_of(spark, texts))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.apply_policy(entries).collect()}
    assert kept == {0: (False, True), 1: (False, False), 2: (False, False), 3: (True, False), 4: (True, False)}
    assert {r["doc_id"] for r in quality.apply_policy(entries, 1).where("kept").collect()} == {0, 1, 2}
    alone = {r["rule"]: (r["n_failed"], r["n_alone"]) for r in quality.ablations(entries).collect()}
    assert alone["capitals"] == (1, 1) and alone["symbols"] == (1, 1) and alone["few_words"][0] == 2


def test_quality_awkward_and_clashing_names(spark):
    rows = quality.ledger(awkward(spark)).collect()
    assert len(rows) == 10 and all(r["n_words"] is not None for r in rows)
    odd = awkward(spark).selectExpr("*", "1 as t", "2 as w", "3 as failures", "4 as kept", "5 as lines")
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {3}
    assert quality.ledger(odd.where("false")).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------

def brute_lines(docs, need):
    """docs: id -> text. Every run of lines with words that has `need` words and an equal run before it goes."""
    lines = {d: [(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for d, t in sorted(docs.items())}
    places, gone = defaultdict(list), defaultdict(set)
    for d, ls in lines.items():
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(n for _, _, n in ls[a:b]) >= need:
                    places[tuple(x for _, x, _ in ls[a:b])].append((d, a, b))
    for same in places.values():
        for d, a, b in same:
            if any(e < d or (e == d and q <= a) for e, _, q in same):
                gone[d].update(i for i, _, _ in lines[d][a:b])
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 9])).replace(",", "").replace(".", "") for _ in range(25)]
    docs = {d: "\n".join(rng.choice([*pool, ""]) if rng.random() < 0.8 else prose(rng, 4) for _ in range(rng.randint(1, 14))) for d in range(80)}
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(docs_of(spark, list(docs.values()), list(docs))).collect()}
    assert got == brute_lines(docs, linededup.MIN_WORDS)


def test_line_dedup_loses_no_run_behind_a_line_that_stands_alone_before(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "un deux trois quatre cinq"
    eight, short = "this line has eight words in all now", "and a tail"
    texts = [f"{a}\n{c}", f"{a}\n{b}", f"{a}\n{b}", eight, f"{eight}\n{short}", f"{eight}\n{short}", "\n".join([b] * 5), "\n".join(["la la la la"] * 7)]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(docs_of(spark, texts)).collect()}
    assert got == brute_lines(dict(enumerate(texts)), linededup.MIN_WORDS)
    assert got[2] == "" and got[4] == short and got[5] == ""


def test_line_dedup_takes_texts_of_very_many_lines(spark):
    text = "\n".join(f"line {i} of a very long text that goes on" if i % 3 else f"short {i}" for i in range(200_000))
    got = {r["doc_id"]: (r["text"], r["n"]) for r in linededup.deduplicate(docs_of(spark, [text, text])).select("doc_id", "text", F.col("__removed_lines").alias("n")).collect()}
    assert got == {0: (text, 0), 1: ("", 200_000)}


def test_line_dedup_awkward(spark):
    odd = awkward(spark).selectExpr("*", "1 as d", "2 as k", "3 as pos", "4 as h")
    out = linededup.deduplicate(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert len(rows) == 10
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["text"])
    assert by[1] == [None] and by[2] == [""] and by[None] == ["no id here"] and by[4] == [" \n\t \n"]
    assert by[6] == ["a line of several words that is said again"] and by[5] == ["same text\nsame text"] * 3
    assert linededup.deduplicate(odd.where("false")).count() == 0


# --- simhash ---------------------------------------------------------------------------------------------

def brute_simhash(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_is_the_definition():
    rng = random.Random(3)
    for t in ["", "a", "a b", "A b C", "x y É z\x0bq", *(prose(rng, rng.randint(1, 40)) for _ in range(50))]:
        assert simhash.simhash(t.encode()) == brute_simhash(t)


@pytest.mark.parametrize("wide", [64, 1])
def test_links_connect_what_is_close(spark, wide):
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 8)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(prints, 2):
        if bin(a ^ b).count("1") <= 2:
            parent[find(a)] = find(b)
    want = Counter(frozenset(q for q in prints if find(q) == find(p)) for p in prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    groups = defaultdict(set)
    for r in connected_components(simhash.links(frame, wide=wide)).collect():
        groups[r["component"]].add(r["node"] % 2**64)
    got = {frozenset(g) for g in groups.values()}
    assert got == {g for g in want if len(g) > 1}


def test_components_on_a_path_and_awkward_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (7, None), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_duplicates_awkward(spark):
    odd = awkward(spark).selectExpr("*", "1 as fp", "2 as component", "3 as component_id")
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[2] == by[4] == 1 and by[5] == 5 and by[3] == 3
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, None: 1, 3: 1, 5: 3, 6: 1, 7: 1}
    assert simhash.near_duplicates(odd.where("false")).count() == 0


# --- decontamination -------------------------------------------------------------------------------------

def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


QUESTION = "A farmer named Tom has 12 apples and buys 7 more apples while Tom sells some for 3 dollars each at market"


def test_reparameterised_questions_are_found(spark):
    rng = random.Random(5)
    filler = prose(rng, 60)
    docs = [
        f"{filler} {QUESTION} {filler}",
        filler + " " + QUESTION.replace("Tom", "Ann").replace("12", "40").replace("7", "5").replace("3", "9"),
        filler + " " + QUESTION.replace("Tom", "Ann", 1).replace("Tom", "Bob"),  # no one value for Tom
        filler.upper() + " " + QUESTION.upper(),
        filler,
        " ".join(QUESTION.split()[:8]) + " " + filler,
        None,
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs_of(spark, docs), items_of(spark, [QUESTION, prose(rng, 30), QUESTION, None, "too short"])).collect()}
    assert got == {0: [0], 1: [0], 3: [0]}


def test_items_are_found_in_any_case(spark):
    item = "Then Anna and Boris met Clara near Dover while Emil, Frida and Gustav saw Hanna with Ivan and Jonas before Karin and Lars left Malta at noon."
    rng = random.Random(8)
    copies = [item, item.lower(), item.upper(), item.title(), item.swapcase(), "".join(rng.choice([c.lower(), c.upper()]) for c in item)]
    docs = [f"{prose(rng, 40)} {c} {prose(rng, 40)}" for c in copies] + [prose(rng, 120)]
    got = {r["doc_id"] for r in decontaminate.contaminated(docs_of(spark, docs), items_of(spark, [item])).collect()}
    assert got == set(range(len(copies)))


def brute_matches(docs, items):
    """All windows of all items against all of all documents, by the definitions: item -> found documents."""
    from cuelake.llm.decontaminate import LITERALS, RUN, SHARE, WINDOW, code, template

    class Codes(dict):
        def __missing__(self, w):
            return code(w)

    def forms(text):
        _, kind, own, words = template(text.encode(), Codes())
        bare = [decontaminate._OUTER.sub("", w.decode()).lower() for w in words]
        for names in (True, False):
            places = [k if k and (names or k != 2) else 0 for k in kind.tolist()]
            key = [f"<{p}>" if p else w for p, w in zip(places, bare)]
            yield {i: (tuple(key[i : i + WINDOW]), [(p, w) for p, w in zip(places[i : i + WINDOW], bare[i : i + WINDOW]) if p]) for i in range(len(key) - WINDOW + 1) if places[i : i + WINDOW].count(0) >= LITERALS}

    out = defaultdict(set)
    for d, text in docs.items():
        theirs = [(i, *w) for f in forms(text) for i, w in f.items()]
        for k, item in items.items():
            for second, own in enumerate(forms(item)):
                aligned = defaultdict(list)
                for q, (key, slots) in own.items():
                    for p, other, values in theirs:
                        if other == key:
                            aligned[p - q].append((q, list(zip(slots, values))))
                good = [{q for q, _ in v} for v in aligned.values() if len({a for _, s in v for a, _ in s}) == len({x for _, s in v for x in s})]
                runs = [sum(all(q + j in g for j in range(RUN)) for q in g) if second else len(g) >= RUN for g in good]
                if good and (len(set().union(*good)) >= SHARE * len(own) or any(runs)):
                    out[k].add(d)
    return dict(out)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    names, frame = ["Tom", "Ann", "Bob"], "how many km are left when {n} has {a} km and {m} takes {b} of them on the way home"
    items = [frame.format(n=rng.choice(names), m=rng.choice(names), a=rng.randint(2, 50), b=rng.randint(2, 9)) + " " + prose(rng, rng.randint(0, 8)) for _ in range(6)]
    docs = []
    for _ in range(60):
        text = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice([*names, *WORDS, "7", "km"])
        a = rng.randint(0, len(text) // 2)
        docs.append(f"{prose(rng, 12)} {' '.join(text[a:] if rng.random() < 0.5 else text)} {prose(rng, 5)}")
    got = defaultdict(set)
    for r in decontaminate.contaminated(docs_of(spark, docs), items_of(spark, items)).collect():
        for k in r["item_ids"]:
            got[k].add(r["doc_id"])
    want = brute_matches(dict(enumerate(docs)), dict(enumerate(items)))
    assert got == want and 10 < sum(map(len, want.values())) < 300


def test_decontaminate_awkward(spark):
    odd = awkward(spark).selectExpr("*", "1 as id", "2 as hash", "3 as item_id")
    clean = decontaminate.decontaminate(odd, items_of(spark, [QUESTION, "a line of several words that is said again", "", None]))
    assert clean.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(["1", "2", "None", "3", "4", "5", "5", "5", "7"])
    none = items_of(spark, [QUESTION]).where("false")
    assert decontaminate.decontaminate(odd, none).count() == 10
    assert decontaminate.decontaminate(odd.where("false"), items_of(spark, [QUESTION])).count() == 0


# --- chat ------------------------------------------------------------------------------------------------

def test_chat_turns_read_back():
    rng = random.Random(6)
    for _ in range(3000):
        role = "".join(rng.choice(["user", "a", ":", "\\", "#", "<", "</turn>", "\n", ""]) for _ in range(rng.randint(0, 4)))
        text = "".join(rng.choice(["###", "#", "\\", "</turn>", "<", "### assistant: ", "x", "\n", "é", ": "]) for _ in range(rng.randint(0, 8)))
        other = chat.render("assistant", "ok")
        turns = chat.parse(chat.render(role, text) + other)
        assert [(r, t) for r, t, *_ in turns] == [(role, text), ("assistant", "ok")]
    assert chat.render("user", "plain # < text") == "### user: plain # < text</turn>\n"


def test_chat_takes_very_long_texts(spark):
    text = "plain words # and <tags> \\\\ </turn> ### x: " * 40_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_turns(rows)).first()
    assert got["loss_chars"] == len(text) and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chat_digests_awkward(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, None, None), (None, 0, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    frame = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, rendered int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[1]["loss_sha256"] == sha(said) and got[1]["loss_chars"] == len(said)
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[None]["loss_sha256"] == sha("x")
    assert got[3]["n_turns"] == 3 and got[3]["loss_sha256"] == sha("aab")
    assert chat.digests(chat.format_turns(frame.where("false"))).count() == 0


# --- tokens ----------------------------------------------------------------------------------------------

ODD = list("abcXYZ  \n\t'’s.,!?<|>019éÉßΣσςİıñ中かな́̈　​\xa0\x85\x1c\x0b 😀ǅﬁⅣ½²\x00﻿") + ["'re", " 's", "<|startoftext|>", "<|endoftext|>", "\n\n", "***", "word"]


def odd_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_is_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.WordBPE(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for t in odd_texts(4000):
        ids = library.encode(t, add_special_tokens=False).ids
        assert array("I", own.encode(t)).tolist() == ids, t
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_awkward(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = awkward(spark).selectExpr("*", "1 as ids", "2 as n_tokens")
    rows = bpe.digests(odd, path).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    assert len(bpe.encode(odd, path, decode=True).collect()) == 10 and bpe.digests(odd.where("false"), path).count() == 0


def test_token_files_are_the_librarys_in_order(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), odd_texts(600)
    ids = random.Random(8).sample(range(10_000), len(texts))
    got = tokenfile.round_trip(docs_of(spark, texts, ids).repartition(5), path).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(sorted(zip(ids, texts)), got, strict=True):
        tokens = library.encode(t, add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(tokens), zlib.crc32(array("I", tokens).tobytes())), t
        start += len(tokens)


def test_token_files_awkward(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = awkward(spark).selectExpr("*", "1 as file", "2 as tokens")
    rows = sorted(tokenfile.round_trip(odd, path).collect(), key=lambda r: r["start"])
    assert len(rows) == 10 and rows[0]["doc_id"] is None and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert tokenfile.round_trip(odd.where("false"), path).count() == 0


# --- personal data ---------------------------------------------------------------------------------------

def brute_base(t):
    import re

    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(q) > 255 for q in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(9)
    for _ in range(30_000):
        t = "".join(rng.choice("0123456789012345..--  ()+@@ab_%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_base(t), t


def test_boosted_candidates_hold_out():
    detector = pii.train()
    texts, spans, truth = pii.cases(2000, seed=123)
    p = detector.probabilities(np.array([pii.features(t, *s) for t, s in zip(texts, spans)], float))
    found = np.array([q >= detector.thresholds[s[0]] for q, s in zip(p, spans)])
    assert (found & truth).sum() / found.sum() > 0.97 and (found & truth).sum() / truth.sum() > 0.9
    text = "mail a@b.co or call (415) 555-2671 today"
    base, more = pii.search(text, detector)
    assert base == [("email", 5, 11)] and [k for k, *_ in more] == ["phone"]
    assert pii.redact(text, base + more) == "mail [EMAIL] or call [PHONE] today"


def test_pii_awkward(spark):
    odd = awkward(spark).selectExpr("*", "1 as spans", "2 as n_email")
    rows = pii.find(odd, with_text=True).collect()
    assert len(rows) == 10 and pii.find(odd.where("false")).count() == 0
    assert {r["base_sha256"] for r in rows if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}


# --- secrets ---------------------------------------------------------------------------------------------

def test_secrets_hold_out(spark):
    forest, lines = secretscan.train(spark), secretscan.findings(800, seed=99)
    frame = spark.createDataFrame([(i, x) for i, x, _ in lines], "doc_id long, text string")
    rows = secretscan.scan(frame, forest).collect()
    got, real = {r["doc_id"] for r in rows}, {i for i, _, y in lines if y}
    assert len(got & real) / len(got) > 0.97 and len(got & real) / len(real) > 0.95
    texts = {i: x for i, x, _ in lines}
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"] for r in rows)
    odd = awkward(spark).selectExpr("*", "1 as value", "2 as start", "3 as t", "4 as c")
    assert secretscan.scan(odd, forest).count() == 0 and secretscan.scan(odd.where("false"), forest).count() == 0
    twice = 'token = "0123456789abcdef0123456789abcdef01234567" token = "9123456789abcdef0123456789abcdef01234567"'
    assert [r["start"] for r in secretscan.scan(docs_of(spark, [twice]), forest).orderBy("start").collect()] == [9, 60]


def test_token_files_ignore_the_limit_of_records_a_file(spark):
    docs = docs_of(spark, ["alpha beta"] * 12)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        rows = tokenfile.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    starts = [0]
    for r in rows[:-1]:
        starts.append(starts[-1] + r["n_tokens"])
    assert [r["start"] for r in rows] == starts


# --- language model --------------------------------------------------------------------------------------

def test_lm_learns_both_sides_and_scores_by_definition(spark):
    rng = random.Random(10)
    chain = ["red green blue", "one two three", "north east south"]
    texts = [" ".join(rng.choice(chain) for _ in range(40)) for _ in range(400)]
    docs = docs_of(spark, texts)
    words, net = lm.fit(docs)
    mean = lambda n, d: np.mean([r["per_token"] for r in lm.score(d, words, n).collect()])
    shuffled = docs_of(spark, [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts])
    assert mean(net, docs) > mean(lm.Network.start(words), docs) + 0.3
    assert mean(net, docs) > mean(net, shuffled) + 0.3
    # one text, a word at a time
    text = "red green blue one unheard"
    ids = [words.id_of(w.encode()) for w in text.split()]
    padded = [words.gap] * 2 + ids + [words.gap] * 2
    total = 0.0
    for i, w in enumerate(ids):
        x = sum(net.inputs[padded[i + 2 + o]].reshape(4, -1)[k] for k, o in enumerate(lm.OFFSETS))
        h = np.tanh(x)
        z = h @ net.output + net.bias
        total += z[words.cls[w]] - np.log(np.exp(z).sum()) + words.share[w]
        for k in range(words.path[w], words.path[w + 1]):
            total -= np.log1p(np.exp(-words.ways[k] * (np.append(h, 1) @ net.nodes[words.nodes[k]])))
    row = lm.score(docs_of(spark, [text]), words, net).first()
    assert row["n_tokens"] == 5 and abs(row["log_likelihood"] - total) < 1e-3


def test_lm_probabilities_add_up_and_begin_as_unigrams(spark):
    words, net = lm.fit(docs_of(spark, [prose(random.Random(k), 200) for k in range(5)]))
    start, everyone = lm.Network.start(words), np.arange(len(words.cls))
    for n, hidden in ((net, np.full((1, lm.HIDDEN), 0.3, np.float32)), (start, np.zeros((1, lm.HIDDEN), np.float32))):
        z = (hidden @ n.output + n.bias)[0]
        logs = (z - np.log(np.exp(z).sum()))[words.cls]
        nodes, ways, of = words.steps(everyone)
        logs = logs - np.bincount(of, np.logaddexp(0, -n.decide(np.repeat(hidden, len(everyone), axis=0), nodes, ways, of)[2]), len(everyone))
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_lm_tells_a_word_from_another_of_its_class(spark):
    """Held out: two words of one frequency, each with neighbours of its own."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["the red cat sat down", "a blue dog ran off"]) for _ in range(100))
    words, net = lm.fit(docs_of(spark, [text() for _ in range(40)]))
    own, other = "the red cat sat down " * 20, "the red dog sat down " * 20
    got = {r["doc_id"]: r["per_token"] for r in lm.score(docs_of(spark, [own, other]), words, net).collect()}
    assert got[0] > got[1] + 0.5


def test_lm_depends_little_on_the_split(spark):
    docs = docs_of(spark, [prose(random.Random(k), 300) for k in range(48)])
    few, many = ({r["doc_id"]: r["per_token"] for r in lm.score(docs, *lm.fit(docs.repartition(n, "doc_id"))).collect()} for n in (2, 6))
    assert max(abs(few[i] - many[i]) for i in few) < 0.1 * abs(np.mean(list(few.values())))


def test_lm_awkward(spark):
    odd = awkward(spark).selectExpr("*", "1 as n", "2 as word", "3 as net")
    words, net = lm.fit(odd)
    rows = {r["doc_id"]: r for r in lm.score(odd, words, net).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["log_likelihood"] == 0 and rows[1]["per_token"] is None and rows[3]["n_tokens"] == 30_000
    none = odd.where("false")
    assert lm.score(none, *lm.fit(none)).count() == 0


def test_lm_looks_words_up_once_for_training_and_scores(spark, tmp_path):
    rows = [(k, prose(random.Random(k), 60)) for k in range(30)] + [(30, None), (31, ""), (None, "One  one"), (5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    words, _ = lm.fit(docs)
    encoded = lm.encode(docs, words).collect()
    ids = {(r["doc_id"], bytes(r["ids"])) for r in encoded}
    assert ids == {(i, array("H", [words.id_of(w) for w in (t or "").lower().encode().split()]).tobytes()) for i, t in rows}
    assert {r["round"] for r in encoded} == set(range(lm.ROUNDS)) and lm.MOST + lm.BUCKETS < 1 << 16
    at_once = sorted(lm.fit_and_score(docs).collect(), key=str)
    assert [r["n_tokens"] for r in at_once] == [r["n_tokens"] for r in sorted(lm.score(docs, *lm.fit(docs)).collect(), key=str)]


def test_lm_averages_many_networks(spark):
    vectors = [np.full(5, k, np.float32) for k in range(7)]
    frame = spark.createDataFrame([(k + 1, bytearray(v.tobytes())) for k, v in enumerate(vectors)], "weight long, net binary").coalesce(1)
    row = frame.mapInArrow(lm._mean_batches, "weight long, net binary").first()
    assert row["weight"] == 28 and np.allclose(np.frombuffer(row["net"], np.float32), sum((k + 1) * k for k in range(7)) / 28)
