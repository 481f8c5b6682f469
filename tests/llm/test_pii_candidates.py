"""Candidates of personal data that stand beside each other, or are spelled in any case."""

import pytest

import numpy as np

from cuelake.llm import pii


@pytest.fixture(scope="module")
def detector():
    return pii.train()


@pytest.mark.parametrize("text", ["jane (AT) example.org", "jane [At] example [Dot] org", "jane at example.com", "jane AT example DOT com"])
def test_spelled_addresses_in_any_case(text):
    assert ("email", 0, len(text)) in set(pii.candidates(text))
    assert pii._SOME.search(text)


def test_hexadecimal_groups_without_digits_are_searched():
    assert pii._SOME.search("host dead:beef::cafe now") and ("ip", 5, 20) in set(pii.candidates("host dead:beef::cafe now"))


def test_every_run_of_groups_is_a_candidate():
    for a, b in (("212-555-1234", "212-555-9876"), ("(212) 555-1234", "(646) 555-9876"), ("2024-05-06", "212-555-1234")):
        got = set(pii.candidates(f"{a} {b}"))
        assert ("phone", 0, len(a)) in got and ("phone", len(a) + 1, len(a) + 1 + len(b)) in got
    assert ("card", 0, 19) in set(pii.candidates("4111.1111.1111.1111 12/25"))


def test_numbers_beside_each_other_are_found(detector):
    two = "call (212) 555-1234 (646) 555-9876 today"
    assert pii.search(two, detector)[1] and sorted(pii.search(two, detector)[1]) == [("phone", 5, 19), ("phone", 20, 34)]
    card = "pay with card 4111.1111.1111.1111 12/25 today"
    assert ("card", 14, 33) in pii.search(card, detector)[1]


def brute_found(detector, text, base):
    """The definition: likeliest first, each candidate that overlaps neither a base span nor a finding before it."""
    apart = lambda c, d: c[2] <= d[1] or d[2] <= c[1]
    proposed = [c for c in dict.fromkeys(pii.candidates(text)) if all(apart(c, b) for b in base)]
    scores = detector.probabilities(np.array([pii.features(text, *c) for c in proposed], float).reshape(len(proposed), len(pii.FEATURES)))
    out = []
    for score, _, c in sorted((-s, k, c) for k, (s, c) in enumerate(zip(scores, proposed))):
        if -score >= detector.thresholds[c[0]] and all(apart(c, d) for d in out):
            out.append(c)
    return out


def test_findings_match_brute_force_and_ignore_other_text():
    detector = pii.train()
    texts = [". ".join(t) for t in zip(*(pii.cases(120, seed)[0] for seed in (3, 4, 5, 6)))]
    texts += ["a@b.cc 212-555-1234 4111 1111 1111 1111 12/25 1.2.3.4 call (212) 555-9876, 646.555.1111", "", "7 8 9 " * 40]
    for text in texts:
        base = pii.base_spans(text)
        found = detector.found(text, base)
        assert found == brute_found(detector, text, base)
        assert pii.search(text + "\n\n" + "antidote x" * 3, detector)[1] == found
    for text in ("ping host dead:beef:cafe:babe:face:feed:abba:bead now", "write to john.doe (AT) example (Dot) com", "write to john.doe [At] example [DOT] org"):
        assert len(detector.found(text, [])) == 1 and pii._SOME.search(text)


def test_unseen_cases_are_settled_by_the_trees():
    detector = pii.train()
    texts, spans, truth = pii.cases(3_000, seed=99)
    found = np.array([any(c == s for c in detector.found(t, [])) for t, s in zip(texts, spans)])
    assert (found & truth).sum() / truth.sum() > 0.9 and (found & truth).sum() / found.sum() > 0.95


def test_very_many_numbers_take_time_in_proportion():
    detector, text = pii.train(), "call 212-555-1234, " * 20_000
    assert len(detector.found(text, pii.base_spans(text))) == 20_000


@pytest.mark.parametrize("text", ["anndshen at areedtionea. Tian went", "toththanwh at thlyonin. The rest", "onst. At and. Erntor. Onenshea. The end", "look at this. Then go", "we stood at point. Dot had gone", "meet at noon - or later"])
def test_prose_across_a_sentences_end_is_no_address(detector, text):
    assert pii.search(text, detector)[1] == []


@pytest.mark.parametrize(
    "text",
    ["jane(at)example(dot)com", "bob [at] corp.co.uk", "mail jane_at_example.com today", "anna -at- example -dot- org", "kim at mail dot example dot net", "Write to J.DOE AT EXAMPLE DOT ORG please", "ask lee.wong (at) uni.example [dot] edu now"],
)
def test_spelled_addresses_are_found_without_a_cue(detector, text):
    assert [k for k, *_ in pii.search(text, detector)[1]] == ["email"]


def test_no_added_address_in_the_tables(detector):
    """The tables' prose spells no address, and has many an `at` before a sentence's end."""
    import duckdb

    texts = [t for (t,) in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE contains(text, ' at ')").fetchall()]
    assert len(texts) > 100 and not [m for t in texts for m in pii.search(t, detector)[1] if m[0] == "email"]
