"""Personal data: base patterns, and further spans that boosted trees pick from high-recall candidates.

Base spans (e-mail, IP address, card, phone number) are exact patterns with checks; they always stay. They are
found from the runs of digits and the `@` signs of a text, in time linear in its length.

Generators then propose spans that a pattern alone can't settle and that may overlap: digit groups with any
separators (each run of neighbouring groups), addresses spelled with "at" and "dot", colon-separated hexadecimal groups. Each gets features of
its format and of the words beside it; gradient-boosted trees score it, the scores are calibrated on held-out
cases, and a candidate is a finding if it passes its kind's threshold, the lowest with the wanted precision
there. Findings that overlap a base span are dropped, and of overlapping ones the likeliest stays.

The trees are trained on `CASES` generated cases (kinds of personal data and of look-alikes, in context), a
bounded sample on the driver; nothing about the corpus is fitted. The texts stay in their tasks: no shuffle.

Defined cases: null text counts as empty and has no spans; repeated rows are searched each; a null doc_id is
carried through; an empty table gives an empty result. Spans count code points, their end is exclusive. A text with
very many candidates takes time in proportion to them. What stands elsewhere in a text has no part in a span: texts are
passed over only if no pattern of any kind can match in them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import trees

KINDS = ("email", "ip", "card", "phone")
CASES, SEED, ROUNDS, DEPTH, RATE, PRECISION = 6_000, 7, 60, 3, 0.3, 0.995

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by kind in the order of KINDS, then by start."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            parts = (text[a:b].lstrip("0") for a, b in four)
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        size = sum(b - a for a, b in runs[i : j + 1])
        if 13 <= size <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    for a, _ in runs:
        if a and text[a - 1] == "+" and (m := _PHONE.match(text, a - 1)) and 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", a - 1, m.end()))
    return out


# Candidates. Cues are words that stand before a number; fixed values.
_JOIN = r"[ ().\-/_\xa0]{1,2}"
_NUMBER = re.compile(rf"[0-9]+(?:{_JOIN}[0-9]+)*")
_LED, _FOLLOWED = re.compile(rf"([0-9]+)({_JOIN})$"), re.compile(rf"({_JOIN})([0-9]+)")
#: Spaces, dashes and low lines may stand around a spelled sign, but nothing behind a plain dot: there a sentence ends.
_AT = re.compile(r"[ _-]{0,2}(?:\(at\)|\[at\]|(?<=[ _-])at(?=[ _-]))[ _-]{0,2}", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[ _-]{0,2}(?:\(dot\)|\[dot\]|(?<=[ _-])dot(?=[ _-]))[ _-]{0,2}|\.)[A-Za-z0-9-]{2,63})+", re.IGNORECASE)
_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_CUES = {
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|téléphone|telefon|teléfono)\b\W*(?:me |us |at |is |no |number )*\W*$", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b\W*(?:number |no |is )*\W*$", re.IGNORECASE),
    "address": re.compile(r"\b(?:ip|ipv6|address|host|server|from|e-?mail|contact|write|reach)\b\W*(?:me |us |at |is |to )*\W*$", re.IGNORECASE),
    "other": re.compile(r"(?:\b(?:id|no|order|invoice|isbn|version|ver|token|key|sha|hash|part|serial|commit|section|page|date|on|since|build|ref|ticket|total|sum)\b\W*|[#$€£=/\\_]\s?[\"']?)$", re.IGNORECASE),
}
FEATURES = (
    "email ip card phone digits groups shortest longest separators kinds_of_separator plus parenthesis luhn alnum_before alnum_after "
    "cue_phone cue_card cue_address cue_other leading_zero distinct_digits last_label letters dashes_or_dots year "
    "first_group last_group joined_before joined_after same_before same_after"
).split()


def candidates(text: str) -> Iterator[Span]:
    """Every run of neighbouring digit groups with 7 to 19 digits, every spelled address, every hexadecimal one."""
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            start -= text[start - 1 : start] == "+"
            start -= text[start - 1 : start] == "("
            n = 0
            for a, b in groups[i : i + 19]:
                n += b - a
                if n > 19:
                    break
                if n >= 12:
                    yield "card", start, b
                if 7 <= n <= 15:
                    yield "phone", start, b
    last = 0
    for m in _AT.finditer(text):
        if m.start() >= last and (host := _HOST.match(text, m.end())):
            start = end = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < end:
                last = host.end()
                yield "email", start, last
    if ":" in text:
        for m in _HEX.finditer(text):
            yield "ip", m.start(), m.end()


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - 32) : start]
    groups = [len(g) for g in _DIGITS.findall(s)] or [0]
    digits = "".join(c for c in s if c.isdigit())
    separators = [c for c in s if not c.isalnum()]
    led, followed = _LED.search(before), _FOLLOWED.match(text, end)
    return [
        *(float(kind == k) for k in KINDS),
        len(digits), len(groups), min(groups), max(groups), len(separators), len({*separators}),
        float("+" in s), float("(" in s), float(bool(digits) and luhn(digits)),
        float(before[-1:].isalnum()), float(text[end : end + 1].isalnum()),
        *(float(bool(c.search(before))) for c in _CUES.values()),
        float(digits.startswith("0")), len({*digits}), len(re.split(r"[\W_]+", s)[-1]), sum(map(str.isalpha, s)),
        sum(c in "-." for c in separators), float(bool(re.search(r"(?<!\d)(?:19|20)\d\d(?!\d)", s))),
        groups[0], groups[-1], len(led[1]) if led else 0, len(followed[2]) if followed else 0,
        float(bool(led) and led[2] in s), float(bool(followed) and followed[1] in s),
    ]


def cases(n: int = CASES, seed: int = SEED) -> tuple[list[str], list[Span], np.ndarray]:
    """Generated texts, a candidate in each, and whether it's personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(map(chr, rng.integers(97, 123, k)))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + number(14)
        body = next(body[:15] + str(d) for d in range(10) if luhn(body[:15] + str(d)))
        return pick("", " ", "-", ".", "_").join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = pick("2", "3", "5", "7") + number(2), pick("2", "4", "5") + number(2), number(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{pick('1', '44', '49', '33')} {a} {b} {c}", f"+1/{a}/{b}/{c}", f"1-{a}-{b}-{c}")

    def spelled() -> str:
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", "."), ("_at_", "."), (" -at- ", " -dot- "), (" AT ", " DOT "))
        return f"{letters(5)}{pick('', '.')}{letters(4)}{at}{letters(6)}{dot}{pick('com', 'org', 'net', 'de', 'fr')}"

    def six() -> str:
        return ":".join(f"{x:x}" for x in rng.integers(0x100, 0xFFFF, 8))

    def date() -> str:
        y, m, d = rng.integers(1950, 2030), rng.integers(1, 13), rng.integers(1, 29)
        return pick(f"{y}-{m:02}-{d:02} {rng.integers(24):02}", f"{d:02}/{m:02}/{y}", f"{y}{m:02}{d:02}_{number(6)}", f"{y}-{m:02}-{d:02}")

    def prose() -> str:
        return f"{letters(6)} at {letters(7)}.{pick('', ' ')}{letters(5).capitalize()}" if rng.random() < 0.5 else f"{letters(rng.integers(2, 7))} at {letters(rng.integers(3, 8))} dot {letters(rng.integers(5, 8))}"

    def clock() -> str:
        return ":".join(f"{rng.integers(60):02}" for _ in range(3))

    yes = [("card", card, ("card", "visa", "credit card number", "pay with")), ("phone", phone, ("call", "tel", "phone", "reach me at", "fax:")), ("email", spelled, ("contact", "write to", "e-mail", "mail")), ("ip", six, ("host", "from", "server", "ping"))]
    no = [
        ("card", lambda: number(16), ("order", "id", "token =", "serial", "#")), ("card", lambda: number(rng.integers(12, 20)), ("the", "of", "key", "part", "isbn")),
        ("phone", lambda: number(rng.integers(7, 16)), ("order", "id", "the", "#", "invoice", "no", "total")), ("phone", date, ("on", "since", "the", "date", "version")),
        ("phone", lambda: f"{number(1)}.{number(2)}.{number(4)}", ("version", "build", "section")), ("phone", lambda: " ".join(number(2) for _ in range(5)), ("sum", "of", "the", "and")),
        ("email", prose, ("look", "the", "was", "and")), ("email", lambda: f"{letters(5)} at {letters(5)} dot", ("a", "the")), ("ip", clock, ("at", "until", "time")),
        ("phone", lambda: f"{number(3)}-{number(10)}", ("isbn", "part", "ref")), ("card", lambda: f"{number(4)} {number(4)} {number(5)}", ("page", "total", "the")),
    ]
    texts, spans, truth = [], [], []
    while len(texts) < n:
        real = bool(rng.integers(2))
        kind, make, cues = pick(*yes) if real else pick(*no)
        cue = pick(*cues) if rng.random() < 0.7 else letters(5)
        left, value, right = f"{letters(4)} {letters(6)} {cue} ", make(), pick(" ", ". ", ", ", "\n", ") ") + letters(6)
        numeric, whole = kind in ("card", "phone"), (kind, len(left), len(left) + len(value))
        if real and numeric and rng.random() < 0.5:  # another number beside it
            other = pick(phone, card, date, lambda: f"{rng.integers(1, 13):02}/{rng.integers(24, 35)}")()
            if rng.random() < 0.5:
                right = " " + other + right
            else:
                left += other + " "
                whole = (kind, len(left), len(left) + len(value))
        text = left + value + right
        spanned = [c for c in candidates(text) if (numeric and real or c[0] == kind) and c[1] < whole[2] and c[2] > whole[1]]
        parts = [c for c in spanned if c != whole]
        if numeric and real and parts and rng.random() < 0.4:  # a part of the number, or more than it
            texts.append(text)
            spans.append(parts[rng.integers(len(parts))])
            truth.append(False)
        elif numeric and real:
            texts.append(text)
            spans.append(whole)
            truth.append(True)
        elif spanned:
            texts.append(text)
            spans.append(spanned[rng.integers(len(spanned))])
            truth.append(real)
    return texts, spans, np.array(truth)


class Places:
    """Taken ranges of a text, the overlapping ones as one, in order: a look-up takes the logarithm of their number."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2])
        return k == 0 or self.ends[k - 1] <= span[1]

    def add(self, span: Span) -> None:
        """Takes a free range."""
        k = bisect_left(self.starts, span[1])
        self.starts.insert(k, span[1])
        self.ends.insert(k, span[2])


@dataclass
class Detector:
    """Boosted trees, the calibration of their margin, and each kind's threshold on the calibrated probability."""

    boosted: list
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(self.slope * trees.margin(self.boosted, x, RATE) + self.offset)

    def found(self, text: str, base: list[Span]) -> list[Span]:
        taken = Places(base)
        proposed = [c for c in dict.fromkeys(candidates(text)) if taken.free(c)]
        if not proposed:
            return []
        p = self.probabilities(np.array([features(text, *c) for c in proposed], float))
        out, chosen = [], Places()
        for k in np.argsort(-p, kind="stable").tolist():
            c = proposed[k]
            if p[k] >= self.thresholds[c[0]] and chosen.free(c):
                chosen.add(c)
                out.append(c)
        return out


def train(n: int = CASES, seed: int = SEED) -> Detector:
    """Two thirds of the cases grow the trees; the others calibrate them and set the thresholds."""
    texts, spans, y = cases(n, seed)
    x = np.array([features(t, *s) for t, s in zip(texts, spans, strict=True)], float)
    cut = 2 * n // 3
    boosted = trees.boost(x[:cut], y[:cut].astype(float), ROUNDS, DEPTH, RATE)
    z, held = trees.margin(boosted, x[cut:], RATE), y[cut:]
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Platt scaling
        error = trees.sigmoid(slope * z + offset) - held
        slope, offset = slope - 0.02 * float((error * z).mean()), offset - 0.1 * float(error.mean())
    p, thresholds = trees.sigmoid(slope * z + offset), {}
    for kind in KINDS:
        own = np.array([s[0] == kind for s in spans[cut:]])
        order = np.argsort(-p[own], kind="stable")
        precise = np.cumsum(held[own][order]) / np.arange(1, own.sum() + 1) >= PRECISION
        thresholds[kind] = max(0.5, float(p[own][order][np.flatnonzero(precise)[-1]])) if precise.any() else 1.1
    return Detector(boosted, slope, offset, thresholds)


def joined(spans: Iterable[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def search(text: str, detector: Detector) -> tuple[list[Span], list[Span]]:
    """(base spans, further findings) of a text."""
    base = base_spans(text)
    return base, detector.found(text, base)


def redact(text: str, spans: Iterable[Span]) -> str:
    """The text with each span's characters replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SOME = re.compile(r"[0-9@]|(?<![A-Za-z0-9])at(?![A-Za-z0-9])|:[a-f]{0,4}:", re.IGNORECASE)


def _batches(detector: Detector, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows, redacted = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                if _SOME.search(text) is None:
                    rows.append((0, 0, 0, 0, empty, ""))
                    redacted.append(text)
                    continue
                base, more = search(text, detector)
                kinds = [k for k, *_ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
                if with_text:
                    redacted.append(redact(text, base + more))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))] if rows else [batch.column(0), *(pa.array([], t) for t in types)]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array(redacted, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted]) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_batches(train(), with_text), schema + ", redacted string" * with_text)
