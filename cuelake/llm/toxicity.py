r"""Toxicity: a weighted lexicon, learned from labelled documents and matched by Aho-Corasick in folded texts.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones and digits and
signs that stand for letters to these, one code point to one, and makes anything else a space. A pattern is a whole
word or the beginning of words. The automaton runs over folded words between single spaces; a match counts if
the word in the text has a letter, so plain numbers never do.

The lexicon comes from labelled documents, of which `FIT_ROWS` at most, chosen by a hash of doc_id, are read; their few bytes
are broadcast, so texts aren't shuffled.
1. Words are counted by documents of either label; beginnings sum what their words have. Words and beginnings that
   toxic documents have `FIRST` times as often as others are candidates, `CANDIDATES` at most; of a beginning and what
   it begins, the one that tells more stays.
2. The candidates are matched, with the words beside them. Copies of a document repeat the same neighbours, so a
   candidate's evidence is how many different words stand before and after it (the lesser number), under each label; its
   weight is the logarithm of their ratio, each taken a standard deviation to the cautious side, and it stays if the ratio is
   `ODDS` at least. A pattern with a neighbour that mostly
   stands in other documents makes an exception phrase: a match within one has no weight.
3. A candidate of less than `SURE` evidence that in most of its toxic documents stands beside one of `LED` times its evidence is explained by that one,
   and goes: so do words that only came along.
4. Documents are scored, and the score is calibrated: a logistic curve over the weight, and over the weight by the
   text's length, fitted to counts of a grid of both, so all documents read take part.

Nothing but the text is an input of a score. Defined cases: null and empty texts have no match and get the least
score; a label whose toxic is null isn't read, and of several for a doc_id the highest counts; a null doc_id is read as an empty
one, which is held out; repeated rows are scored each, alike; without labels of both kinds the lexicon is empty and every
score is the share of toxic labels, 0 if there are none; an empty table gives an empty result. Texts are read whole; a
very long text takes time in proportion to its length. Further columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import materialize

#: Labelled documents that are read, at most; half of them toxic, if there are as many.
FIT_ROWS = 1 << 17
#: Candidates, exception phrases (the most frequent), and code points of a pattern, at most; a longer word is matched by its beginning.
CANDIDATES, PHRASES, LONGEST = 4096, 4096, 48
#: Shortest beginning of words; different words that one must have in toxic documents.
STEM, FAMILY = 4, 3
FIRST, ODDS, EVIDENCE, SURE, LED, FOLDS = 3.0, 8.0, 3, 20, 4, 5
#: Steps of the calibration's grid, and words that a text counts as having besides its own.
GRID, SHORT, RIDGE = 64, 20, 1e-3

# Letters that look like Latin ones, and what is written for letters.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
#: `1`, `i` and `l` stand for one another.
_SAME = {"i": "l"}


class _Fold(dict):
    """Code point -> the letter or digit that it counts as, or a space."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = c if len(c) == 1 else chr(code).lower()[:1]
        c = _LOOK_ALIKE.get(c, c)
        c = _SAME.get(c, c)
        self[code] = c = c if c.isalnum() or unicodedata.category(c).startswith("M") else " "
        return c


FOLD = _Fold()


def fold(text: str) -> str:
    """As long as the text."""
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """Patterns and their weights: `word ` is a whole word, `begin` a beginning. Phrases are (pattern, side, neighbour), side 0 before it."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: set[tuple[str, int, str]] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float = 0.0

    def score(self, n_words: int, hits: list[tuple[str, str, str]]) -> float:
        if not self.weights:
            return self.share
        weight = sum(self.weights[p] for p, before, after in hits if (p, 0, before) not in self.phrases and (p, 1, after) not in self.phrases)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * (x := measures(weight, n_words))[0] + c * x[1]))))


def measures(weight: float, n_words: int) -> tuple[float, float]:
    """Of a text: its weight, and the weight by its length, both as logarithms."""
    return math.log1p(weight), math.log1p(100 * weight / (n_words + SHORT))


def automaton(patterns: Iterable[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(f" {p}", p)
    out.make_automaton()
    return out


def matches(text: str, found) -> tuple[int, list[tuple[str, str, str]]]:
    """(number of words, [(pattern, word before, word after)]) of a text; of the patterns of a word, the longest."""
    folded = fold(text)
    words = folded.split()
    hits: list[tuple[str, str, str]] = []
    best: dict[int, str] = {}
    padded = f" {folded} "
    for end, p in found.iter(padded) if len(found) else ():
        start = end - len(p) + 1  # in `padded`, of the pattern
        if len(p) > len(best.get(start, "")):
            best[start] = p
    for start, p in best.items():
        stop = padded.find(" ", start)
        if not any(map(str.isalpha, text[start - 1 : stop - 1])):
            continue
        left, right = start, stop
        while left and padded[left - 1] == " ":
            left -= 1
        while right < len(padded) and padded[right] == " ":
            right += 1
        hits.append((p, padded[padded.rfind(" ", 0, left) + 1 : left], padded[right : max(right, padded.find(" ", right))]))
    return len(words), hits


# --- fitting ---------------------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that a lexicon may be fitted on: not held out, at most `rows`, the first by a hash of doc_id of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ours = known.where("toxic = 1").orderBy(*order).limit(rows // 2).union(known.where("toxic <> 1").orderBy(*order).limit(rows // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ours), "doc_id").select("doc_id", "text", (F.col("toxic") == 1).cast("int").alias("toxic"))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, n): documents of a label with the word; the empty word counts documents. Summed in bounded tables."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    counts = (Counter(), Counter())

    def out():
        for label, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], schema=schema)
            c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            counts[toxic].update({"", *fold(text.as_py()).split()})
            if sum(map(len, counts)) > 200_000:
                yield from out()
    yield from out()


def _candidates(rows: DataFrame) -> tuple[list[str], tuple[int, int]]:
    """Patterns whose words stand in toxic documents `FIRST` times as often, and the number of documents of either label."""
    words = rows.select("doc_id", "text", "toxic").mapInArrow(_word_batches, "word string, toxic int, n long")
    counts = materialize(words.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")), "toxic-words")
    total = counts.where("word = ''").first()
    n = (total["t"], total["c"]) if total else (0, 0)
    if not n[0] or not n[1]:
        return [], n
    odds = ((F.col("t") + 0.5) / n[0]) / ((F.col("c") + 0.5) / n[1])
    size = F.length("word")
    whole = counts.where((F.col("t") >= EVIDENCE) & (size > 0) & (size <= LONGEST)).select(F.concat("word", F.lit(" ")).alias("pattern"), "t", "c", F.lit(1).alias("family"))
    stems = F.explode(F.transform(F.sequence(F.lit(STEM), F.least(size, F.lit(LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k)))
    begun = counts.where(size >= STEM).select(stems.alias("pattern"), "t", "c").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("int")).alias("family"))
    both = whole.union(begun.where((F.col("t") >= EVIDENCE) & (F.col("family") >= FAMILY)))
    strong = both.where((odds >= FIRST) & (F.col("t") >= EVIDENCE)).withColumn("gain", F.sqrt("t") * F.log(odds))
    best = strong.orderBy(F.desc("gain"), F.desc(F.length("pattern")), "pattern").limit(CANDIDATES).collect()
    return _reduced([r["pattern"] for r in best]), n


def _reduced(best: list[str]) -> list[str]:
    """Of the patterns in order, those that neither begin nor continue one before them."""
    chosen: set[str] = set()
    begun: set[str] = set()
    for p in best:
        starts = [p[:k] for k in range(1, len(p) + 1)]
        if p not in begun and chosen.isdisjoint(starts):
            chosen.add(p)
            begun.update(starts)
    return sorted(chosen)


_HITS = pa.list_(pa.struct([("pattern", pa.string()), ("before", pa.string()), ("after", pa.string())]))
_HITS_DDL = "doc_id long, toxic int, n_words long, hits array<struct<pattern:string,before:string,after:string>>"


def _match_batches(patterns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(patterns)
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("n_words", pa.int64()), ("hits", _HITS)])
        for batch in batches:
            out = [matches(t.as_py(), found) for t in batch.column(1)]
            hits = [[{"pattern": p, "before": b, "after": a} for p, b, a in h] for _, h in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in out], pa.int64()), pa.array(hits, _HITS)], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon and its calibration, of labelled documents that aren't held out."""
    read = labelled(docs, labels, rows)
    patterns, (toxic, clean) = _candidates(read)
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    if not patterns:
        return Lexicon(share=share)
    matched = materialize(read.mapInArrow(_match_batches(patterns), _HITS_DDL), "toxic-matches")
    hits = matched.select("toxic", F.explode("hits").alias("h")).select("toxic", "h.*")
    beside = hits.select("toxic", "pattern", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("word")), F.struct(F.lit(1).alias("side"), F.col("after").alias("word")))).alias("b"))
    pairs = materialize(beside.groupBy("pattern", "b.side", "b.word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxic-neighbours")
    common = pairs.where((F.col("c") >= EVIDENCE) & (F.col("c") >= ODDS * F.col("t")) & (F.col("word") != "")).orderBy(F.desc("c"), "pattern", "side", "word").limit(PHRASES)
    phrases = {(r["pattern"], r["side"], r["word"]) for r in common.collect()}
    kinds = pairs.groupBy("pattern", "side").agg(F.sum((F.col("t") > 0).cast("int")).alias("t"), F.sum((F.col("c") > 0).cast("int")).alias("c"))
    evidence: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for r in kinds.collect():
        evidence[r["pattern"]].append((r["t"], r["c"], r["side"]))
    seen, weights = {}, {}
    for p, sides in evidence.items():
        excepted = [sum(q == p and s == side for q, s, _ in phrases) for side in (0, 1)]
        t, c = min(x[0] for x in sides), max(0, min(x[1] - excepted[x[2]] for x in sides))
        odds = (t - math.sqrt(t) + 0.5) / (toxic + 1) / ((c + math.sqrt(c) + 0.5) / (clean + 1))
        if t >= EVIDENCE and odds >= ODDS:
            seen[p], weights[p] = t, math.log(odds)
    led = matched.where("toxic = 1").mapInArrow(_led_batches(seen), "pattern string, n long, led long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("led").alias("led"))
    for r in led.where("2 * led > n").collect():
        if seen[r["pattern"]] < SURE:
            del weights[r["pattern"]]
    lexicon = Lexicon(weights, {p for p in phrases if p[0] in weights}, share=share)
    if weights:
        lexicon.curve = _calibrated(matched, lexicon)
    return lexicon


def _led_batches(evidence: dict[str, int]):
    """(pattern, n, led): toxic documents with a pattern, and those that also have one of `LED` times its evidence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {p: [0, 0] for p in evidence}
        for batch in batches:
            for hits in batch.column(3).to_pylist():
                own = {h["pattern"] for h in hits if h["pattern"] in evidence}
                most = max((evidence[p] for p in own), default=0)
                for p in own:
                    counts[p][0] += 1
                    counts[p][1] += most >= LED * evidence[p]
        some = {p: c for p, c in counts.items() if c[0]}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), *(pa.array([c[k] for c in some.values()], pa.int64()) for k in (0, 1))], ["pattern", "n", "led"])

    return run


def _grid_batches(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                hits = [(h["pattern"], h["before"], h["after"]) for h in row["hits"] if h["pattern"] in lexicon.weights]
                weight = sum(lexicon.weights[p] for p, b, a in hits if (p, 0, b) not in lexicon.phrases and (p, 1, a) not in lexicon.phrases)
                counts[(*(min(GRID * GRID, round(x * GRID / 8)) for x in measures(weight, row["n_words"])), row["toxic"])] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], pa.int32()) for i in range(3)] + [pa.array(list(counts.values()), pa.int64())], ["x", "y", "toxic", "n"])

    return run


def _calibrated(matched: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """A logistic curve by Newton's steps on the grid's counts; neither measure may lower a score."""
    cells = matched.mapInArrow(_grid_batches(lexicon), "x int, y int, toxic int, n long").groupBy("x", "y", "toxic").agg(F.sum("n").alias("n")).collect()
    x = np.array([[1.0, r["x"] * 8 / GRID, r["y"] * 8 / GRID] for r in cells])
    y, n = np.array([float(r["toxic"]) for r in cells]), np.array([float(r["n"]) for r in cells])
    n /= n.sum()
    for columns in ([0, 1, 2], [0, 1], [0, 2]):
        w = np.zeros(len(columns))
        z = x[:, columns]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (n * (p - y)) + RIDGE * w
            w -= np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), slope)
        if (w[1:] >= 0).all():
            break
    out = np.zeros(3)
    out[columns] = w
    return tuple(out.tolist())


def _score_batches(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon.weights)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_hits", pa.int64())])
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, hits = matches(text.as_py(), found)
                out.append((lexicon.score(n, hits), n, len(hits)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_words, n_hits) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score_batches(lexicon), "doc_id long, score double, n_words long, n_hits long")
