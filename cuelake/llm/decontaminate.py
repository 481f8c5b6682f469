"""Benchmark decontamination by template windows.

A text becomes a template: its words lower-cased and stripped of outer punctuation, numbers, names and units
replaced by typed placeholders. Windows of `WINDOW` template words are hash-joined with the benchmark's, so a
question with other numbers or names in it still meets its source. What stood in the placeholders is then
compared: along one alignment of text and item, a value of the item must always stand for the same value of
the text, or the alignment doesn't count.

What a name is depends on the case of letters. Items and documents are therefore also compared in a second form,
in which names are words like others: an item meets its copies in any case.

An item is found in a document if, in one form, `SHARE` of its windows match, or `RUN` windows of one alignment do; in
the second form, these follow one another (13 words with the defaults), lest other names count as the same.

Only document windows that a Bloom filter of the benchmark's windows lets through are joined. The filter has
`FILTER_BITS` bits, however large the benchmark: a large one lets more through, and the join drops them. A document
and an item are looked at if they share one of the item's rarest windows, all but as many as it needs less one; only
then are all their windows compared. So a window that very many items and documents hold gives no pairs by itself.

Defined cases: null text has no windows; items or documents shorter than a window, and windows with fewer
than `LITERALS` words that aren't placeholders, match nothing; items with the same text count as the one with
the smallest item_id; null item_ids and doc_ids are not examined (the filter keeps such documents); rows that
repeat a doc_id are one document; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import Memo, materialize, once_a_process

WINDOW, LITERALS, SHARE, RUN = 5, 3, 0.8, 9
FILTER_BITS = 24
WORDS_KEPT = 500_000
#: Words that are units after a number.
UNITS = (
    "km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces t ton tons "
    "l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent dollar dollars cent cents euro euros usd eur gbp mph kmh degree degrees"
).split()

#: Bits of a word's code below its 60-bit hash.
_NUMBER, _NAME, _UNIT, _ENDS = 1, 2, 3, 4
_OUTER = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_NUMERIC = regex.compile(r"\p{N}[\p{N}.,:/]*")
_CAPITAL = regex.compile(r"\p{Lu}\p{Ll}+")
_STOP = regex.compile(r"[.!?:][^\p{L}\p{N}]*$")
_UNIT_SET = frozenset(UNITS)
_PLACES = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in (_NUMBER, _NAME, _UNIT)}
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def code(word: bytes) -> int:
    """60 bits of the hash of the word's canonical form, and what it may stand for; 0 for a word of punctuation."""
    raw = word.decode("utf-8", "replace")
    bare = _OUTER.sub("", raw)
    if not bare:
        return 0
    kind = _NUMBER if _NUMERIC.fullmatch(bare) else _UNIT if bare.lower() in _UNIT_SET else _NAME if _CAPITAL.fullmatch(bare) else 0
    return (xxhash.xxh64_intdigest(bare.lower()) >> 4 | 1) << 4 | kind | (_ENDS if _STOP.search(raw) else 0)


def template(text: bytes, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(hash of each template word, its kind of placeholder or 0, its own hash, the words)."""
    words = text.split()
    values = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    if not values.all():
        words = [w for w, v in zip(words, values.tolist(), strict=True) if v]
        values = values[values != 0]
    kind = (values & np.uint64(3)).astype(np.int8)
    ends = (values & np.uint64(_ENDS)) != 0
    first = np.concatenate(([True], ends[:-1]))[: len(kind)]
    kind[(kind == _NAME) & first] = 0  # any word is capitalised there
    numbers = kind == _NUMBER
    kind[(kind == _UNIT) & ~np.concatenate(([False], numbers[:-1]))[: len(kind)]] = 0
    own = values >> np.uint64(4)
    hashes = own.copy()
    for k, place in _PLACES.items():
        hashes[kind == k] = place
    return hashes, kind, own, words


def windows(hashes: np.ndarray, kind: np.ndarray, size: int, literals: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows with enough literal words, of all or `among` some positions."""
    n = len(hashes) - size + 1
    if n <= 0 or among is not None and not len(among):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled, free = np.zeros(n if among is None else len(among), np.uint64), np.zeros(n if among is None else len(among), np.int64)
    for k in range(size):
        here = slice(k, k + n) if among is None else among + k
        rolled += hashes[here] * _FACTORS[k]
        free += kind[here] == 0
    rolled ^= rolled >> np.uint64(29)
    rolled *= _FACTORS[0]
    at = np.flatnonzero(free >= literals)
    return at if among is None else among[at], rolled[at]


def _named(kind: np.ndarray, size: int) -> np.ndarray:
    """The positions of the windows that hold a name."""
    names = np.concatenate(([0], np.cumsum(kind == _NAME)))
    return np.flatnonzero(names[size:] > names[:-size])


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


_WINDOWS = "id long, form int, pos int, hash long, slots array<string>, n_windows int"


def _nameless(hashes: np.ndarray, kind: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second form: names are words."""
    names = kind == _NAME
    return np.where(names, own, hashes), np.where(names, 0, kind).astype(np.int8)


def _window_batches(size: int, literals: int, wanted=None):
    """Windows of each item in both forms (0, 1); with `wanted`, a broadcast bitmap, those of documents whose bit is
    set, and of the second form only those that have a name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = once_a_process("decontaminate codes", lambda: Memo(code, WORDS_KEPT))
        bits = None if wanted is None else wanted.value
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
                hashes, kind, own, words = template(text.as_py() or b"", codes)
                forms = [(hashes, kind, None)]
                if (kind == _NAME).any():
                    forms.append((*_nameless(hashes, kind, own), None if bits is None else _named(kind, size)))
                elif bits is None:
                    forms.append(forms[0])
                for form, (values, kinds, among) in enumerate(forms):
                    at, values = windows(values, kinds, size, literals, among)
                    total = len(at)
                    if bits is not None and total:
                        bit = _bit(values, FILTER_BITS)
                        hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) != 0
                        at, values = at[hit], values[hit]
                    for p, v in zip(at.tolist(), values.view(np.int64).tolist(), strict=True):
                        slots = [f"{kinds[i]}{_OUTER.sub('', words[i].decode('utf-8', 'replace')).lower()}" if kinds[i] else None for i in range(p, p + size)]
                        found.append((doc, form, p, v, slots, total))
            for k in range(0, len(found), 50_000):
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*found[k : k + 50_000], strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "form", "pos", "hash", "slots", "n_windows"])

    return run


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def _filter(items: DataFrame):
    """The benchmark's windows as a bitmap of fixed size, put together by buckets."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    buckets = items.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    for r in buckets.collect():  # at most 2^(FILTER_BITS - 15) rows of 4 KB
        bits[r["at"] << 12 : r["at"] + 1 << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return items.sparkSession.sparkContext.broadcast(bits)


def _longest(at: Column) -> Column:
    """The most positions that follow one another."""
    state = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(acc: Column, p: Column) -> Column:
        n = F.when(acc["last"] + 1 == p, acc["n"] + 1).otherwise(1)
        return F.struct(p.alias("last"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    return F.aggregate(at, state, step, lambda acc: acc["most"])


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, share, longest) for each item found in a document: the share of the item's windows
    that match, and the most windows that match along one alignment (in the second form one after another), each in the
    form where it's largest."""
    first = _texts(benchmark, "item_id").groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    items = materialize(first.mapInArrow(_window_batches(size, literals), _WINDOWS).withColumnRenamed("id", "item_id"), "template-items")
    found = materialize(_texts(docs, "doc_id").mapInArrow(_window_batches(size, literals, _filter(items)), _WINDOWS).drop("form", "n_windows"), "template-windows")

    # a document with as many windows as an item needs has one of its rarest, all but those less one
    common = items.groupBy("hash").agg(F.count("*").alias("n_items"))
    rank = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("n_items", "hash", "pos"))
    needed = F.least(F.ceil(F.lit(share) * F.col("n_windows") - 1e-9), F.lit(run))
    rare = items.join(common, "hash").withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - needed + 1)
    asked = found.select(F.col("id").alias("doc_id"), "hash").join(rare.select("item_id", "form", "hash"), "hash").select("doc_id", "item_id", "form").distinct()

    theirs = found.select(F.col("id").alias("doc_id"), "hash", F.col("pos").alias("dpos"), F.col("slots").alias("dslots"))
    own = items.select("item_id", "form", "hash", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "n_windows")
    pairs = theirs.join(asked, "doc_id").join(own, ["item_id", "form", "hash"])
    slots = F.filter(F.arrays_zip("islots", "dslots"), lambda s: s["islots"].isNotNull())
    # what is gathered for an alignment is bounded by the item's length
    aligned = pairs.groupBy("doc_id", "item_id", "form", "n_windows", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
        F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots")
    )
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["islots"]))) == F.size("slots")
    by_form = (
        aligned.where(consistent)
        .groupBy("doc_id", "item_id", "form", "n_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n"), F.max(F.when(F.col("form") == 0, F.size("at")).otherwise(_longest(F.sort_array("at")))).alias("longest"))
    )
    best = by_form.groupBy("doc_id", "item_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("share"), F.max("longest").alias("longest"))
    return best.where((F.col("share") >= share) | (F.col("longest") >= run))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_ids) of the documents in which an item is found."""
    return matches(docs, benchmark, **how).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without the contaminated ones."""
    gone = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
