"""Byte-pair encoding and decoding with the merge rules of a public tokenizer's file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of adjacent pairs that have a
merge rule. The least rank is merged, its two new neighbour pairs are queued, and queue entries whose pair
has meanwhile gone are skipped. Decoding concatenates the vocabulary's strings, with a space between them,
which is what the library does for a file that names no decoder.

Words recur, so each Python worker remembers a bounded number of them. The tokenizer's file is read once, by
the driver, and sent to the executors: it is a few MB, whatever the input.

Only the file kind used here is handled: NFC, white space to spaces, lower case; split into letters, digits
and other characters; a mark at word ends; no decoder. Anything else is an error.

Defined cases: null text counts as empty and has no tokens; repeated rows are encoded each; null doc_ids are
carried through; an empty table gives an empty result. Special tokens inside a text become their ids, as in
the library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Memo, once_a_process

WORDS_KEPT = 400_000
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: What Unicode counts as white space; str.split() also splits at U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def bytes_to_characters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a printable character: itself where Latin-1 has a printable one, else the next above U+00FF."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge(symbols: list[int], rules: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merge rules to the symbols of one word. rules: left << 32 | right -> (rank, merged symbol)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rule[0], i, rule[1]) for i in range(n - 1) if (rule := rules.get(symbols[i] << 32 | symbols[i + 1]))]
    heapify(queue)
    while queue:
        rank, i, merged = heappop(queue)
        j = after[i]
        if symbols[i] < 0 or j >= n or (rule := rules.get(symbols[i] << 32 | symbols[j])) is None or rule[0] != rank:
            continue  # stale: a merge has taken one of the two
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if rule := rules.get(merged << 32 | symbols[k]):
                heappush(queue, (rule[0], i, rule[1]))
        h = before[i]
        if h >= 0 and (rule := rules.get(symbols[h] << 32 | merged)):
            heappush(queue, (rule[0], h, rule[1]))
    return [s for s in symbols if s >= 0]


class WordBPE:
    """An encoder and decoder from the text of a tokenizer's file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != NORMALIZERS or not split["invert"] or spec["decoder"]:
            raise ValueError("not a tokenizer file of the kind handled here")
        self.vocabulary = vocabulary = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*vocabulary.items(), *self.special.items()]}
        self.rules = {
            vocabulary[a] << 32 | vocabulary[b]: (rank, vocabulary[a + b])
            for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        }
        characters = bytes_to_characters()
        self.inner = [vocabulary[characters[b]] for b in range(256)]
        self.last = [vocabulary[characters[b] + model["end_of_word_suffix"]] for b in range(256)]
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.words = Memo(self._word, WORDS_KEPT)

    def _word(self, word: str) -> bytes:
        """The ids of a run without white space, as little-endian 32-bit integers."""
        ids: list[int] = []
        for piece in self.pieces.findall(word):
            raw = piece.encode()
            ids += merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.rules)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<" not in text or len(parts := self.cut.split(text)) == 1:
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        # lower-casing character by character knows no final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = text.split() if self.odd_space.search(text) is None else filter(None, self.spaces.split(text))
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, array("I", ids)))


def _batches(file, name: str, decode: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once_a_process(f"bpe {name}", lambda: WordBPE(file.value))
        for batch in batches:
            rows: list[bytes] = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), pa.array(rows, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(r) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _load(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        file = f.read()
    return docs.sparkSession.sparkContext.broadcast(file), hashlib.sha256(file.encode()).hexdigest()


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids binary[, decoded string]): the ids as little-endian unsigned 32-bit integers, and their strings again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_batches(*_load(docs, path), decode), "doc_id long, ids binary" + ", decoded string" * decode)


def _digest_batches(file, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once_a_process(f"bpe {name}", lambda: WordBPE(file.value))
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): `encode` with only digests of its columns, so that texts don't leave their tasks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digest_batches(*_load(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
