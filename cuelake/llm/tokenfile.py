"""Token ids as Parquet list columns that can be read in part.

A folder holds `tokens`, files in ascending order of doc_id with one row a document (doc_id, start of its
ids within the file, number of ids, ids), and `files`, one row a file (its name, first doc_id, documents,
ids, and the ids of all files before it). The ids are dictionary-encoded, the numbers delta-encoded; row
groups and pages have set sizes, and page indexes let a reader that asks for some doc_ids, or for the
numbers without the ids, skip the other pages and columns.

Texts are dealt out by ranges of doc_id and sorted there, so a file's start within all ids is the sum of the
files before it; each task only adds up its own documents. No task sees the whole order.

Encoding cuts a text before its single spaces and around its newlines, where the library's own splitting rule
cuts too and never looks past the cut, and gives the library each distinct piece once. Texts that hold a
special token, other white space, or a space beside more of it go to the library whole.

Defined cases: null text counts as empty and holds the end id alone; rows that repeat a doc_id each have their
own place, ordered by text; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.bpe import bytes_to_characters
from cuelake.llm.common import Memo, new_path, once_a_process

END = 2
PIECES_KEPT = 700_000
#: Texts are encoded together until they have so many characters.
CHUNK = 1 << 22
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Texts that hold other white space than spaces and newlines aren't cut.
_UNCUT = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """Texts to ids through the tokenizers library, which sees each distinct piece once while it's remembered."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.uncut = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + _UNCUT
        self.table = {b: c for b, c in bytes_to_characters().items() if chr(b) != c}
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = Memo(self.whole, 10_000)
        self.breaks = Memo(self._break, 10_000)  # by the newlines in a run with text after it
        self.spaced = Memo(lambda p: self._piece(" ", p), PIECES_KEPT)  # by what follows a space
        self.opening = Memo(lambda p: self._piece("", p), PIECES_KEPT // 4)  # by what starts a line

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _break(self, run: int) -> bytes:
        """Before more text the last newline of a run stands alone."""
        return (self.marks["\n" * (run - 1)] if run > 1 else b"") + self.marks["\n"]

    def _piece(self, lead: str, piece: str) -> bytes:
        if piece.isalpha():
            # a run of letters is one piece to the library's rule, so it goes straight to its model
            mark = self.table[32] if lead else ""
            seen = mark + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table))
            return array("I", [t.id for t in self.tokenize(seen)]).tobytes()
        stem = piece.rstrip(string.punctuation)
        if stem and stem is not piece and stem[-1].isalnum():  # punctuation after a letter or digit is a piece of its own
            return (self.spaced if lead else self.opening)[stem] + self.marks[piece[len(stem) :]]
        return self.whole(lead + piece)

    def encode(self, text: str) -> bytes:
        # a space beside more white space: the rule takes them together
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(x in text for x in self.uncut):
            return self.whole(text)
        opening, spaced, ids, run = self.opening.__getitem__, self.spaced.__getitem__, [], -1
        for line in text.split("\n"):
            run += 1
            if line:
                if run:
                    ids.append(self.breaks[run])
                    run = 0
                words = line.split(" ")
                ids.append(opening(words[0]))
                ids += map(spaced, words[1:])
        if run > 0:
            ids.append(self.marks["\n" * run])
        return b"".join(ids)


def _encode_batches(file):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encoder = once_a_process(f"tokens {zlib.crc32(file.value.encode())}", lambda: Encoder(file.value))
        start = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and size < CHUNK:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                rows = [np.frombuffer(x, "<u4") for x in map(encoder.encode, part)]
                counts = np.array([len(x) + 1 for x in rows], np.int64)
                ends = np.cumsum(counts)
                flat = np.full(int(ends[-1]), END, np.int32)
                for x, e in zip(rows, ends, strict=True):
                    flat[e - 1 - len(x) : e - 1] = x
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(part)], pa.int64()), pa.array(start + ends - counts), pa.array(counts), lists],
                    ["doc_id", "file_start", "n_tokens", "tokens"],
                )
                start += int(ends[-1])
                at += len(part)

    return run


def write(docs: DataFrame, tokenizer: str, path: str) -> str:
    """Encode `docs` with the tokenizer in the file `tokenizer` and write the folder `path`."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(_encode_batches(file), "doc_id long, file_start long, n_tokens long, tokens array<int>")
    (
        tokens.write.option("compression", "zstd")
        .option("maxRecordsPerFile", 0)  # a file a task, so that positions run on through it
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .parquet(f"{path}/tokens")
    )
    # names, and so the order of equal first doc_ids, follow the tasks' order
    per_file = (
        _tokens(spark, path).groupBy("file").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    )
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy(F.regexp_extract("file", "^part-([0-9]+)", 1).cast("long"), "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    per_file.withColumn("before", before).write.parquet(f"{path}/files")  # one row a file
    return path


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id long, file_start long, n_tokens long, tokens array<int>"
    return spark.read.schema(schema).parquet(f"{path}/tokens").select("*", F.col("_metadata.file_name").alias("file"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every document; columns that aren't used aren't read."""
    files = spark.read.schema("file string, first_doc_id long, n_docs long, n_tokens long, before long").parquet(f"{path}/files")
    joined = _tokens(spark, path).join(files.select("file", "before"), "file")
    return joined.select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "tokens")


def _crc_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read` gives."""
    return tokens.mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder, read them back, and return their checksums."""
    spark = docs.sparkSession
    return checksums(read(spark, write(docs, tokenizer, new_path(spark, "token-files"))))
