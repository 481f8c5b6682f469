"""SimHash near-duplicate detection by pigeonhole blocks.

A document's fingerprint has a bit set where over half of its shingles' XXH64 values have it set.
Fingerprints that differ in at most `DISTANCE` bits are linked. The 64 bits are split into `BLOCKS`
blocks: a linked pair differs in at most `DISTANCE` of them, so it agrees on at least one choice of
`BLOCKS - DISTANCE` blocks. Every distinct fingerprint is keyed by each such choice, keys are joined,
and the Hamming distance is verified.

Only distinct fingerprints are joined, so copies cost nothing. A key leaves few bits free (at most 22 with the
defaults), yet a block of many almost equal fingerprints would still give all its pairs. Keys with more
than `WIDE` fingerprints therefore go another, equally exact way: two fingerprints of a key are linked
exactly if they agree once some `DISTANCE` of the free bits are masked, so each fingerprint is linked to
the smallest one with its masked value. That is linear in the block's size and loses no connection.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and links like any
other; rows that share a doc_id each get a row; a null doc_id is carried through, and never becomes a
component's id unless the whole component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import materialize
from cuelake.llm.graph import connected_components

SHINGLE, SEED, DISTANCE, BLOCKS, WIDE = 3, 42, 2, 6, 64

#: Row b: the eight bits of the byte b, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text as an unsigned 64-bit integer.

    bytes.lower() and bytes.split() know ASCII only: they lower A-Z and split at the six ASCII
    white-space characters.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    return fingerprint(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of some unsigned 64-bit hashes have set; none of no hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((simhash(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of `distance` blocks, the bits of the other blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [(2**64 - 1) & ~sum(bits[i] for i in out) for out in combinations(range(blocks), distance)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _shared_keys(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(choice, key, fp, n, least) of the keys that n fingerprints have, more than one."""
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key")
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    return materialize(keyed.join(sizes, ["choice", "key"]), "simhash-keys")


def _pairs(shared: DataFrame, distance: int, masks: list[int] | None = None) -> DataFrame:
    """(src, dst): the fingerprints of a key that differ in at most `distance` bits; with `masks`, only in the first key that they share."""
    a, b, differ = shared.alias("a"), shared.alias("b"), F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    close = F.bit_count(differ) <= distance
    if masks:
        close &= F.col("a.choice") == F.coalesce(*[F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, i) for i, m in enumerate(masks)])
    return (
        a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .where(close)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )


def blocks_for(n: int, distance: int, crowd: int) -> int:
    """The fewest blocks, at least two more than the distance, with which `n` evenly spread fingerprints come to at most `crowd` a key."""
    blocks = distance + 2
    while n >> (64 * (blocks - distance) // blocks) > crowd:
        blocks += 1
    return blocks


def led_links(distinct: DataFrame, distance: int, blocks: int, wide: int) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints within `distance`, for distances too great to mask: each pair whose
    first common key has at most `wide` fingerprints, once; of a wider key, those with its least fingerprint. What that leaves out needs another way."""
    masks = _masks(blocks, distance)
    shared = _shared_keys(distinct, masks)
    led = shared.where((F.col("n") > wide) & (F.col("least") < F.col("fp")) & (F.bit_count(F.col("least").bitwiseXOR(F.col("fp"))) <= distance))
    return _pairs(shared.where(F.col("n") <= wide), distance, masks).union(led.select(F.col("least").alias("src"), F.col("fp").alias("dst"))).distinct()


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, wide: int = WIDE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints `fp`, enough to connect every pair within `distance`."""
    masks = _masks(blocks, distance)
    shared = _shared_keys(distinct, masks)
    pairs = _pairs(shared.where(F.col("n") <= wide), distance)

    # one row for each choice and each set of masked bits: a few thousand rows, whatever the input
    hidden = distinct.sparkSession.createDataFrame(
        [(i, _signed(x)) for i, m in enumerate(masks) for x in _hidden(m, distance)], "choice int, keep long"
    )
    masked = shared.where(F.col("n") > wide).join(F.broadcast(hidden), "choice")
    masked = masked.select("fp", "keep", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"))
    least = masked.groupBy("keep", "rest").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = masked.join(least, ["keep", "rest"]).where("src < fp").select("src", F.col("fp").alias("dst"))
    return pairs.union(starred).distinct()


def _hidden(mask: int, distance: int) -> list[int]:
    """Masks that clear `distance` of the bits that `mask` leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [(2**64 - 1) & ~sum(1 << i for i in out) for out in combinations(free, distance)]


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, wide: int = WIDE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    labels = connected_components(links(distinct.select("fp"), distance, blocks, wide))
    member = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component")
    )
    first = member.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    to_doc = member.join(first, "component").select("fp", "component_id")
    return prints.join(to_doc, "fp")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` of which one stays of each group: the one with the smallest doc_id.

    Of rows that share that doc_id and are near-duplicates, all stay: they're one document to every later stage.
    Rows without a doc_id stay too.
    """
    kept = near_duplicates(docs.where("doc_id is not null"), **how).where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("__kept_id"), "left_semi").unionByName(docs.where("doc_id is null"))
