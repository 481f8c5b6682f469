r"""Source divergence audit: how far the words of each source of a language are from every other source's.

Terms are runs of ASCII letters and non-ASCII characters, lower-cased in ASCII only. A language keeps the V terms that
stand in at least `LEAST` of its documents. A group (language, source) gives each kept term the share
p = 1 + floor(10^9 (count + 1) / (N + V)), N being its count of all kept terms; the language itself gives one likewise. The
divergence of p from q on a term is floor((p - q)^2 / q).

Tasks count the terms of their documents in bounded tables, so a hot source is summed before it is shuffled. A term's counts in all
sources are then one row, and rows are dealt into blocks of terms so that a block's dense matrix, groups by terms in
int64, has about `CELLS` cells. Each block compares all its groups by broadcasting, a few rows of the matrix at a
time, and gives partial sums for each pair of groups and a heap of the `TOP` terms of each group. Spark sums the former and merges
the latter: a term of a group's list is in the heap of its block. Languages with more than `GROUPS` sources have
their blocks divided by groups, too. The result has a row for each pair of groups of a language, as asked.

Everything is exact: a square is at most 10^18, the quotient of 10^9 (count + 1) is taken three digits at a time, and
a pair's sum is less than (10^9 + V)^2 + 10^9 + V, which int64 holds for V up to two thousand million.

Defined cases: null text, lang and source are empty; every row is a document, repeated ones too; a group without
terms has count 0 of all; in a language without kept terms all pairs have the value 0, and no term is listed; the one group of a
language has no pairs; an empty table gives an empty result. Texts are read whole. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import materialize

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Cells of a block's matrix, groups of a block's rows, cells of one broadcast, and entries of a task's table of counts.
CELLS, GROUPS, AT_ONCE, HELD = 1 << 18, 512, 1 << 20, 200_000
#: Languages up to which their few numbers are broadcast; beyond, they are joined.
LANGS = 4096

#: In UTF-8, `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` of a text with its ASCII letters lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names = pa.array(list(terms), pa.binary()).cast(pa.string())
            n, docs = (pa.array([c[k] for c in terms.values()], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), names, n, docs], schema=schema)
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own, found = held[lang, source], defaultdict(int)
            for m in _TERM.finditer(text.as_py().lower()):
                found[m[0]] += 1
            size -= len(own)
            for term, n in found.items():
                if (c := own.get(term)) is None:
                    own[term] = [n, 1]
                else:
                    c[0] += n
                    c[1] += 1
            size += len(own)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, cells) of each kept term; cells are its (source, n)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return terms.where(F.col("docs") >= LEAST)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / total), exact for totals below 2^63 / 1000."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):  # SCALE is 1000^3
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_OUT_DDL = "lang string, source string, part string, item string, value long"


def compare_block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """The partial sums and top terms of the groups of one tile of rows (`here`) against all groups of the language, on the block's terms."""
    lang = groups.column("lang")[0].as_py()
    sources, n, here = groups.column("source").to_pylist(), groups.column("n").to_numpy(), groups.column("here").to_pylist()
    total, lang_total = (n + (v := groups.column("v")[0].as_py()))[:, None], groups.column("lang_n")[0].as_py() + v
    at = {s: i for i, s in enumerate(sources)}
    names = terms.column("term").to_pylist()
    counts = np.zeros((len(sources), len(names)), np.int64)
    for j, cells in enumerate(terms.column("cells").to_pylist()):
        for c in cells:
            counts[at[c["source"]], j] = c["n"]
    p = shares(counts, np.maximum(total, 1))
    q = shares(counts.sum(axis=0), np.int64(max(lang_total, 1)))
    rows = np.flatnonzero(here)
    sums = np.zeros((len(rows), len(sources)), np.int64)
    step = max(1, AT_ONCE // max(1, p.size))
    for a in range(0, len(rows), step):
        sums[a : a + step] = divergence(p[rows[a : a + step], None, :], p[None, :, :]).sum(axis=2)
    out: list[tuple[str, str, str, str, int]] = []
    for k, g in enumerate(rows):
        out += [(lang, sources[g], "pair", sources[h], int(sums[k, h])) for h in range(len(sources)) if h != g]
        own = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        f = divergence(p[g, own], q[own])
        best = heapq.nsmallest(TOP, zip((-f).tolist(), (names[j].encode() for j in own.tolist()), strict=True))
        out += [(lang, sources[g], "term", name.decode(), -value) for value, name in best]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group all others of its language, and its `TOP` terms, by divergence."""
    terms = materialize(term_counts(docs), "divergence-terms")
    cells = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    numbers = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    counted = every.join(cells, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    langs = materialize(counted.groupBy("lang").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("lang_n")).join(numbers, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))), "divergence-langs")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("g") / CELLS)).cast("int").alias("blocks")
    sized = langs.select("lang", "g", "v", "lang_n", blocks)
    if langs.count() <= LANGS:
        sized = F.broadcast(sized)
    tiles = lambda: F.sequence(F.lit(0), F.floor((F.col("g") - 1) / GROUPS).cast("int"))
    dealt = terms.join(sized.select("lang", "g", "blocks"), "lang").select("lang", "term", "cells", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.explode(tiles()).alias("tile"))
    own = counted.join(sized, "lang").select("lang", "source", "n", "lang_n", "v", "g", F.pmod(F.xxhash64("source"), F.size(tiles())).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    groups = own.select("*", F.explode(tiles()).alias("tile")).withColumn("here", F.col("own") == F.col("tile"))
    key = ["lang", "block", "tile"]
    parts = groups.select(*key, "source", "n", "lang_n", "v", "here").groupBy(*key).cogroup(dealt.select(*key, "term", "cells").groupBy(*key)).applyInArrow(lambda g, t: compare_block(t, g), _OUT_DDL)
    parts = materialize(parts, "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.select("lang", "source", "part", "item", "value", F.row_number().over(by).alias("rank"))
    return ranked(pairs).union(ranked(parts.where("part = 'term'")).where(F.col("rank") <= TOP))
