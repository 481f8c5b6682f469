"""Dictionary terms in texts.

Every form of every entry is searched in one pass over a text by an Aho-Corasick automaton: the time is linear in the
text and in what is found, however large the dictionary. Forms compare in NFC; those that don't keep their case are searched in the
lower-cased text, the others in the text as it is, in the same scan.

Only distinct forms travel to the tasks, not entries: a form shared by many entries is one path of the automaton. Entries that
have the same forms among those found anywhere are one class, which is in a text or not as a whole: texts are joined with
classes and made distinct there, and each entry of a class follows without another look. Counts of entries don't need them
one by one. The forms' size is summed first. Up to `SHARD` code points they are one
broadcast; a larger dictionary is dealt into shards of about that size by the forms' hash, which are searched one after another,
each with its own scan and broadcast, so that neither the driver nor a task ever holds more than a shard.

Null texts have no terms; empty forms are none; an entry is found once a text, whichever of its forms are in it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import visible as V
from cuelake.sources.storage import fresh

#: Code points of the forms of one automaton, about.
SHARD = 1 << 22
#: Entries of a class that are dealt out together, about.
TOGETHER = 64


def normalized_forms(forms: DataFrame) -> DataFrame:
    """(entry_id, exact, form) of (entry_id, form, case_sensitive): forms as they are compared."""
    nfc = V.nfc(F.col("form"))
    rows = forms.where("form IS NOT NULL").select("entry_id", F.coalesce("case_sensitive", F.lit(False)).alias("exact"), nfc.alias("form"))
    return rows.select("entry_id", "exact", F.when(F.col("exact"), F.col("form")).otherwise(F.lower("form")).alias("form")).where("form <> ''").distinct()


def _automaton(forms: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, f in enumerate(forms):
        out.add_word(f, i)
    if forms:
        out.make_automaton()
    return out


def found_in(text: str | None, exact, folded) -> tuple[set[int], set[int]]:
    """Numbers of the forms in a text, of either policy."""
    if not text:
        return set(), set()
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return tuple({i for _, i in a.iter(t)} if len(a) else set() for a, t in ((exact, text), (folded, text.lower())))


def _search(forms, n_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = forms.value
        automata = [_automaton(names[k]) for k in (True, False)]
        for batch in batches:
            hits = [found_in(t.as_py(), *automata) for t in batch.column(n_keys)]
            columns = [pa.array([[names[policy][i] for i in sorted(h[k])] for h in hits], pa.list_(pa.string())) for k, policy in enumerate((True, False))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *columns], [*batch.schema.names[:n_keys], "as_is", "any_case"])

    return run


def _hits(texts: DataFrame, keys: list[str], names: dict[bool, list[str]]) -> DataFrame:
    """(keys, exact, form) of each form in a text."""
    rows = texts.select(*keys, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]) + ", as_is array<string>, any_case array<string>"
    searched = rows.mapInArrow(_search(texts.sparkSession.sparkContext.broadcast(names), len(keys)), schema)
    kinds = F.array(F.struct(F.lit(True).alias("exact"), F.col("as_is").alias("forms")), F.struct(F.lit(False).alias("exact"), F.col("any_case").alias("forms")))
    return searched.select(*keys, F.inline(kinds)).select(*keys, "exact", F.explode("forms").alias("form"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _classes(texts: DataFrame, keys: list[str], forms: DataFrame, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, class) of the classes of entries that are in a text; (class, n, first), the number of entries and the least one; (entry_id, class, n)."""
    known = _written(normalized_forms(forms), "dictionary-forms")
    distinct = known.select("exact", "form").distinct()
    size = distinct.agg(F.sum(F.length("form"))).first()[0] or 0
    shards = max(1, -(-size // shard))

    def names(k: int) -> dict[bool, list[str]]:
        out: dict[bool, list[str]] = {True: [], False: []}
        for r in distinct.where(F.pmod(F.xxhash64("form"), F.lit(shards)) == k).toLocalIterator():
            out[r["exact"]].append(r["form"])
        return out

    # a small file of texts is much work, hence not one task's
    spread = texts.select(*keys, "text").repartition(*keys, "text")
    hits = reduce(DataFrame.union, [_written(_hits(spread, keys, names(k)).distinct(), "dictionary-hits") for k in range(shards)])
    found = _written(hits.select("exact", "form").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary-found")
    sets = _written(known.join(found, ["exact", "form"]).groupBy("entry_id").agg(F.sort_array(F.collect_set("id")).alias("ids")), "dictionary-sets")
    classes = sets.groupBy("ids").agg(F.count("*").alias("n"), F.min("entry_id").alias("first")).withColumn("class", F.monotonically_increasing_id())
    classes = _written(classes, "dictionary-classes")
    of_form = classes.select("class", F.explode("ids").alias("id")).join(found, "id").select("exact", "form", "class")
    pairs = hits.join(of_form, ["exact", "form"]).select(*keys, "class").distinct()
    return pairs, classes.select("class", "n", "first"), sets.join(classes, "ids").select("entry_id", "class", "n")


def term_matches(texts: DataFrame, keys: list[str], forms: DataFrame, shard: int = SHARD) -> DataFrame:
    """(keys, entry_id): the entries of (entry_id, form, case_sensitive) that have a form in a text of (keys, text)."""
    pairs, classes, members = _classes(texts, keys, forms, shard)
    # a class's entries in lists, so that neither a large class nor one of many texts is one task's
    lists = F.ceil(F.col("n") / TOGETHER)
    packed = members.groupBy("class", F.pmod(F.xxhash64("entry_id"), lists).alias("list")).agg(F.collect_list(F.struct("entry_id")).alias("entries"))
    asked = pairs.join(classes, "class").select(*keys, "class", F.explode(F.sequence(F.lit(0).cast("long"), lists - 1)).alias("list"))
    return asked.join(packed.hint("merge"), ["class", "list"]).select(*keys, F.inline("entries"))


def entry_counts(texts: DataFrame, keys: list[str], forms: DataFrame, shard: int = SHARD) -> DataFrame:
    """(keys, entries, first_entry): of the rows of `term_matches` the number and the least entry of each key."""
    pairs, classes, _ = _classes(texts, keys, forms, shard)
    return pairs.join(classes, "class").groupBy(*keys).agg(F.sum("n").alias("entries"), F.min("first").alias("first_entry"))
