"""The nearest known name of each typed one, by an index of names with letters left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.sources.storage import fresh

#: Names further off than this are no suggestions.
MOST = 3


def allowed(typed: Column, name: Column) -> Column:
    """How many edits a suggestion may be off: a third of the longer one's length, between 1 and `MOST`."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST), F.floor(F.greatest(F.length(typed), F.length(name)) / 3).cast("int")))


def left_out(text: Column, most: int) -> Column:
    """Hashes of a text with up to `most` letters left out, each once. Letters go from left to right, so no choice of them is made twice."""
    at = lambda s, i: F.struct(s.alias("s"), i.cast("int").alias("i"))
    none = F.array().cast("array<struct<s:string,i:int>>")

    def shorter(v: Column) -> Column:
        cut = F.transform(F.sequence(v["i"], F.length(v["s"])), lambda i: at(F.overlay(v["s"], F.lit(""), i, F.lit(1)), i))
        return F.when(v["i"] <= F.length(v["s"]), cut).otherwise(none)

    level = F.array(at(text, F.lit(1)))
    levels = [level]
    for _ in range(most):
        level = F.flatten(F.transform(level, shorter))
        levels.append(level)
    return F.array_distinct(F.transform(F.concat(*levels), lambda v: F.xxhash64(v["s"])))


def nearest(typed: DataFrame, names: DataFrame) -> DataFrame:
    """(typed, name, distance): for each different `typed` the `name` with the fewest edits, the least in binary order among equals,
    if it isn't further off than `allowed`. Nulls are no names; an empty text may be one.

    Two texts with at most k edits between them are equal once at most k letters are left out of each, so they meet in a hash join,
    and the true distance is taken of those that meet. One edit is tried first; only what has no name there goes on to two, and
    then to three, so the large sets of hashes are made of few typed texts. Texts too short for so many edits stay out, so no
    hash stands for all short names. Texts that meet under a hash are at most 2k edits apart: a hash is as hot as names are alike.
    """
    spark = typed.sparkSession
    left, known, found = typed.select("typed").where("typed IS NOT NULL").distinct(), names.select("name").where("name IS NOT NULL").distinct(), None
    for most in range(1, MOST + 1):
        # more than one edit is allowed from 3 * most letters of the longer text on, so the other one has 2 * most at least
        long = (left, known) if most == 1 else (left.where(F.length("typed") >= 2 * most), known.where(F.length("name") >= most))
        keyed = [df.select("*", F.explode(left_out(F.col(df.columns[0]), most)).alias("key")) for df in long]
        met = keyed[0].join(keyed[1], "key").select("typed", "name", F.levenshtein("typed", "name", most).alias("distance")).where("distance >= 0")
        path = fresh(spark, f"nearest-{most}")
        met.groupBy("typed").agg(F.min(F.struct("distance", "name")).alias("best")).select("typed", "best.name", "best.distance").write.parquet(path)
        here = spark.read.parquet(path)
        found, left = here if found is None else found.unionByName(here), left.join(here, "typed", "left_anti")
    return found.where(F.col("distance") <= allowed(F.col("typed"), F.col("name")))
