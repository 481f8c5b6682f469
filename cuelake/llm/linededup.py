"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A run is a number of consecutive lines that have a word (lines without words don't count). A run of at least
`MIN_WORDS` words is a repeat if an equal run stands in an earlier document, or in the same document and ends
before it begins. All lines of all repeats go; what is first stays, so every line's first occurrence stays.

It suffices to look at the shortest runs of `MIN_WORDS` words, those that begin at each line and those that
end at each line: a repeat consists of repeats among them. They are the windows, of at most `MIN_WORDS` lines each.

Winnowing: the line with the least hash of a window (the first of equals) is its fingerprint, and stands for the window. Neighbouring windows mostly
have the same one, so short lines give few fingerprints; a line of `MIN_WORDS` words is a window by itself and
hence a fingerprint, since its copy must be found wherever it stands alone. Equal windows have equal
fingerprints at the same place in them, so none is missed.

1. Fingerprints are joined by position: those whose line stands at one place only have no match, and go.
2. From the others a match is extended both ways, over the lines to the left and to the right of the fingerprint, up to
   the ends of each of its windows. A window meets the first place where the fingerprint and both sides are the same, not the
   fingerprint's first place, whose sides may differ. Windows that overlap or touch extend the match further.
3. The lines of later matches go.

However often a window occurs, it meets one place: no join gives pairs of a group's members, and a group's first place is found by partial
minima. Frequent fingerprints and windows, of which there can't be more than `HEAVY`, are broadcast, so no task gets all of one.

Defined cases: a null text stays null; a null doc_id leaves the row as it is, and its lines are no source of
matches; lines without words stay; rows that repeat both doc_id and text are one document and all get its
text; rows that share only the doc_id are ordered by a hash of their text; a text of which nothing is left is
empty; an empty table gives an empty result. The work is linear in a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import WORD, materialize, unused

MIN_WORDS, HEAVY = 8, 1_000


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once a row: the one-row generator keeps them out of the lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _lines(text: Column) -> Column:
    """(row, h, g, w) of each line that has a word: its number among all lines, two independent hashes, its words."""
    each = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(i.alias("row"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    return F.filter(each, lambda x: x["w"] > 0)


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, k, pos, at, h, g, left, right, rows): document and hash of its text, the window's first line among those with
    words, its fingerprint's place and two hashes, the hashes of the lines before and after that in the window, and the
    row numbers of all its lines in the text."""
    text = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").cast("string").alias("t")
    )
    lined = _apart(text, l=_lines(F.col("t"))).drop("t").where(F.size("l") > 0)

    def at(i: Column) -> Column:
        return F.get("l", i)

    def length(i: Column, step: int) -> Column:
        """Lines of the shortest window from line i on, or back from it; 0 if the text ends before it's full."""
        near = F.array(*[F.when(i + step * j >= 0, at(i + step * j)["w"]) for j in range(min_words)])
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        grown = F.aggregate(
            near,
            none,
            lambda acc, w: F.when((acc["words"] >= min_words) | w.isNull(), acc).otherwise(F.struct((acc["words"] + w).alias("words"), (acc["n"] + 1).alias("n"))),
            lambda acc: F.when(acc["words"] >= min_words, acc["n"]).otherwise(0),
        )
        return F.when(at(i)["w"] >= min_words, 1).otherwise(grown)

    # a window as one number, its start and its length: equal ones are the same window of the text
    place = F.transform(
        F.sequence(F.lit(0), F.size("l") - 1),
        lambda i: F.transform(F.array(length(i, 1), -length(i, -1)), lambda n: F.when(n != 0, F.when(n > 0, i).otherwise(i + n + 1).cast("long") * (min_words + 1) + F.abs(n))),
    )
    placed = _apart(lined, c=F.array_distinct(F.filter(F.flatten(place), lambda c: c.isNotNull())))

    def cut(c: Column) -> Column:
        start = F.floor(c / (min_words + 1)).cast("int")
        return F.struct(start.alias("pos"), F.filter(F.array(*[at(start + j) for j in range(min_words)]), lambda _, j: j < c % (min_words + 1)).alias("x"))

    wide = _apart(placed, v=F.transform("c", cut)).select("d", "k", "v")
    least = F.transform("v", lambda v: F.struct(v["pos"].alias("pos"), v["x"].alias("x"), F.array_position(F.transform(v["x"], lambda x: x["h"]), F.array_min(F.transform(v["x"], lambda x: x["h"]))).cast("int").alias("i")))
    marked = _apart(wide, u=least).select("d", "k", "u")
    side = lambda v, keep: F.xxhash64(F.transform(F.filter(v["x"], lambda _, j: keep(j, v["i"] - 1)), lambda x: x["g"]))
    made = F.transform(
        "u",
        lambda v: F.struct(
            v["pos"].alias("pos"), (v["pos"] + v["i"] - 1).alias("at"), F.get(v["x"], v["i"] - 1)["h"].alias("h"), F.get(v["x"], v["i"] - 1)["g"].alias("g"),
            side(v, lambda j, i: j < i).alias("left"), side(v, lambda j, i: j > i).alias("right"), F.transform(v["x"], lambda x: x["row"]).alias("rows"),
        ),
    )
    return marked.select("d", "k", F.inline(made))


def _split(groups: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Groups (keys, n) that have more than one in `HEAVY` rows, of which there are fewer than `HEAVY`, and the others."""
    frequent = F.col("n") * HEAVY > rows
    return groups.where(frequent).drop("n"), groups.where(~frequent).drop("n")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, k, row) of every line to delete; a line may come several times."""
    every, prints = materialize(windows(docs, min_words), "line-windows"), ["h", "g"]
    total, point = every.count(), F.struct("d", "k", "at")
    twice = every.groupBy(*prints).agg(F.min(point).alias("a"), F.max(point).alias("b"), F.count("*").alias("n")).where("a < b").drop("a", "b")
    heavy, light = _split(materialize(twice, "line-prints"), total)
    joined = every.join(F.broadcast(heavy), prints, "left_semi").unionByName(every.join(F.broadcast(heavy), prints, "left_anti").join(light, prints, "left_semi"))
    joined, key, place = materialize(joined, "line-matches"), [*prints, "left", "right"], F.struct("d", "k", "pos")
    first = joined.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    heavy, light = _split(materialize(first, "line-firsts"), total)
    met = joined.join(F.broadcast(heavy), key).unionByName(joined.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key))
    apart = (F.col("d") != F.col("first.d")) | (F.col("k") != F.col("first.k")) | (F.col("first.pos") + F.size("rows") <= F.col("pos"))
    return met.where((place > F.col("first")) & apart).select("d", "k", F.explode("rows").alias("row"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """The rows of `docs` with `text` less its repeated lines, and with `counts` `__removed_lines`, `__removed_words` (long),
    which take the place of columns of these names."""
    columns = [c for c in docs.columns if not counts or c not in ("__removed_lines", "__removed_words")]
    d, k, rows, split, left = unused(docs.columns, "d", "k", "rows", "split", "left")
    gone = repeats(docs, min_words).groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(F.collect_set("row").alias(rows))
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(d), F.xxhash64("text").alias(k))
    both = keyed.join(gone, [d, k], "left")
    # a set of the row numbers to keep, so that a long text isn't searched for each of its lines
    edited = _apart(both, **{split: F.when(F.col(rows).isNotNull(), F.split("text", "\n"))})
    edited = _apart(edited, **{left: F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(rows))})
    kept = F.when(F.size(left) == 0, "").otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    text = F.when(F.col(rows).isNull(), F.col("text")).otherwise(kept)
    lost = F.aggregate(F.transform(rows, lambda i: F.regexp_count(F.get(F.col(split), i), F.lit(WORD))), F.lit(0).cast("long"), lambda a, n: a + n)
    measures = [F.when(F.col(rows).isNull(), 0).otherwise(F.size(rows)).cast("long").alias("__removed_lines"), F.coalesce(lost, F.lit(0).cast("long")).alias("__removed_words")]
    return edited.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], *measures[: 2 * counts])
