"""Secret scans: candidates and features in DataFrame functions, judged by a random forest.

A candidate is a run of at least `SHORTEST` characters of those that keys are made of, with a digit in it. Its
features are those that set keys apart from look-alikes: length, character transitions, kinds of
characters, how much of it common words cover, whether it lies in a path, and the words beside it. A random
forest trained on labelled findings removes false positives; the trained trees become nested CASE
expressions, so that scanning is a single pass in the JVM, without a shuffle.

`findings()` are the labelled findings: generated secrets and look-alikes with a line around each, a bounded
table. Their features come from the same DataFrame functions that scan the corpus; the trees are grown from
them in numpy on the driver.

Defined cases: null text has no candidates; runs are found whole, whatever their length; a repeated row
gives its findings again; a null doc_id is carried through; an empty table gives an empty result.
Starts count code points. A candidate has a digit and no dot: words alone, and keys shorter than `SHORTEST`, are outside
what this operator looks for; of a token with dots, each part of that length is a candidate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import trees

SHORTEST, CONTEXT, FINDINGS, TREES, DEPTH, SEED, BLOCK = 16, 24, 3_000, 15, 6, 11, 512
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{%d,}={0,2}" % SHORTEST
#: Words that cover parts of names rather than of keys; fixed values.
COMMON = (
    "the and for with that this from image photo file data test user name page index main build version release report final draft "
    "node http https www com org net html json xml csv png jpg src lib bin log tmp home usr var etc int str get set new old item date time "
    "year month day week order part number section chapter table figure model train value key id config default local server client"
).split()
CUES = {
    "cue_secret": r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|api)[A-Za-z_]*\W*$",
    "cue_hash": r"(?i)(commit|sha|sha1|sha256|md5|hash|checksum|digest|rev|etag|uuid|guid|blob|tree)\W*$",
    "cue_place": r"(?i)(file|path|see|page|image|img|url|open|dir|version|order|invoice|isbn|doi|ref)\W*$",
    "assigned": r"[=:]\s*[\"']?$",
    "quoted": r"[\"']$",
    "in_path": r"[/.\\]$",
}
FEATURES = [
    "length", "transitions", "lower", "upper", "digit", "other", "hex_only", "covered", "slashes", "dashes", "longest_letters", "distinct",
    *CUES, "ends_quoted", "followed_by_suffix", "known_prefix",
]
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|sk_test_|sk-|AIza|ya29|eyJ)"


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once a row: the one-row generator keeps them out of the lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _starts(df: DataFrame) -> DataFrame:
    """Replace `sizes` by `starts`: where each candidate begins. Sums run in blocks and over the blocks, since an array is
    copied for each element that a fold appends to it."""

    def fold(sizes: Column, base: Column) -> Column:
        state = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"))
        return F.aggregate(sizes, state, step, lambda acc: acc["starts"])

    none = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(1), F.size("sizes"), F.lit(BLOCK)), lambda k: F.slice("sizes", k, BLOCK))
    df = _apart(df, blocks=blocks).drop("sizes")
    whole = F.transform("blocks", lambda b: F.struct(none.alias("gap"), F.aggregate(b, none, lambda n, x: n + x["gap"] + x["own"]).alias("own")))
    df = _apart(df, bases=fold(whole, none))
    return _apart(df, starts=F.flatten(F.transform("blocks", lambda b, i: fold(b, F.get("bases", i))))).drop("blocks", "bases")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, value, before, after) of each candidate, with up to `CONTEXT` characters on each side."""
    found = docs.select("doc_id", F.col("text").cast("string").alias("t")).where(F.col("t").rlike(CANDIDATE))
    found = _apart(found, c=F.regexp_extract_all("t", F.lit(f"({CANDIDATE})"), F.lit(1)), gaps=F.split("t", CANDIDATE, -1)).drop("t")
    # a candidate starts after all gaps up to it and all candidates before it
    sizes = F.transform("c", lambda x, i: F.struct(F.length(F.get("gaps", i)).cast("long").alias("gap"), F.length(x).cast("long").alias("own")))
    found = _starts(_apart(found, sizes=sizes))
    # whole structs are exploded: a row of its own that still held the text's arrays would copy them for each candidate

    def row(x: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get("c", i - 1)).otherwise("")
        return F.struct(
            F.get("starts", i).alias("start"), x.alias("value"), F.right(F.concat(previous, F.get("gaps", i)), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        )

    return _apart(found, rows=F.transform("c", row)).select("doc_id", "rows").select("doc_id", F.inline("rows"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def featured(found: DataFrame) -> DataFrame:
    """Add the FEATURES as doubles."""
    covered = F.length("value") - F.length(F.regexp_replace(F.lower("value"), "(" + "|".join(sorted(COMMON, key=len, reverse=True)) + ")", ""))
    longest = F.array_max(F.transform(F.regexp_extract_all("value", F.lit("([A-Za-z]+)"), F.lit(1)), F.length))
    columns = {
        "length": F.least(F.length("value"), F.lit(200)),
        "transitions": _share("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]"),
        "lower": _share("[a-z]"),
        "upper": _share("[A-Z]"),
        "digit": _share("[0-9]"),
        "other": _share("[^A-Za-z0-9]"),
        "hex_only": F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "covered": covered / F.length("value"),
        "slashes": F.regexp_count("value", F.lit("/")),
        "dashes": F.regexp_count("value", F.lit("[-_]")),
        "longest_letters": F.coalesce(longest, F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split("value", ""))),
        **{k: F.col("before").rlike(p) for k, p in CUES.items()},
        "ends_quoted": F.col("after").rlike("^[\"']"),
        "followed_by_suffix": F.col("after").rlike("^\\.[A-Za-z]"),
        "known_prefix": F.col("value").rlike(KNOWN),
    }
    return found.select("*", *[columns[k].cast("double").alias(f"f_{k}") for k in FEATURES])


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[int, str, int]]:
    """(id, line, whether its candidate is a secret): the labelled findings."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    some = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, num, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    alnum = low + low.upper() + num

    def word() -> str:
        return pick(*COMMON) if rng.random() < 0.5 else some(low, rng.integers(3, 9))

    def secret() -> str:
        return pick(lambda: some(hexa, pick(32, 40, 64)), lambda: some(alnum, rng.integers(20, 48)), lambda: some(alnum + "+/", pick(40, 44, 86)) + pick("", "=", "=="))()

    def known() -> str:
        return pick(lambda: "AKIA" + some(low.upper() + num, 16), lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: "AIza" + some(alnum + "_-", 35), lambda: "xoxb-" + some(num, 12) + "-" + some(alnum, 24))()

    def uuid() -> str:
        return "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))

    def path() -> str:
        return "/".join(word() for _ in range(rng.integers(2, 5))) + pick("-", "_", "/") + some(num, rng.integers(1, 9))

    def slug() -> str:
        return pick("-", "_").join([*(word() for _ in range(rng.integers(2, 5))), some(num, rng.integers(1, 7))])

    def stamp() -> str:
        return pick("IMG_", "VID-", "DSC", "backup-", "log_") + f"20{some(num, 2)}{some(num, 4)}_{some(num, 6)}"

    lines = []
    for i in range(n):
        real = int(rng.integers(2))
        if real:
            name = pick("token", "key", "secret", "api_key", "password", "Authorization: Bearer", "access_token", "client_secret")
            mark = pick(' = "{}"', "={}", ": {}", ' : "{}"', "='{}'", " {}")
            line = f"{word()} {word()} " + (name + mark).format(secret()) if rng.random() < 0.75 else f"{word()} {pick('', '= ', ': ')}{known()}"
        else:
            value = pick(
                lambda: f"{pick('commit', 'sha', 'md5', 'hash', 'checksum', 'rev', 'etag')}{pick(' ', ': ', '=')}{some(hexa, pick(32, 40, 64))}",
                lambda: f"{pick('id', 'uuid', 'order', 'ref', 'key')}{pick(' ', ': ', '=')}{uuid()}",
                lambda: f"{pick('see', 'file', 'open', 'the', 'https:/')} /{path()}{pick('', '.html', '.png', '.txt')}",
                lambda: f"{pick('see', 'the', 'page', 'token', 'name')} {slug()}",
                lambda: f"{pick('file', 'image', 'the')} {stamp()}{pick('', '.jpg', '.tar')}",
                lambda: f"{pick('number', 'card', 'order', 'isbn', 'the', 'of')} {some(num, rng.integers(16, 24))}",
                lambda: f"{pick('the', 'of', 'and')} {some(low, rng.integers(12, 24))}{some(num, rng.integers(1, 3))}{some(low, 4)}",
            )()
            line = f"{word()} {word()} {value}"
        lines.append((i, f"{line} {word()} {word()}.", real))
    return lines


def train(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> list:
    """The forest: trees whose leaves hold the share of secrets."""
    labelled = findings(n, seed)
    frame = spark.createDataFrame([(i, line) for i, line, _ in labelled], "doc_id long, text string")
    rows = featured(candidates(frame)).select("doc_id", *[f"f_{k}" for k in FEATURES]).orderBy("doc_id", *[f"f_{k}" for k in FEATURES]).collect()  # n lines
    truth = {i: real for i, _, real in labelled}
    x, y = np.array([r[1:] for r in rows], float), np.array([truth[r[0]] for r in rows])
    return trees.bag(x, y, TREES, DEPTH, seed)


def _votes(tree: trees.Tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(int(tree > 0.5))
    j, at, low, high = tree
    return F.when(F.col(f"f_{FEATURES[j]}") <= F.lit(float(at)), _votes(low)).otherwise(_votes(high))


def scan(docs: DataFrame, forest: list | None = None) -> DataFrame:
    """(doc_id, start, length, value, votes) of each candidate that most trees take for a secret."""
    forest = forest or train(docs.sparkSession)
    judged = featured(candidates(docs)).withColumn("votes", sum((_votes(t) for t in forest), F.lit(0)).cast("long"))
    return judged.where(2 * F.col("votes") > len(forest)).select("doc_id", "start", F.length("value").cast("long").alias("length"), "value", "votes")
