"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once per document and stores what it measured and one bit per failed rule.
A policy is a version and the rules it enforces; applying one, or asking what a rule alone costs
(`ablations`), is bitwise arithmetic on the stored bits: the texts aren't read again.

Repeated windows are found inside a row, without a shuffle: each three-word window is hashed, hashes and
positions are sorted, and neighbours with equal hashes are repeats. The work is n log n in a text's words.

Defined cases: null text has no words, so fails the base rules; repeated rows are judged each on its own;
an empty table gives an empty result; a null doc_id is carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import WORD, words

#: Bit i of a ledger's `failures` belongs to RULES[i]. Bits are never given to another rule.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length")
#: version -> the rules that reject a document.
POLICIES = {1: ("few_words", "repeated_words"), 2: RULES}
POLICY = 2
WINDOW = 3
#: A word without lower-case letters and with two capitals together.
CAPITALS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{Ll}]*\p{Lu}{2}[^\x20\x09-\x0D\p{Ll}]*(?![^\x20\x09-\x0D])"
SYMBOLS = "[#*$%&|<>]"


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. A one-row generator keeps the optimizer from copying
    their expressions into the lambdas that use them, where they'd be computed once an element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.select(
        "doc_id",
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        words(F.col("t")).alias("w"),
    )
    df = _apart(df, w_=F.col("w")).drop("w").withColumnRenamed("w_", "w")
    df = df.select(
        "doc_id",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - WINDOW),
                lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )
    df = _apart(df, h_=F.col("h")).drop("h")
    placed = F.transform("h_", lambda x, i: F.struct(x.alias("h"), i.alias("at")))
    # most texts without any repeat end here
    df = _apart(df, s=F.when(F.size(F.array_distinct("h_")) < F.size("h_"), F.sort_array(placed)))

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get("s", k)["h"], F.lit(False))

    repeats = F.filter("s", lambda x, k: same(x, k + 1) | same(x, k - 1))
    covered = F.flatten(F.transform(repeats, lambda x: F.array(*[x["at"] + k for k in range(WINDOW)])))
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
        "n_capitals",
    )


def rule_columns() -> dict[str, Column]:
    """Rule -> whether a document fails it."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "capitals": 2 * c("n_capitals") > c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
    }


def bits(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of every document and `failures`, in which bit i is set if RULES[i] fails."""
    failed = rule_columns()
    mask = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measures(docs).withColumn("failures", mask)


def apply_policy(entries: DataFrame, version: int = POLICY) -> DataFrame:
    """Add `base_failed` and `kept` under a policy; the base rules hold under any."""
    base = F.col("failures").bitwiseAND(F.lit(bits(POLICIES[1]))) != 0
    rejected = F.col("failures").bitwiseAND(F.lit(bits(POLICIES[version]))) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)


def ablations(entries: DataFrame, version: int = POLICY) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it rejects."""
    enforced = F.col("failures").bitwiseAND(F.lit(bits(POLICIES[version])))
    sums = []
    for rule in POLICIES[version]:
        bit = F.lit(bits([rule]))
        sums += [F.count_if(enforced.bitwiseAND(bit) != 0).alias(f"{rule}_failed"), F.count_if(enforced == bit).alias(f"{rule}_alone")]
    pairs = ", ".join(f"'{r}', {r}_failed, {r}_alone" for r in POLICIES[version])
    return entries.agg(*sums).selectExpr(f"stack({len(POLICIES[version])}, {pairs}) as (rule, n_failed, n_alone)")


def keep_good(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """The rows of `docs` that a policy keeps, with their columns as they were."""
    columns = docs.columns
    marked = docs.withColumn("__row", F.struct(*[docs[c] for c in columns]))
    judged = apply_policy(ledger(marked.select(F.col("__row").alias("doc_id"), "text")), version)
    return judged.where("kept").select(*[F.col("doc_id").getField(c).alias(c) for c in columns])
