"""The pipeline's stages on the small documents, each against what it should keep."""

from array import array

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cuelake.llm import simhash

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        frames[name] = out.collect()
        seen = spark.createDataFrame(frames[name], out.schema)
    ids = {k: {r["doc_id"] for r in v} for k, v in frames.items()}
    assert ids["line_dedup"] == ids["quality_rules"] and ids["near_dedup"] <= ids["line_dedup"]
    assert ids["benchmark_decontamination"] <= ids["near_dedup"] and ids["bpe_encoding"] == ids["benchmark_decontamination"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i in ids["quality_rules"])
    # one of each group of close fingerprints stays
    prints = {r["doc_id"]: simhash.simhash(r["text"].encode()) for r in frames["line_dedup"]}
    for a in ids["near_dedup"]:
        assert not any(b < a and bin(prints[a] ^ prints[b]).count("1") <= 2 for b in prints)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in frames["benchmark_decontamination"]}
    for r in frames["bpe_encoding"]:
        assert array("I", bytes(r["ids"])).tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, frames["bpe_encoding"]))


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() == 0


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    good = "\n".join(" ".join(f"{words[(i * 7 + k * k) % 25]}{words[(i + k) % 23]}" for k in range(12)) for i in range(8))
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, good.upper().lower(), None, None, None), (None, good + " end", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(5, good.replace("\n", " ") + " other words at the end", "en", "s", 9), (6, "\n".join([good] * 50), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as d", "2 as fp", "3 as w", "4 as component_id", "5 as hash", "6 as item_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = sorted((r["doc_id"] or 0) for r in docs.collect())
    # 3 and 4 have no words; 5 is a near copy of 1; nothing is left of 2 and 6, which are then copies of one another
    assert kept == [0, 1, 1, 2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in last) == kept
