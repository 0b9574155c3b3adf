"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import decontam, jaccard, lattice, mixing, quality, secrets, shards, suffixes, surrogates, url_filter

PROSE = "the quick brown fox and the lazy dog of the old town went to the market in the morning and came home"
EXTRA = "word string, h long, part int, _row string, node string, sig long, rid long, shard string, kept string, size string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def docs(spark, empty=False):
    long_text = " ".join(f"{PROSE} {i}" for i in range(3000))
    texts = [(1, PROSE, "a"), (1, PROSE, "a"), (2, None, None), (None, PROSE, "b"), (3, "", "b"), (4, " \t\n ", None), (5, "x" * 50_000, "a"), (6, long_text, "c"), (7, "é ñ 漢字 " * 40, ""), (8, PROSE + " again", "a"), (None, None, None)]
    rows = [] if empty else [(i, t, None, s, None, "w", 1, 2, "r", "n", 3, 4, "s", "k", "z") for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "one two three"), (4, "!!!")], "item_id long, text string")


def pages(d):
    return d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "word", "h", "size")


OPERATORS = {
    "surrogates": lambda d: surrogates.replaced(d),
    "decontam": lambda d: decontam.matches(d, items(d.sparkSession)),
    "lattice": lambda d: lattice.scored(d),
    "url": lambda d: url_filter.judge(pages(d), pages(d).select(F.lit("example.com/x").alias("curl"))),
    "mixing": lambda d: mixing.mixed(d),
    "secrets": lambda d: secrets.digest(d, secrets.train(secrets.labelled(d))),
    "shards": lambda d: shards.digest(d),
    "quality": lambda d: quality.judge(d),
    "jaccard": lambda d: jaccard.linked(d),
    "suffixes": lambda d: suffixes.deduplicated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    full = OPERATORS[name](docs(spark)).collect()
    if name != "decontam":
        assert len(full) == 11
    assert OPERATORS[name](docs(spark, empty=True)).collect() == []


def test_stages_keep_columns(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs(spark), docs(spark, empty=True)):
            out = corpus_pipeline.stage(stage(spark, d, sf), "test")
            names = [c for c in out.columns if c != "slot"]
            assert sorted(names) == sorted(d.columns), name


def test_repeated_rows_stay_defined(spark):
    d = docs(spark)
    kept = jaccard.kept(d).select("doc_id", "text").collect()
    assert sum(r["text"] == PROSE for r in kept) == 1
    assert sum(not (r["text"] or "").strip() for r in kept) == 4
    m = mixing.mixed(d).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in m) and len(m) == 11
    s = {(r["doc_id"], r["n_bytes"]): r for r in suffixes.deduplicated(d).collect()}
    assert s[(5, 50_000)]["n_removed"] == 50_000 and s[(2, 0)]["n_removed"] == 0
    q = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert not q[2]["kept"] and not q[3]["kept"] and q[2]["n_words"] == 0
