"""The index neither writes nor shuffles a row or entry per gram of a chunk."""

import random

import pytest
from pyspark.sql import Window, functions as F

from evidence_spark.functions.ngrams import count_ngrams
from evidence_spark.operators import retrieval
from evidence_spark.operators.chunking import chunk_pages
from evidence_spark.sources.tables import noted_tables


def chunks(spark, texts):
    rows = [("PRIMARY", "f", i + 1, t) for i, t in enumerate(texts)]
    return chunk_pages(spark.createDataFrame(rows, "source_type string, source_file string, page int, text string"))


def test_postings_are_counted_as_they_are_read(spark):
    with noted_tables() as paths:
        index = retrieval.build_index(chunks(spark, ["red river", "blue"]), "PRIMARY", tasks=2)
    assert index.postings.count() == 2
    assert not [p for p in paths if "/postings-" in p]
    terms = [p for p in paths if "/terms-" in p]
    assert spark.read.parquet(terms[0]).schema["terms"].dataType.simpleString() == "string"


@pytest.mark.parametrize("sizes", [(3, 5), (1, 2), (4, 4), (5, 7)])
def test_grams_by_the_rules_of_count_ngrams(spark, monkeypatch, sizes):
    """Characters outside ASCII and the basic plane, nulls, every kind of white space, words of one character, blocks of few chunks."""
    draw = random.Random(5)
    letters = "aabé漢𝒳ßİ\x00 \t\x1c\x85\xa0 　\n"
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 60))) + "." for _ in range(40)] + [" a ", "b"]
    index = retrieval.build_index(chunks(spark, texts), "PRIMARY", *sizes, tasks=3)
    wanted = count_ngrams(index.chunks, "text", ["chunk_no"], *sizes)
    df = {(r.gram, r.df) for r in index.vocab.collect()}
    assert df == {(r.gram, r.n) for r in wanted.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    length = F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2).over(Window.partitionBy("chunk_no")))
    weights = wanted.join(index.vocab, "gram").select("chunk_no", "gram", F.round(F.col("tf") * F.col("idf") / length, 9).alias("w"))
    expected = {(r.chunk_no, r.gram, r.w) for r in weights.collect()}
    for blocks in ((2048, 256), (5, 2)):
        monkeypatch.setattr(retrieval, "WORD_BLOCK", blocks[0])
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", blocks[1])
        found = retrieval.posting_rows(index).join(index.vocab, "gram_no").collect()
        assert {(r.chunk_no, r.gram, round(r.w, 9)) for r in found} == expected and len(found) == len(expected)
