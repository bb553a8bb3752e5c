"""What a reading of the index costs does not grow with the product of a part's grams and chunks, and what it leaves on the disks goes."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import retrieval, retrieval_eval
from evidence_spark.operators.chunking import chunk_pages
from evidence_spark.sources.tables import noted_tables
from test_index_cost import part


def built(spark, texts, *sizes):
    rows = [("PRIMARY", "f", i + 1, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "source_type string, source_file string, page int, text string")
    return retrieval.build_index(chunk_pages(pages), "PRIMARY", *sizes, tasks=3)


def test_grams_of_a_part_are_ordered_once(monkeypatch):
    batches, made = part(random.Random(8), 60, 40), []
    monkeypatch.setattr(retrieval, "WORD_BLOCK", 5)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 2)
    order = retrieval._ordered
    monkeypatch.setattr(retrieval, "_ordered", lambda *a: made.append(a) or order(*a))
    found = sum(len(b) for b in retrieval._weigher(4, 5)(iter(batches)))
    assert found == 40 and len(made) == 1  # an index of all grams was built for each of eight blocks


def test_places_of_grams():
    names = ["ab", "a\x00", "a", "漢字", "𝒳", "\x00", "abc"]
    wanted = retrieval._ordered(names, 3)
    asked = ["abc", "b", "\x00", "a\x00", "a", "ab", "𝒳", "漢", "漢字", "a\x00\x00"]
    places = [names.index(a) if a in names else -1 for a in asked]
    assert retrieval._found(wanted, retrieval._packed(asked, 3)).tolist() == places
    assert retrieval._found(retrieval._ordered([], 3), retrieval._packed(asked, 3)).tolist() == [-1] * len(asked)


@pytest.mark.parametrize("sizes", [(3, 5), (1, 2)])
def test_chunks_that_hold_grams(spark, monkeypatch, sizes):
    draw = random.Random(7)
    letters = "aabé漢𝒳ßİ\x00 \t\x1c\x85\xa0 　\n"
    index = built(spark, ["".join(draw.choices(letters, k=draw.randint(1, 60))) + "." for _ in range(40)] + [" a ", "b"], *sizes)
    every = {(r.chunk_no, r.gram_no) for r in retrieval.posting_rows(index).collect()}
    some = index.vocab.where(F.xxhash64("gram") % 3 == 0).select("gram_no")
    wanted = {r.gram_no for r in some.collect()}
    monkeypatch.setattr(retrieval, "WORD_BLOCK", 4)
    for rows in (500_000, 40):
        found = [(r.chunk_no, r.gram_no) for r in retrieval.chunks_holding(index, some.union(some), rows).collect()]
        assert sorted(found) == sorted(e for e in every if e[1] in wanted) and found
    assert retrieval.chunks_holding(index, some.where("false")).collect() == []


def test_literal_truth_reads_no_postings(spark):
    index = replace(built(spark, ["the red river runs", "a red\nriver bed", "Red river runs"]), postings=None, parts=None)
    terms = spark.createDataFrame([(1, "e red river r"), (2, "red"), (3, "a blue river"), (4, None)], "query_id long, term string")
    rows = [(r.query_id, r.page) for r in retrieval_eval.literal_truth(index, terms).collect()]
    assert sorted(rows) == [(1, 1), (2, 1), (2, 2)]


def test_shuffle_files_go_step_by_step(spark, monkeypatch):
    written = []
    with noted_tables() as paths:
        monkeypatch.setattr(retrieval, "release_shuffles", lambda s: written.append([p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in paths][-1]))
        index = built(spark, ["red river", "blue"])
        retrieval.search(index, spark.createDataFrame([(1, "river")], "query_id long, query string")).collect()
    assert written == ["terms", "part_counts", "vocab", "ranked"]
