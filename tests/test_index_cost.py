"""What the search and the cutting of chunks cost grows with what they hold, not with products of sizes."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.functions.concepts import is_concept_line
from evidence_spark.functions.ngrams import count_ngrams
from evidence_spark.operators import retrieval
from evidence_spark.operators.chunking import chunk_pages


def asked(draw, queries, grams):
    """A block of queries whose grams are mostly their own."""
    pairs = sorted({(q, draw.randrange(20) if draw.random() < 0.2 else draw.randrange(grams)) for q in range(queries) for _ in range(150)})
    query, gram = np.array(pairs).T
    known, row = np.unique(gram, return_inverse=True)
    weight = np.array([draw.random() for _ in pairs])
    return np.arange(queries) * 3, known, row, query, weight


def part(draw, grams, chunks):
    names = [f" {n:04x}" for n in range(grams)]
    texts = [" ".join(f"{draw.randrange(grams):04x}" for _ in range(60)) for _ in range(chunks)]
    more = sorted({g for t in texts for w in t.split() for n in (4, 5) for g in _grams(f" {w} ", n)} - set(names))
    held = names + more
    n, m = len(held), len(texts)
    columns = ["part", "chunk_no", "gram", "gram_no", "idf", "terms"]
    idf = np.array([1 + draw.random() for _ in held])
    first = [pa.array([0] * n), pa.nulls(n, pa.int64()), pa.array(held), pa.array(np.arange(n)), pa.array(idf), pa.nulls(n, pa.string())]
    then = [pa.array([0] * m), pa.array(np.arange(m) * 2), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(texts)]
    return [pa.RecordBatch.from_arrays(c, names=columns) for c in (first, then)]


def _grams(word, n):
    return [word[i : i + n] for i in range(max(len(word) - n + 1, 1))]


def test_no_room_for_every_gram_a_query_asks_for():
    draw = random.Random(3)
    block = asked(draw, 200, 16_000)
    batches = part(draw, 16_000, 300)
    scan = retrieval._scanner(SimpleNamespace(value=[block]), 8, 4, 5)
    tracemalloc.start()
    found = pa.Table.from_batches(scan(iter(batches))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 40 << 20  # a dense block of 256 chunks and all grams, and one of all grams and queries, took 60 MB


@pytest.mark.parametrize("blocks", [(2048, 256), (7, 3)])
def test_best_chunks_by_brute_force(monkeypatch, blocks):
    """Common and rare grams, chunks whose scores are equal, queries that share nothing with any chunk."""
    draw = random.Random(4)
    monkeypatch.setattr(retrieval, "WORD_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", blocks[1])
    grams, chunks = part(draw, 90, 40)
    chunks = pa.RecordBatch.from_arrays(
        [c if i != 5 else pa.array(chunks.column(5).to_pylist()[:20] * 2) for i, c in enumerate(chunks.columns)], names=chunks.schema.names
    )
    block = asked(draw, 40, 90)
    alone = (np.array([500]), np.array([10**6]), np.array([0]), np.array([0]), np.array([1.0]))
    postings = pa.Table.from_batches(retrieval._weigher(4, 5)(iter([grams, chunks]))).to_pylist()
    ids, known, row, column, weight = block
    wanted = {}
    for q, number in enumerate(ids):
        own = {int(known[r]): w for r, c, w in zip(row, column, weight) if c == q}
        scores = [(-round(min(1.0, sum(own.get(g, 0) * w for g, w in zip(p["grams"], p["weights"]))), 9), p["chunk_no"]) for p in postings]
        wanted[int(number)] = sorted(s for s in scores if s[0] < 0)[:5]
    scan = retrieval._scanner(SimpleNamespace(value=[block, alone]), 5, 4, 5)
    found = {}
    for r in pa.Table.from_batches(scan(iter([grams, chunks]))).to_pylist():
        found.setdefault(r["query_no"], []).append((-r["score"], r["chunk_no"]))
    assert {q: sorted(s) for q, s in found.items()} == {q: s for q, s in wanted.items() if s}


def test_pieces_are_cut_without_walking_over_the_text_again(spark):
    text = ("é漢𝒳 word. " * 50 + "\x1c  　") * 3
    pages = spark.createDataFrame([("PRIMARY", "f", 1, text), ("PRIMARY", "f", 2, None), ("PRIMARY", "f", 3, "  ")], "source_type string, source_file string, page int, text string")
    cut = chunk_pages(pages, 100, 20)
    assert "substring" not in cut._jdf.queryExecution().optimizedPlan().toString()
    rows = cut.orderBy("page", "ordinal").collect()
    assert {r.page for r in rows} == {1} and all(r.text and r.text in text for r in rows)
    assert rows[0].text[0] == "é" and [r.ordinal for r in rows] == sorted({r.ordinal for r in rows})


def test_counts_added_up_in_between(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SUM_ROWS", 10)
    monkeypatch.setattr(retrieval, "WORD_BLOCK", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([4] * 9, pa.int32()), pa.array(["red river", "river bed", "a"] * 3)], names=["part", "terms"])
    found = pa.Table.from_batches(retrieval._counter(3, 5)(iter([batch]))).to_pylist()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["red river", "river bed", "a"] * 3)], "id int, t string")
    wanted = count_ngrams(frame, "t", ["id"], 3, 5).groupBy("gram").agg(F.count("*").alias("n"))
    assert sorted((r["gram"], r["n"]) for r in found) == sorted((r.gram, r.n) for r in wanted.collect())
    assert {r["part"] for r in found} == {4}


def test_long_lines_are_told_by_their_first_words(spark):
    """Lines of six words and of more, with and without what a concept's line is made of."""
    draw = random.Random(6)
    parts = ["Ab", "cd", "e1f", "(G)", "漢", "-", "\x85", "1", "Hi."]
    lines = ["".join(draw.choice(parts) + draw.choice([" ", "\n", "  ", ","]) for _ in range(draw.randint(1, 14))) for _ in range(400)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in lines], "t string")
    rows = frame.select("t", is_concept_line("t").alias("named")).collect()

    def named(t):
        t = t.strip()
        words = re.findall("[A-Za-z]+", t)
        return bool(re.fullmatch(r"[A-Za-z0-9()/,\-.\s]+", t)) and len("".join(words)) >= 2 and bool(re.search("[A-Z]", t)) and len(words) <= 6

    assert [r.named for r in rows] == [None if r.t is None else named(r.t) for r in rows]
    plan = frame.where(is_concept_line("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "{7}" in plan.split("transform(")[0]
