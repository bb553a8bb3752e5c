"""How well retrieval finds chunks that literally contain an expected term."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_spark.functions.ngrams import count_ngrams
from evidence_spark.functions.text import words
from evidence_spark.operators.chunking import CHUNK_KEY
from evidence_spark.operators.retrieval import EvidenceIndex, chunks_holding
from evidence_spark.sources.tables import write_table

CUTOFFS = (3, 5, 8)
#: Characters of the terms in one automaton; more terms make more automata of this size.
SHARD_CHARS = 1_000_000


def anchors(index: EvidenceIndex, terms: DataFrame) -> DataFrame:
    """(term_no, gram_no) of the terms (term_no, term) that have a word inside: the rarest gram of those words.

    A word that has white space of the term on both sides is a word of every chunk that contains the term, so its
    grams are the chunk's too.  A term with a gram that the corpus lacks has no row: no chunk contains it.
    """
    found = words(F.lower("term"))
    inner = F.array_join(F.slice(found, F.lit(2), F.size(found) - 2), " ")
    cut = terms.where(F.size(found) > 2).select("term_no", inner.alias("inner"))
    grams = count_ngrams(cut, "inner", ["term_no"], index.n_min, index.n_max)
    known = grams.join(index.vocab.select("gram", "gram_no", "df"), "gram", "left")
    rarest = known.groupBy("term_no").agg(
        F.min(F.struct("df", "gram_no")).alias("rarest"), F.count_if(F.col("gram_no").isNull()).alias("lacking")
    )
    return rarest.where("lacking = 0").select("term_no", "rarest.gram_no")


def _locator(shared):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in shared.value:
            automaton.add_word(term, number)
        automaton.make_automaton()
        for batch in batches:
            chunk, term = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {n for _, n in automaton.iter(text)}
                chunk += [number] * len(found)
                term += found
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(term, pa.int64())], names=["chunk_no", "term_no"])

    return locate


def _scanned(chunks: DataFrame, terms: DataFrame, shard_chars: int) -> DataFrame | None:
    """(chunk_no, term_no) of the terms that have no word inside, by automata that the chunk texts stream through."""
    size = terms.agg(F.sum(F.length("term"))).first()[0]
    if not size:
        return None
    shards = -(-size // shard_chars)
    dealt = F.pmod(F.xxhash64("term_no"), F.lit(shards))
    found = None
    for shard in range(shards):
        held = [(r["term_no"], r["term"]) for r in terms.where(dealt == shard).collect()]
        if held:
            shared = chunks.sparkSession.sparkContext.broadcast(held)
            places = chunks.select("chunk_no", "text").mapInArrow(_locator(shared), "chunk_no long, term_no long")
            found = places if found is None else found.unionByName(places)
    return found


def literal_truth(index: EvidenceIndex, terms: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Chunks containing the whole term (query_id, term), case and all: (query_id, chunk key, chunk_id).

    A term's candidates are the chunks that hold its rarest gram; the term itself is compared with those texts only.  Terms
    without a word inside are located by automata.  A term that runs over the end of a chunk is in no chunk; null and empty
    terms are in none.
    """
    asked = write_table(terms.where(F.length("term") > 0).select(F.monotonically_increasing_id().alias("id"), "query_id", "term"), "asked")
    distinct = write_table(asked.groupBy("term").agg(F.min("id").alias("term_no")), "terms")
    rarest = write_table(anchors(index, distinct), "anchors")
    held = chunks_holding(index, rarest)
    candidates = write_table(held.join(rarest, "gram_no").select("chunk_no", "term_no"), "candidates")
    # the written tables have known sizes, by which the planner chooses its joins
    found = (
        index.chunks.select("chunk_no", "text")
        .join(candidates, "chunk_no")
        .join(distinct, "term_no")
        .where(F.col("text").contains(F.col("term")))
        .select("chunk_no", "term_no")
    )
    scanned = _scanned(index.chunks, distinct.where(F.size(words(F.lower("term"))) <= 2), shard_chars)
    if scanned is not None:
        found = found.unionByName(scanned)
    return (
        found.join(distinct, "term_no")
        .join(asked, "term")
        .join(index.chunks.select("chunk_no", *CHUNK_KEY, "chunk_id"), "chunk_no")
        .select("query_id", *CHUNK_KEY, "chunk_id")
    )


def ungrounded(terms: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries whose term no chunk contains: errors of the test set."""
    return terms.join(truth.select("query_id").distinct(), "query_id", "left_anti")


def evaluate(truth: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per grounded query the expected number of chunks, the retrieved ids and hits at each cut-off.

    What a query expects can be very many chunks, so they are counted, not listed.
    """
    expected = truth.groupBy("query_id").agg(F.count("*").alias("expected_chunks"))
    right = truth.select("query_id", "chunk_id", F.lit(True).alias("right"))
    found = (
        evidence.select("query_id", "rank", "chunk_id")
        .join(right, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).getField("chunk_id").alias("retrieved"),
            F.min(F.when(F.col("right"), F.col("rank"))).alias("first_hit"),
        )
    )
    hit = [F.coalesce(F.col("first_hit") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in CUTOFFS]
    return expected.join(found, "query_id", "left").select("query_id", "expected_chunks", "retrieved", *hit)


def recall(results: DataFrame) -> DataFrame:
    """Share of queries with a hit at each cut-off; 0 without queries."""
    return results.agg(
        F.count("*").alias("queries"),
        *[
            F.coalesce(F.avg(F.col(f"hit_at_{k}").cast("int")), F.lit(0.0)).alias(f"recall_at_{k}")
            for k in CUTOFFS
        ],
    )


def misses(results: DataFrame) -> DataFrame:
    """Queries without a hit even at the widest cut-off."""
    return results.where(~F.col(f"hit_at_{CUTOFFS[-1]}"))
