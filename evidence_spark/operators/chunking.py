"""Pages to overlapping evidence chunks, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.functions.spans import chunk_texts
from evidence_spark.functions.text import is_blank

# A chunk's identity and its place in the corpus: files in lexical order, then page, then piece.
CHUNK_KEY = ["source_type", "source_file", "page", "ordinal"]


def chunk_id() -> Column:
    return F.format_string("%s:%s:%04d:%04d", *CHUNK_KEY).alias("chunk_id")


def chunk_pages(pages: DataFrame, chunk_size: int = 1800, overlap: int = 300) -> DataFrame:
    """Cut every non-blank page into chunks; a chunk never crosses a page."""
    pieces = pages.where(~is_blank("text")).select(
        "source_type", "source_file", "page", F.explode(chunk_texts("text", chunk_size, overlap)).alias("piece")
    )
    return pieces.select(
        "source_type", "source_file", "page", F.col("piece.ordinal").alias("ordinal"), F.col("piece.text").alias("text")
    ).select(*CHUNK_KEY, chunk_id(), "text")


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    size = F.length("text")
    return chunks.groupBy("source_type").agg(
        F.count("*").alias("total_chunks"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.avg(size).alias("avg_length"),
        F.count_distinct("source_file").alias("source_files"),
    )


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    per_page = chunks.groupBy("source_type", "source_file", "page").agg(F.count("*").alias("n"))
    return per_page.groupBy("source_type", "source_file").agg(
        F.sum("n").alias("chunk_count"), F.count("*").alias("pages_with_chunks")
    )


def duplicate_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Ids that occur more than once; an index must not be built while this has rows."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def foreign_source_types(chunks: DataFrame, source_type: str) -> DataFrame:
    """Source types that do not belong in an index over ``source_type``."""
    return chunks.where(F.col("source_type") != source_type).select("source_type").distinct()


def chunks_for_source(chunks: DataFrame, source_file: str, page: int | None = None) -> DataFrame:
    """Chunks of one file, or of one page of it; nothing if unknown."""
    found = chunks.where(F.col("source_file") == source_file)
    return found if page is None else found.where(F.col("page") == page)
