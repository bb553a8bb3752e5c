"""The engine's input tables, derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.operators.chunking import chunk_pages
from evidence_spark.operators.numbering import number_within
from evidence_spark.operators.retrieval import EvidenceIndex, build_index, search
from evidence_spark.sources.tables import release_shuffles, write_table

_shared: dict[tuple[str, str, str], object] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def once(spark: SparkSession, folder: str, name: str, build):
    """Build a written table (or index) once per session and input folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: one file per source, English primary, the rest secondary."""
    documents = read(spark, folder, "documents").select(
        F.when(F.col("lang") == "en", "PRIMARY").otherwise("SECONDARY").alias("source_type"),
        F.concat("source", F.lit(".txt")).alias("source_file"),
        "doc_id",
        "text",
    )
    return number_within(documents, ["source_type", "source_file"], "doc_id", "page", block=1_000).select(
        "source_type", "source_file", F.col("page").cast("int").alias("page"), "text"
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_pages(pages(spark, folder))


def index(spark: SparkSession, folder: str, source_type: str = "PRIMARY") -> EvidenceIndex:
    """The search index over one source type."""
    return once(
        spark,
        folder,
        f"index {source_type}",
        lambda: build_index(chunk_table(spark, folder).where(F.col("source_type") == source_type), source_type),
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Top-8 primary evidence of every benchmark query."""
    return once(
        spark,
        folder,
        "evidence",
        lambda: write_table(search(index(spark, folder), queries(spark, folder)), "evidence"),
    )


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of both source types, written once."""

    def build() -> DataFrame:
        table = write_table(chunks(spark, folder), "all_chunks")
        release_shuffles(spark)
        return table

    return once(spark, folder, "chunks", build)


def corpus_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every file is a scope; its chunks rank in corpus order."""
    return chunk_table(spark, folder).select(
        F.concat_ws(":", "source_type", "source_file").alias("scope"),
        (F.col("page").cast("long") * 1_000_000 + F.col("ordinal")).alias("rank"),
        "source_file",
        "page",
        "chunk_id",
        "text",
    )


def query_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark query is a scope; its evidence ranks by score."""
    return evidence(spark, folder).withColumnRenamed("query_id", "scope")
