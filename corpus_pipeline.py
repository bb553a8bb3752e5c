"""From raw documents to packed sequences: language, exact copies, near copies, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_spark.llm import exact_dedup, language, mixing, packing, simhash
from evidence_spark.llm.common import documents, with_row_key
from evidence_spark.llm.queries import VOCABULARY
from evidence_spark.sources.tables import drop_tables, noted_tables, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage before wrote on its way.
_spent: list[str] = []


def _in_turn(stage: Stage) -> Stage:
    """A stage is called when the one before it has been written and reread: what that one wrote on its way goes, unless
    ``docs`` still reads it."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        stays = drop_tables(spark, _spent, docs)
        with noted_tables() as note:
            result = stage(spark, docs, sf_dir)
        _spent[:] = [*stays, *note]
        return result

    return run_stage


@_in_turn
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: only a text that is null or has none goes.

    The stage gives every text with a letter one of the learned languages, so the field's scores reject nothing, and
    where no row had a language to learn from all documents stay.
    """
    model = language.train(docs.where(~language.is_held_out()))
    if not model.labels:
        return docs
    held = [F.col(c).alias(f"_kept_{c}") for c in docs.columns]
    found = language.label(docs, model, keep=held).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*(F.col(f"_kept_{c}").alias(c) for c in docs.columns))


def _chosen(rows: DataFrame, groups: DataFrame, best: Column, columns: list[str]) -> DataFrame:
    """The best row of each group; rows are told apart by ``_row``, as a doc_id may be null or repeated."""
    known = rows.select("_row", "doc_id").join(groups, "_row")
    stays = known.groupBy("_group").agg(best.alias("best")).select(F.col("best._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*columns)


@_in_turn
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id (none is smallest)."""
    rows = with_row_key(docs)
    groups = exact_dedup.group_copies(rows, "_row").select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    return _chosen(rows, groups, F.max(F.struct(F.col("doc_id").cast("long").alias("id"), "_row")), docs.columns)


@_in_turn
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, that of the smallest doc_id (none is largest)."""
    rows = with_row_key(docs)
    groups = simhash.near_duplicates(rows, "_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    number = F.col("doc_id").cast("long")
    return _chosen(rows, groups, F.min(F.struct(number.isNull().alias("none"), number.alias("id"), "_row")), docs.columns)


@_in_turn
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row per pass over a document, with the words that it takes."""
    rows = with_row_key(docs)
    mixed = mixing.mixed_documents(rows, mixing.mix(rows, row="_row"), "_row")
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


@_in_turn
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their places in the token sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", mixture),
    ("best_fit_packing", sequences),
]

#: The learned labels, fingerprints and token ids are beyond SQL; the tests hold the choosing stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
