"""Document pages: listing files, giving them a role, reading and checking pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_spark.functions.text import is_blank

PRIMARY, SECONDARY = "PRIMARY", "SECONDARY"
PAGE_BREAK = "\f"


def role(source_file: Column, secondary_file: str) -> Column:
    """The role is decided by the file's name alone."""
    return F.when(source_file == secondary_file, SECONDARY).otherwise(PRIMARY)


def list_documents(spark: SparkSession, folder: str, suffix: str, secondary_file: str) -> DataFrame:
    """Files with the suffix (any case) and their roles; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    name = F.substring_index("path", "/", -1)
    return (
        files.select(name.alias("source_file"))
        .where(F.lower("source_file").endswith(suffix.lower()))
        .withColumn("source_type", role(F.col("source_file"), secondary_file))
    )


def read_text_pages(spark: SparkSession, folder: str, suffix: str, secondary_file: str) -> DataFrame:
    """Text files as pages; a form feed ends a page."""
    files = spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_file"), F.split("value", PAGE_BREAK, -1).alias("parts")
    )
    return (
        files.where(F.lower("source_file").endswith(suffix.lower()))
        .select("source_file", F.posexplode("parts").alias("i", "text"))
        .select(
            role(F.col("source_file"), secondary_file).alias("source_type"),
            "source_file",
            (F.col("i") + 1).alias("page"),
            "text",
        )
    )


def read_page_table(spark: SparkSession, path: str, format: str, secondary_file: str) -> DataFrame:
    """Pages already extracted into a table with source_file, page and text."""
    rows = spark.read.format(format).schema("source_file string, page int, text string").load(path)
    return rows.select(role(F.col("source_file"), secondary_file).alias("source_type"), "source_file", "page", "text")


def page_report(pages: DataFrame) -> DataFrame:
    """Per document: are its pages numbered 1..n, and is any of them not blank?"""
    return (
        pages.groupBy("source_type", "source_file")
        .agg(
            F.min("page").alias("first_page"),
            F.max("page").alias("last_page"),
            F.count("*").alias("pages"),
            F.count_distinct("page").alias("distinct_pages"),
            F.count_if(~is_blank("text")).alias("filled_pages"),
        )
        .withColumn(
            "contiguous",
            (F.col("first_page") == 1)
            & (F.col("last_page") == F.col("pages"))
            & (F.col("distinct_pages") == F.col("pages")),
        )
        .withColumn("usable", F.col("contiguous") & (F.col("filled_pages") > 0))
    )


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages of the documents that keep the page contract."""
    good = page_report(pages).where("usable").select("source_type", "source_file")
    return pages.join(good, ["source_type", "source_file"], "left_semi")
