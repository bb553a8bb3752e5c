"""Requests for question sets and the table of category aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.functions.rules import check_rows, filled, positive


def read_requests(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    """JSON objects ``{"categories": {name: count}}``, one per line or, if ``indented``, one per file.

    ``request_id`` from its place.  What cannot be read stays as a row with its text in ``malformed``.
    """
    schema = "categories map<string,int>, malformed string"
    raw = spark.read.schema(schema).json(path, multiLine=indented, columnNameOfCorruptRecord="malformed")
    return raw.withColumn("request_id", F.monotonically_increasing_id())


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests that are malformed or name no category."""
    error = F.when(F.col("malformed").isNotNull(), "not JSON of a request").otherwise("no categories")
    lost = F.col("malformed").isNotNull() | F.coalesce(F.size("categories") <= 0, F.lit(True))
    return requests.where(lost).select("request_id", error.alias("error"), "malformed")


def request_rows(requests: DataFrame) -> DataFrame:
    """One row per requested category, ``ord`` keeping the order of the request."""
    return requests.select("request_id", F.posexplode(F.map_entries("categories")).alias("ord", "entry")).select(
        "request_id", "ord", F.col("entry.key").alias("category"), F.col("entry.value").alias("requested")
    )


def check_request(rows: DataFrame) -> DataFrame:
    return check_rows(
        rows,
        {
            "category must not be blank": filled("category"),
            "count must be a positive integer": positive("requested"),
        },
    )


def alias_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "alias string, target string")
