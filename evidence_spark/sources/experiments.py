"""Experiment logs whose shape changed over time, brought into one attempt table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _text(path: str):
    return F.try_variant_get("r", path, "string")


def attempts_from_records(records: DataFrame) -> DataFrame:
    """Attempts from raw logs (source, json).

    A log maps categories to a list of rounds, or to an object holding the list
    under ``rounds``.  A round names its ``target`` or ``selected_concept``; its
    ``attempts`` are a list with details or just a number.  In the latter case an
    accepted round gives one attempt without number or verdicts.
    """
    spark = records.sparkSession
    parsed = records.select("source", F.try_parse_json("json").alias("v"))
    categories = spark.sql(
        "SELECT p.source, c.key AS category, c.value AS c FROM {p} p, LATERAL variant_explode(p.v) c", p=parsed
    )
    unwrapped = categories.select(
        "source", "category", F.coalesce(F.try_variant_get("c", "$.rounds", "variant"), F.col("c")).alias("c")
    ).where(F.schema_of_variant("c").startswith("ARRAY"))
    rounds = spark.sql(
        "SELECT u.source, u.category, r.pos AS round, r.value AS r FROM {u} u, LATERAL variant_explode(u.c) r",
        u=unwrapped,
    )
    target = F.coalesce(F.nullif(_text("$.target"), F.lit("")), F.nullif(_text("$.selected_concept"), F.lit("")))
    named = rounds.withColumn("target", target).where(F.col("target").isNotNull())
    named = named.withColumn("a", F.try_variant_get("r", "$.attempts", "variant"))
    detailed = F.coalesce(F.schema_of_variant("a").startswith("ARRAY"), F.lit(False)) & F.coalesce(
        F.try_variant_get("r", "$.attempts[0]", "variant").isNotNull(), F.lit(False)
    )
    full = spark.sql(
        "SELECT n.source, n.category, n.round, n.target, x.value AS r FROM {n} n, LATERAL variant_explode(n.a) x",
        n=named.where(detailed),
    ).select(
        "source",
        "category",
        "round",
        "target",
        F.try_variant_get("r", "$.attempt_number", "int").alias("attempt_number"),
        F.coalesce(F.try_variant_get("r", "$.accepted", "boolean"), F.lit(False)).alias("accepted"),
        _text("$.question").alias("question"),
        _text("$.correct_answer_text").alias("correct_answer_text"),
        F.try_variant_get("r", "$.validations.grounding.passed", "boolean").alias("grounding_passed"),
        F.lit(True).alias("has_detail"),
    )
    bare = (
        named.where(~detailed)
        .select(
            "source",
            "category",
            "round",
            "target",
            F.coalesce(F.try_variant_get("r", "$.accepted", "boolean"), F.lit(False)).alias("accepted"),
            F.nullif(_text("$.question"), F.lit("")).alias("question"),
            _text("$.correct_answer_text").alias("correct_answer_text"),
            F.lit(False).alias("has_detail"),
        )
        .where(F.col("accepted") & F.col("question").isNotNull())
    )
    return full.unionByName(bare, allowMissingColumns=True)


def union_logs(logs: list[DataFrame]) -> DataFrame:
    """Logs of different shape as one table; fields a log lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
