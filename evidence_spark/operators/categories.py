"""Canonical categories, aliases and the plan of a question set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evidence_spark.functions.rules import filled
from evidence_spark.functions.text import is_blank
from evidence_spark.sources.tables import broadcast_checked

PLAN_BLOCK = 10_000


def resolve_categories(rows: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``canonical``: the category itself, else the alias target, else null."""
    known = canonical.select(F.col("category").alias("_known")).distinct()
    named = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    return (
        rows.join(broadcast_checked(known), F.col("category") == F.col("_known"), "left")
        .join(broadcast_checked(named), F.col("category") == F.col("_alias"), "left")
        .withColumn("canonical", F.coalesce("_known", "_target"))
        .drop("_known", "_alias", "_target")
    )


def unknown_categories(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("canonical").isNull()).drop("canonical")


def alias_violations(aliases: DataFrame, canonical: DataFrame) -> DataFrame:
    """Every alias that must not be used, with the reason."""
    names = broadcast_checked(canonical.select("category").distinct())

    def because(reason: str, df: DataFrame) -> DataFrame:
        return df.select("alias", "target", F.lit(reason).alias("reason"))

    return (
        because("blank alias", aliases.where(~filled("alias")))
        .unionByName(because("blank target", aliases.where(~filled("target"))))
        .unionByName(
            because(
                "unknown target",
                aliases.where(~is_blank("target")).join(
                    names.withColumnRenamed("category", "target"), "target", "left_anti"
                ),
            )
        )
        .unionByName(
            because(
                "alias is a category", aliases.join(names.withColumnRenamed("category", "alias"), "alias", "left_semi")
            )
        )
    )


def combine_requests(resolved: DataFrame) -> DataFrame:
    """Counts per canonical category, in first-seen order; totals are kept."""
    return resolved.groupBy("request_id", F.col("canonical").alias("category")).agg(
        F.sum("requested").alias("requested"), F.min("ord").alias("ord")
    )


def build_plan(requests: DataFrame, block: int = PLAN_BLOCK) -> DataFrame:
    """Positions 1..N per request in category order; modes alternate in each category.

    Offsets are summed over the small category table.  A large count is opened up
    in blocks, which are spread before their rows are made.
    """
    before = Window.partitionBy("request_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("requested") - 1
    blocks = (
        requests.select(
            "request_id", "category", "requested", F.coalesce(F.sum("requested").over(before), F.lit(0)).alias("_before")
        )
        .where("requested > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))))
        .repartition("request_id", "category", "_block")
    )
    start = F.col("_block") * block
    return blocks.withColumn("_i", F.explode(F.sequence(start, F.least(last.cast("long"), start + block - 1)))).select(
        "request_id",
        (F.col("_before") + F.col("_i") + 1).alias("position"),
        "category",
        F.when(F.col("_i") % 2 == 0, "STYLE_SIMILAR").otherwise("INDEPENDENT").alias("generation_mode"),
    )
