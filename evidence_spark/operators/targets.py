"""Question targets planned straight from the concepts of the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evidence_spark.functions.concepts import ENUMERATION_CUES, SOURCE_CUES, SOURCE_WINDOW, cue_before
from evidence_spark.functions.text import bind, compute
from evidence_spark.operators.anchoring import (
    BROAD,
    NARROW,
    anchor,
    entity_above,
    in_enumeration,
    is_sufficient,
    only_enumerated,
    with_lines,
)
from evidence_spark.operators.concepts import ORDER
from evidence_spark.operators.identity import untested
from evidence_spark.operators.relations import UNSPECIFIED, classify

CHUNK = ["scope", "rank", "chunk_id"]


def with_chunk_lines(refined: DataFrame, evidence: DataFrame) -> DataFrame:
    """Bring the lines of its own chunk to every concept."""
    return refined.join(with_lines(evidence.select(*CHUNK, "text")), CHUNK)


def plan_targets(
    refined: DataFrame,
    evidence: DataFrame,
    tested: DataFrame | None = None,
    count: int | None = None,
    enumeration_cues=ENUMERATION_CUES,
    source_cues=SOURCE_CUES,
) -> DataFrame:
    """At most ``count`` targets per scope, in inventory order.

    Concepts already tested (scope, answer) are left out, and so are those whose
    context stays empty even in the broad walk or only introduces a list.
    """
    placed = with_chunk_lines(refined, evidence)
    if tested is not None:
        placed = untested(placed, tested, ascii_only=True)
    concept, source_lines = F.col("concept"), F.col("source_lines")
    focus = bind(
        anchor(concept, source_lines, NARROW),
        lambda near: F.when(is_sufficient(near, concept), near).otherwise(anchor(concept, source_lines, BROAD)),
    )
    source_role = cue_before("text", "concept", source_cues, SOURCE_WINDOW)
    usable = (
        compute(placed, "focus", focus)
        .where(is_sufficient(F.col("focus"), concept))
        .where(~only_enumerated(F.col("focus"), concept, enumeration_cues))
        .select(
            "scope",
            *ORDER,
            F.col("concept").alias("topic"),
            F.col("focus").alias("factual_focus"),
            F.array("chunk_id").alias("own_chunks"),
            F.lit(True).alias("named_entity"),
            source_role.alias("source_role"),
            F.when(source_role, entity_above(concept)).alias("source_entity"),
            in_enumeration(F.col("focus"), concept, enumeration_cues).alias("enumeration_member"),
        )
    )
    numbered = usable.withColumn("target_id", F.row_number().over(Window.partitionBy("scope").orderBy(*ORDER)))
    kept = numbered if count is None else numbered.where(F.col("target_id") <= count)
    return kept.drop(*ORDER)


def with_relationship(targets: DataFrame, lexicon=None) -> DataFrame:
    return targets.withColumn("relationship", classify(F.lower("factual_focus"), lexicon))


def signal_panel(
    refined: DataFrame, evidence: DataFrame, enumeration_cues=ENUMERATION_CUES, lexicon=None
) -> DataFrame:
    """What the narrow and the broad context of every concept would allow."""
    concept, source_lines = F.col("concept"), F.col("source_lines")
    placed = with_chunk_lines(refined, evidence)
    placed = compute(placed, "narrow", anchor(concept, source_lines, NARROW))
    placed = compute(placed, "broad", anchor(concept, source_lines, BROAD))
    panel = [F.col("scope"), concept]
    for name in ("narrow", "broad"):
        focus = F.col(name)
        relationship = classify(F.lower(focus), lexicon)
        panel += [
            focus,
            is_sufficient(focus, concept).alias(f"{name}_sufficient"),
            (~only_enumerated(focus, concept, enumeration_cues)).alias(f"{name}_distinct"),
            in_enumeration(focus, concept, enumeration_cues).alias(f"{name}_enumeration"),
            relationship.alias(f"{name}_relationship"),
            (relationship != UNSPECIFIED).alias(f"{name}_related"),
        ]
    return placed.select(*panel)
