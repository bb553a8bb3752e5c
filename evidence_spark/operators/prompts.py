"""Prompt tables for an external model: generation, planning and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.functions import prompts as p
from evidence_spark.functions.checks import correct_text, numbered_answers
from evidence_spark.functions.rules import check_rows, filled
from evidence_spark.operators.relations import discover_competitors, with_default_strategy
from evidence_spark.operators.retrieval import EvidenceIndex, search

SYSTEM = "You write and check exam questions from supplied evidence only."
GENERATION = (
    "Category: {category}\nMode: {generation_mode}\nRelationship: {relationship}\n\n{target}\n\n{identity_rule}\n"
    "{language_rule}\n{role_rule}\n{enumeration_rule}\n{strategy_rule}\n\n{competitors}\n\n{evidence}\n\n{reference}"
)
PLANNING = "Category: {category}\nTargets wanted: {count}\n\n{evidence}\n\n{coverage}"
VALIDATION = "{candidate}\n\n{evidence}"
STRUCTURE = "{candidate}"
CATEGORY = "Requested category: {category}\n\n{candidate}"


def evidence_lists(evidence: DataFrame, key: str = "scope") -> DataFrame:
    """The evidence of a scope as one ordered array; bounded by top-k."""
    item = F.struct("rank", "source_file", "page", "chunk_id", "text")
    return evidence.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("chunks"))


def generation_prompts(
    targets: DataFrame,
    evidence: DataFrame,
    references: DataFrame,
    strategies: DataFrame | None = None,
    lexicon=None,
    system: str = SYSTEM,
    template: str = GENERATION,
) -> DataFrame:
    """One row per target (scope, target_id, category, generation_mode, ...) with messages or errors.

    Optional columns of a target say what it was made for, and have to agree with what is asked: ``supplied_reference`` (a style
    reference given along with it), ``target_category`` and ``relationship_focus`` (the statement its relationship was read from).
    """
    found = discover_competitors(targets, evidence, lexicon)
    competitors = found.groupBy("scope", "target_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "relationship", "snippet"))).alias("competitors")
    )
    wants = F.col("generation_mode") == "STYLE_SIMILAR"
    rows = (
        with_default_strategy(targets, strategies)
        .join(evidence_lists(evidence), "scope", "left")
        .join(competitors, ["scope", "target_id"], "left")
        .join(references, "category", "left")
        .withColumn("reference", F.when(wants, F.col("reference")))
    )
    agreements = {
        "supplied_reference": ("a style reference is given for an independent question", wants | F.col("supplied_reference").isNull()),
        "target_category": ("the target belongs to another category", F.col("target_category").eqNullSafe(F.col("category"))),
        "relationship_focus": ("the relationship was read from another focus", F.col("relationship_focus").eqNullSafe(F.col("factual_focus"))),
    }
    checked = check_rows(
        rows,
        {
            "category must not be blank": filled("category"),
            "no evidence for the scope": F.coalesce(F.size("chunks"), F.lit(0)) > 0,
            "no style reference for the category": ~wants | F.col("reference").isNotNull(),
            **dict(rule for column, rule in agreements.items() if column in targets.columns),
        },
    ).select("*", *p.requirement_texts())
    task = p.fill(
        template,
        {
            **{
                c: F.col(c)
                for c in (
                    "category",
                    "generation_mode",
                    "relationship",
                    "identity_rule",
                    "language_rule",
                    "role_rule",
                    "enumeration_rule",
                    "strategy_rule",
                )
            },
            "target": p.target_block("topic", "factual_focus"),
            "competitors": p.competitor_block("competitors"),
            "evidence": p.evidence_block("chunks"),
            "reference": p.reference_block("reference"),
        },
    )
    return checked.select(
        "scope",
        "target_id",
        "category",
        "generation_mode",
        F.when(F.size("errors") == 0, p.messages(system, task)).alias("messages"),
        "errors",
    )


def planning_prompts(
    requests: DataFrame, evidence: DataFrame, coverage: DataFrame, system: str = SYSTEM, template: str = PLANNING
) -> DataFrame:
    """One row per scope (scope, category, count) asking for targets, with what is covered so far."""
    none = F.array().cast("array<string>")
    rows = requests.join(evidence_lists(evidence), "scope", "left").join(coverage, "category", "left")
    checked = check_rows(
        rows,
        {
            "category must not be blank": filled("category"),
            "no evidence for the scope": F.coalesce(F.size("chunks"), F.lit(0)) > 0,
            "count must be at least 1": F.coalesce(F.col("count") >= 1, F.lit(False)),
        },
    )
    task = p.fill(
        template,
        {
            "category": F.col("category"),
            "count": F.col("count").cast("string"),
            "evidence": p.evidence_block("chunks"),
            "coverage": p.coverage_block(
                F.coalesce("tested_concepts", none), F.coalesce("tested_relationship_types", none)
            ),
        },
    )
    return checked.select(
        "scope", "category", F.when(F.size("errors") == 0, p.messages(system, task)).alias("messages"), "errors"
    )


def validation_queries(candidates: DataFrame) -> DataFrame:
    """Search texts of candidates: category, question and the right answer, no distractors."""
    query = F.concat_ws(" ", "category", "question", correct_text("answers", "correct_answer"))
    return candidates.select("query_id", query.alias("query"))


def _candidate() -> Column:
    return p.candidate_block("question", "answers", "correct_answer", "category", "generation_mode")


def evidence_check_prompts(
    candidates: DataFrame, index: EvidenceIndex, secondary: bool = False, top_k: int = 8, system: str = SYSTEM
) -> DataFrame:
    """Grounding check against an index; the secondary check decides NOT_FOUND itself if nothing is found."""
    found = evidence_lists(search(index, validation_queries(candidates), top_k), "query_id")
    rows = candidates.join(found, "query_id", "left")
    block = p.evidence_block("chunks", "secondary evidence" if secondary else "evidence")
    task = p.fill(VALIDATION, {"candidate": _candidate(), "evidence": block})
    there = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    decided = F.when(~there, "NOT_FOUND" if secondary else "no evidence")
    return rows.select(
        "query_id",
        F.when(there, p.messages(system, task)).alias("messages"),
        F.coalesce(F.col("chunks.chunk_id"), F.array().cast("array<string>")).alias("chunk_ids"),
        decided.alias("decided"),
    )


def text_check_prompts(candidates: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Structure, category and quality checks.

    Answers that repeat their numbers fail the quality check without a call.
    """
    numbered = numbered_answers("answers")
    kinds = {
        "structure": p.fill(STRUCTURE, {"candidate": _candidate()}),
        "category": p.fill(CATEGORY, {"category": F.col("category"), "candidate": _candidate()}),
        "quality": F.when(numbered.isNull(), p.fill(STRUCTURE, {"candidate": _candidate()})),
    }
    checks = F.array(
        *[F.struct(F.lit(kind).alias("check"), task.alias("task")) for kind, task in kinds.items()]
    )
    return candidates.select("query_id", numbered.alias("numbered_answers"), F.explode(checks).alias("c")).select(
        "query_id",
        "c.check",
        F.when(F.col("c.task").isNotNull(), p.messages(system, F.col("c.task"))).alias("messages"),
        F.when(F.col("c.task").isNull(), F.col("numbered_answers")).alias("numbered_answers"),
    )
