"""Bookkeeping over a log of attempts: acceptance, exhaustion, duplicates, numbering."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from evidence_spark.functions.text import normalize
from evidence_spark.operators.graph import connected
from evidence_spark.operators.numbering import number_within
from evidence_spark.sources.tables import write_table

# The batch function below travels to the workers itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ATTEMPTS = 3
MAX_REPLACEMENTS = 2

# Failures that concern one question; all other known ones end the run.
QUESTION_LOCAL_FAILURES = (
    "InvalidGroundingOutputError",
    "InvalidTextbookOutputError",
    "QuestionAttemptsExhaustedError",
    "InsufficientDistinctTargetsError",
    "DuplicateReplacementExhausted",
)


def cut_at_acceptance(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, key: str = "position") -> DataFrame:
    """Attempts as the loop would have made them: none after the first accepted one or the budget.

    The stop is an aggregate joined back, not a window over all attempts of a question.
    """
    if max_attempts < 1:
        raise ValueError(f"max_attempts must be at least 1, got {max_attempts}")
    inside = attempts.where(F.col("attempt_number") <= max_attempts)
    stops = inside.groupBy(key).agg(F.min(F.when(F.col("accepted"), F.col("attempt_number"))).alias("_stop"))
    return (
        inside.join(stops, key)
        .where(F.col("_stop").isNull() | (F.col("attempt_number") <= F.col("_stop")))
        .drop("_stop")
    )


def outcomes(attempts: DataFrame, key: str = "position") -> DataFrame:
    """Per question: attempts made, accepted or exhausted, and the final attempt."""
    last = F.struct(*[F.col(c) for c in attempts.columns if c != key])
    return attempts.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.bool_or("accepted").alias("produced"),
        F.max_by(last, "attempt_number").alias("final_attempt"),
    )


def _fates(candidates: DataFrame, existing: DataFrame | None, last_try: int) -> DataFrame:
    """The tries with ``norm`` and ``fate``: ``new`` or ``duplicate`` where that can be told at once, else ``open``.

    A text that exists already is a duplicate.  If its first place is a first try it was certainly produced there, so that every
    later place is a duplicate; if it has one place it is new.  Only texts that first occur in a replacement are open: nobody knows
    yet whether that try was made.
    """
    tries = candidates.where(F.col("try_no") <= last_try).withColumn("norm", normalize("question"))
    place = F.struct("position", "try_no")
    texts = tries.groupBy("category", "norm").agg(F.min(place).alias("_first"), F.count("*").alias("_places"))
    if existing is None:
        texts = texts.withColumn("_known", F.col("norm").isNull())
    else:
        known = existing.select("category", normalize("question").alias("norm"), F.lit(True).alias("_known")).distinct()
        texts = texts.join(known, ["category", "norm"], "left").withColumn("_known", F.coalesce("_known", F.col("norm").isNull()))
    texts = texts.withColumnsRenamed({"category": "_category", "norm": "_norm"})
    same = tries["category"].eqNullSafe(texts["_category"]) & tries["norm"].eqNullSafe(texts["_norm"])
    fate = (
        F.when(F.col("_known"), "duplicate")
        .when(F.col("_places") == 1, "new")
        .when(F.col("_first.try_no") > 1, "open")
        .when(place == F.col("_first"), "new")
        .otherwise("duplicate")
    )
    return tries.join(texts, same).withColumn("fate", fate).drop("_category", "_norm", "_first", "_places", "_known")


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries sorted by component, category, position and try: an open text is new where it is first made."""
    component = place = None
    seen: set = set()
    ended = False
    for batch in batches:
        made, duplicate = [], []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_component", "category", "position", "norm", "fate"))
        for group, category, position, norm, fate in zip(*columns, strict=True):
            if group != component:
                component, seen = group, set()
            if (group, category, position) != place:
                place, ended = (group, category, position), False
            made.append(not ended)
            repeated = fate == "duplicate" or (fate == "open" and (category, norm) in seen)
            duplicate.append(repeated)
            if not ended and not repeated:
                ended = True
                if fate == "open":
                    seen.add((category, norm))
        yield batch.append_column("duplicate", pa.array(duplicate, pa.bool_())).filter(pa.array(made, pa.bool_()))


def control_duplicates(
    candidates: DataFrame, existing: DataFrame | None = None, max_replacements: int = MAX_REPLACEMENTS
) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates in a log of produced candidates (category, position, try_no, question).

    A text counts once per category; a repetition, or a text among the ``existing``
    questions, is a duplicate.  A position ends with its first new text or with try
    ``max_replacements + 1``: later tries are not made and leave their texts to later
    positions.  Returns the flagged candidates that were made and one row per position.

    Most texts are settled by aggregates, those that very many positions share among them.  Positions that share one of the
    open texts form a graph; each of its components is walked once, in order, and holds the open texts that it has
    seen.  Components are walked in parallel, and the number of jobs does not depend on how far one position waits for another.
    """
    tries = write_table(_fates(candidates, existing, max_replacements + 1), "tries")
    own = F.xxhash64(F.lit("position"), "category", "position")
    opened = tries.where("fate = 'open'").select(own.alias("a"), F.xxhash64(F.lit("text"), "category", "norm").alias("b"))
    groups = connected(opened).withColumnsRenamed({"node": "_own", "component": "_component"})
    placed = tries.withColumn("_own", own).join(groups, "_own", "left").withColumn("_component", F.coalesce("_component", "_own")).drop("_own")
    ordered = placed.repartition("_component").sortWithinPartitions("_component", "category", "position", "try_no", "norm")
    schema = StructType([*ordered.schema.fields, StructField("duplicate", BooleanType())])
    flagged = write_table(ordered.mapInArrow(_in_turn, schema).drop("_component", "fate", "norm"), "made")
    positions = (
        flagged.groupBy("category", "position")
        .agg(
            F.bool_or(~F.col("duplicate")).alias("accepted"),
            F.count_if("duplicate").alias("duplicates"),
        )
        .withColumn("exhausted", ~F.col("accepted") & (F.col("duplicates") > max_replacements))
    )
    return flagged, positions


def renumber(accepted: DataFrame, group: str = "exam_id", block: int = 10_000) -> DataFrame:
    """Numbers 1..n in plan order; the planned ``position`` stays."""
    return number_within(accepted, [group], "position", "number", block)


def clean_question(number: Column) -> list[Column]:
    """The public fields of a candidate (question, answers, correct_answer, category)."""
    return [
        number.alias("number"),
        F.col("question"),
        *[F.get("answers", F.lit(i)).alias(f"answer{i + 1}") for i in range(4)],
        F.col("correct_answer"),
        F.col("category"),
    ]


def run_summary(results: DataFrame) -> DataFrame:
    """Per exam (exam_id, position, accepted): counts, status, and whether positions are 1..N."""
    return (
        results.groupBy("exam_id")
        .agg(
            F.count("*").alias("planned"),
            F.count_if("accepted").alias("accepted"),
            F.count_if(~F.col("accepted")).alias("failed"),
            F.min("position").alias("_low"),
            F.max("position").alias("_high"),
            F.count_distinct("position").alias("_distinct"),
        )
        .select(
            "exam_id",
            "planned",
            "accepted",
            "failed",
            F.when(F.col("failed") == 0, "COMPLETE").otherwise("PARTIAL").alias("status"),
            (
                (F.col("_low") == 1) & (F.col("_high") == F.col("planned")) & (F.col("_distinct") == F.col("planned"))
            ).alias("positions_complete"),
        )
    )


def classify_failures(failures: DataFrame, local=QUESTION_LOCAL_FAILURES) -> DataFrame:
    return failures.withColumn(
        "scope", F.when(F.col("failure_type").isin(*local), "QUESTION").otherwise("SYSTEM")
    )


def assert_no_system_failure(failures: DataFrame, local=QUESTION_LOCAL_FAILURES) -> DataFrame:
    """Let question-local failures through; the first system failure ends the job that reads them."""
    message = F.concat(F.lit("system failure: "), "failure_type", F.lit(": "), F.coalesce("message", F.lit("")))
    return classify_failures(failures, local).withColumn(
        "scope", F.when(F.col("scope") == "SYSTEM", F.raise_error(message).cast("string")).otherwise(F.col("scope"))
    )
