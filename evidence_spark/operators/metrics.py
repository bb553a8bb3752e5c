"""Evaluation metrics over attempt logs.  Ratios over nothing are 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

VALIDATORS = {
    "grounding": "grounding_passed",
    "mcq": "mcq_valid",
    "category": "category_valid",
    "quality": "quality_valid",
}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def acceptance_rates(attempts: DataFrame) -> DataFrame:
    """Accepted per attempt, and accepted at the first attempt per accepted one."""
    good = F.count_if("accepted")
    return attempts.agg(
        F.count("*").alias("attempts"),
        good.alias("accepted"),
        _share(good, F.count("*")).alias("acceptance_rate"),
        _share(F.count_if(F.col("accepted") & (F.col("attempt_number") == 1)), good).alias("first_attempt_rate"),
    )


def _per_question(attempts: DataFrame, *more: str) -> DataFrame:
    return attempts.groupBy(*more, "question_position").agg(
        F.count("*").alias("n"), F.bool_or("accepted").alias("produced")
    )


def attempts_per_accepted(attempts: DataFrame) -> DataFrame:
    """Attempt counts over the questions that were accepted in the end."""
    n = F.col("n")
    return (
        _per_question(attempts)
        .where("produced")
        .agg(
            F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"),
            F.coalesce(F.median(n), F.lit(0.0)).alias("median"),
            F.coalesce(F.min(n).cast("double"), F.lit(0.0)).alias("min"),
            F.coalesce(F.max(n).cast("double"), F.lit(0.0)).alias("max"),
            F.count("*").alias("n"),
        )
    )


def exhaustion_rate(attempts: DataFrame) -> DataFrame:
    """Share of questions with attempts of which none was accepted."""
    return _per_question(attempts).agg(
        F.count("*").alias("questions"),
        F.count_if(~F.col("produced")).alias("exhausted"),
        _share(F.count_if(~F.col("produced")), F.count("*")).alias("exhaustion_rate"),
    )


def validator_failures(attempts: DataFrame) -> DataFrame:
    """Failures per validator among rejected attempts; one attempt may fail several."""
    rejected = attempts.where(~F.col("accepted")).agg(
        F.count("*").alias("total_rejected"),
        *[F.count_if(~F.col(c)).alias(name) for name, c in VALIDATORS.items()],
    )
    pairs = F.array(
        *[F.struct(F.lit(name).alias("validator"), F.col(name).alias("failures")) for name in VALIDATORS]
    )
    return rejected.select("total_rejected", F.explode(pairs).alias("p")).select(
        "p.validator", "p.failures", "total_rejected", _share(F.col("p.failures"), F.col("total_rejected")).alias("rate")
    )


def textbook_distribution(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("textbook_status").agg(F.count("*").alias("attempts"))


def grouped_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts of each question as an ordered array."""
    step = F.struct("attempt_number", "accepted", "textbook_status")
    return attempts.groupBy("question_position").agg(F.array_sort(F.collect_list(step)).alias("attempts"))


def category_rollup(plan: DataFrame, attempts: DataFrame, failures: DataFrame) -> DataFrame:
    """What became of the plan, per category, in plan order (``first_position``)."""
    requested = plan.groupBy("category").agg(
        F.count("*").alias("requested_questions"), F.min("position").alias("first_position")
    )
    tried = (
        attempts.groupBy("category", "question_position")
        .agg(F.count("*").alias("n"), F.count_if("accepted").alias("good"))
        .groupBy("category")
        .agg(
            F.count_if(F.col("good") > 0).alias("produced_questions"),
            F.sum("n").alias("candidate_attempts"),
            F.sum("good").alias("accepted_candidates"),
            F.sum(F.col("n") - F.col("good")).alias("rejected_candidates"),
            F.count_if(F.col("good") == 0).alias("exhausted_units"),
        )
    )
    broken = failures.groupBy("category").agg(F.count("*").alias("operational_failures"))
    return requested.join(tried, "category", "left").join(broken, "category", "left").na.fill(0)


def attempt_records(attempts: DataFrame) -> DataFrame:
    """Flat records; the text is kept for accepted attempts only."""
    kept = {c: F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("question", "answers", "correct_answer")}
    return attempts.select(*[kept.get(c, F.col(c)) for c in attempts.columns])


def evaluation_report(run_id: str, sections: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One long table of a run's results: (run_id, section, key, measure, value).

    ``sections`` names result tables and the column that tells their rows apart (none for a table of one row).  Numbers and
    flags become values; a null has no row.
    """
    parts = []
    for name, (table, key) in sections.items():
        measures = [f.name for f in table.schema if f.name != key and isinstance(f.dataType, (NumericType, BooleanType))]
        label = F.col(key).cast("string") if key else F.lit(None).cast("string")
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        rows = table.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("section"), label.alias("key"), cells.alias("c"))
        parts.append(rows.select("run_id", "section", "key", "c.measure", "c.value").where("value is not null"))
    return reduce(DataFrame.unionByName, parts)


def combined_retrieval(results: DataFrame) -> DataFrame:
    """Retrieval results of several runs (``run_id``, query_id, ...) with every query once: retrieval does not depend on the run.

    Runs that disagree on a query are an error, as one of them was not made on the same index.
    """
    hits = [c for c in results.columns if c.startswith("hit_at_")]
    shown = F.struct("expected_chunks", *hits)
    once = results.groupBy("query_id").agg(F.min(shown).alias("a"), F.max(shown).alias("b"))
    same = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("runs disagree on query "), F.col("query_id").cast("string"))).cast(once.schema["a"].dataType))
    return once.select("query_id", same.alias("r")).select("query_id", "r.*")


def combined_report(runs: DataFrame) -> DataFrame:
    """Attempts of several runs (``run_id``) counted together, next to each run alone."""
    together = acceptance_rates(runs).select(F.lit("all").alias("run_id"), "*")
    good = F.count_if("accepted")
    each = runs.groupBy("run_id").agg(
        F.count("*").alias("attempts"),
        good.alias("accepted"),
        _share(good, F.count("*")).alias("acceptance_rate"),
        _share(F.count_if(F.col("accepted") & (F.col("attempt_number") == 1)), good).alias("first_attempt_rate"),
    )
    return each.unionByName(together)
