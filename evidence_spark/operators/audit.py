"""Audit records of a question set and their reconciliation with what was put out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VERDICTS = ("grounding_passed", "mcq_valid", "category_valid", "quality_valid", "textbook_status")


def exam_id(generated_at: Column) -> Column:
    """Id from a time stamp, in a UTC session."""
    return F.date_format(generated_at, "yyyyMMdd'T'HHmmss'Z'")


def question_audit(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per accepted question with its attempts in order.

    ``questions`` has exam_id, number, position, category and generation_mode.  The
    last attempt gives the final verdicts.  One row per question, not one per exam:
    an exam may be large.
    """
    step = F.struct("attempt_number", "accepted", *VERDICTS)
    nested = attempts.groupBy("exam_id", "position").agg(
        F.array_sort(F.collect_list(step)).alias("attempts"), F.max_by(step, "attempt_number").alias("_last")
    )
    return questions.join(nested, ["exam_id", "position"], "left").select(
        "exam_id",
        "number",
        F.col("position").alias("planned_position"),
        "category",
        "generation_mode",
        *[F.col(f"_last.{v}").alias(v) for v in VERDICTS],
        F.size("attempts").alias("generation_attempts"),
        "attempts",
    )


def failed_audit(failures: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per failed position (exam_id, position, category, generation_mode, failure_type, message)."""
    step = F.struct("attempt_number", "accepted", *VERDICTS)
    nested = attempts.groupBy("exam_id", "position").agg(F.array_sort(F.collect_list(step)).alias("attempts"))
    return failures.join(nested, ["exam_id", "position"], "left").select(
        "exam_id",
        F.col("position").alias("planned_position"),
        "category",
        "generation_mode",
        "failure_type",
        "message",
        F.coalesce("attempts", F.array().cast(nested.schema["attempts"].dataType)).alias("attempts"),
    )


def audit_header(summary: DataFrame, generated_at: Column, provider: str, model: str) -> DataFrame:
    """The exam-level part: identity, provenance, status and counts."""
    return summary.select(
        "exam_id",
        generated_at.alias("generated_at"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        "status",
        F.col("planned").alias("planned_question_count"),
        F.col("accepted").alias("accepted_count"),
        F.col("failed").alias("failed_count"),
    )


def reconcile(questions: DataFrame, produced: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows on which output, production and audit disagree, with the fields concerned.

    Compares number by number; a side that lacks the number is named.
    ``produced`` carries number, position, category, the candidate and ``last_accepted``.
    """
    on = ["exam_id", "number"]

    def side(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        return df.select(*on, F.struct(F.lit(True).alias("there"), *fields).alias(name))

    q = side(questions, "q", ["category", "question", "answers", "correct_answer"])
    p = side(produced, "p", ["position", "category", "question", "answers", "correct_answer", "last_accepted"])
    a = side(audit, "a", ["planned_position", "category"])

    def differs(left: str, right: str) -> Column:
        return ~F.col(left).eqNullSafe(F.col(right))

    everywhere = F.col("q").isNotNull() & F.col("p").isNotNull() & F.col("a").isNotNull()
    tests = {
        "missing in questions": F.col("q").isNull(),
        "missing in production": F.col("p").isNull(),
        "missing in audit": F.col("a").isNull(),
        "position": everywhere & differs("p.position", "a.planned_position"),
        "category": everywhere & (differs("q.category", "p.category") | differs("q.category", "a.category")),
        "question": everywhere & differs("q.question", "p.question"),
        "answers": everywhere & differs("q.answers", "p.answers"),
        "correct answer": everywhere & differs("q.correct_answer", "p.correct_answer"),
        "last attempt not accepted": everywhere & ~F.coalesce(F.col("p.last_accepted"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return (
        q.join(p, on, "full_outer")
        .join(a, on, "full_outer")
        .select(*on, found.alias("mismatches"))
        .where(F.size("mismatches") > 0)
    )


def reconcile_failed(failures: DataFrame, audit: DataFrame) -> DataFrame:
    """The same for failed positions: present on both sides, with equal category and mode."""
    on = ["exam_id", "position"]
    f = failures.select(*on, F.struct("category", "generation_mode").alias("f"))
    a = audit.select(
        "exam_id", F.col("planned_position").alias("position"), F.struct("category", "generation_mode").alias("a")
    )
    tests = {
        "missing in result": F.col("f").isNull(),
        "missing in audit": F.col("a").isNull(),
        "category": F.col("f.category") != F.col("a.category"),
        "generation mode": F.col("f.generation_mode") != F.col("a.generation_mode"),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return (
        f.join(a, on, "full_outer").select(*on, found.alias("mismatches")).where(F.size("mismatches") > 0)
    )
