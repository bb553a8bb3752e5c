"""The bank of earlier questions: style references, never evidence."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.functions.rules import answer_number, check_rows, filled, four_answers, positive
from evidence_spark.functions.text import is_blank
from evidence_spark.operators.numbering import number_within

# The columns a question bank must have.
REQUIRED = ("id", "category", "question", "answer1", "answer2", "answer3", "answer4", "correct_answer_id")


def check_header(columns: list[str]) -> None:
    """Each required column exactly once; order and further columns do not matter."""
    missing = [name for name in REQUIRED if name not in columns]
    repeated = [name for name in REQUIRED if columns.count(name) > 1]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if repeated:
        raise ValueError(f"columns given more than once: {', '.join(repeated)}")


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV question bank; ``row_no`` counts lines of the file, the header being 1."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError("the question bank has no header")
    check_header([name.strip() for name in next(csv.reader([header[0]], skipinitialspace=True))])
    rows = spark.read.csv(path, header=True, multiLine=True).withColumn("_id", F.monotonically_increasing_id())
    numbered = number_within(rows.withColumn("_file", F.lit(path)), ["_file"], "_id", "row_no")
    return numbered.withColumn("row_no", F.col("row_no") + 1).drop("_id", "_file")


def bank_rows(raw: DataFrame) -> DataFrame:
    """Typed bank rows; rows without any content are skipped."""
    check_header(raw.columns)
    cells = F.array(*[F.col(c).cast("string") for c in raw.columns if c != "row_no"])
    return raw.where(~F.forall(cells, lambda c: c.isNull() | is_blank(c))).select(
        F.col("id").try_cast("long").alias("historical_question_id"),
        "row_no",
        "category",
        "question",
        F.array("answer1", "answer2", "answer3", "answer4").alias("answers"),
        F.col("correct_answer_id").try_cast("int").alias("correct_answer"),
    )


def check_bank(bank: DataFrame) -> DataFrame:
    """Add ``errors``; a repeated id names the row that had it first.

    The first rows come from an aggregate that is joined back, so an id that is
    repeated very often does not gather in one task.
    """
    checked = check_rows(
        bank,
        {
            "id must be a positive integer": positive("historical_question_id"),
            "category must not be blank": filled("category"),
            "question must not be blank": filled("question"),
            "four filled answers are needed": four_answers("answers"),
            "correct answer must be 1 to 4": answer_number("correct_answer"),
        },
    )
    first = (
        checked.where(F.size("errors") == 0)
        .groupBy("historical_question_id")
        .agg(F.min("row_no").alias("first_row"))
    )
    repeated = F.col("row_no") > F.col("first_row")
    message = F.format_string("id already used in row %d", "first_row")
    extra = F.when((F.size("errors") == 0) & repeated, F.array(message)).otherwise(F.array().cast("array<string>"))
    return (
        checked.join(first, "historical_question_id", "left")
        .withColumn("errors", F.concat("errors", extra))
        .drop("first_row")
    )


def canonical_categories(bank: DataFrame) -> DataFrame:
    """Categories with their question counts; ``first_row`` gives the first-seen order."""
    return bank.groupBy("category").agg(F.min("row_no").alias("first_row"), F.count("*").alias("questions"))


def questions_for_category(bank: DataFrame, category: str) -> DataFrame:
    return bank.where(F.col("category") == category)


def style_references(bank: DataFrame) -> DataFrame:
    """The first question of every category."""
    reference = F.struct("historical_question_id", "category", "question", "answers", "correct_answer")
    return bank.groupBy("category").agg(F.min_by(reference, "row_no").alias("reference"))
