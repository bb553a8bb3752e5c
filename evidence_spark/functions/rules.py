"""Row rules: each failing rule adds its message to an array column."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.functions.text import Text, col, is_blank

# The closed sets of the data model.
GENERATION_MODES = ("STYLE_SIMILAR", "INDEPENDENT")
TEXTBOOK_STATUSES = ("CONSISTENT", "NOT_FOUND", "POTENTIAL_CONFLICT")
DISTRACTOR_ARCHETYPES = (
    "SIBLING_STRUCTURE",
    "PARENT_CATEGORY",
    "CHILD_CATEGORY",
    "NEIGHBORING_ANATOMY",
    "FUNCTIONAL_CONFUSION",
    "LOCATION_CONFUSION",
    "DEVELOPMENTAL_STAGE_CONFUSION",
    "TERMINOLOGY_CONFUSION",
)
DIFFICULTIES = ("EASY", "MEDIUM", "HARD")


def filled(c: Text) -> Column:
    """Neither null nor blank."""
    return F.coalesce(~is_blank(c), F.lit(False))


def positive(c: Text) -> Column:
    return F.coalesce(col(c) > 0, F.lit(False))


def not_negative(c: Text) -> Column:
    return F.coalesce(col(c) >= 0, F.lit(False))


def answer_number(c: Text) -> Column:
    return F.coalesce(col(c).between(1, 4), F.lit(False))


def unit_interval(c: Text) -> Column:
    return F.coalesce(col(c).between(0.0, 1.0), F.lit(False))


def one_of(c: Text, values) -> Column:
    return F.coalesce(col(c).isin(*values), F.lit(False))


def four_answers(c: Text) -> Column:
    four = [filled(F.get(col(c), F.lit(i))) for i in range(4)]
    return F.coalesce((F.size(col(c)) == 4) & reduce(and_, four), F.lit(False))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Messages of the rules that do not hold, in the given order.

    Made of plain array functions, which stay inside generated code; the argument of a function with a lambda does not.
    """
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(~rule, F.array(F.lit(message))).otherwise(none) for message, rule in rules.items()]))


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("errors", failed_rules(rules))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their errors."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
