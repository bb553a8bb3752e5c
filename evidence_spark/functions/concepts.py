"""Line shapes and cue phrases, as native predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidence_spark.functions.text import (
    WHITESPACE_CLASS,
    Text,
    bind,
    col,
    contains_any,
    count_matches,
    first_index,
    strip,
    window_before,
)

# What a line naming a concept may be made of, and its limits.
CONCEPT_LINE = rf"\A[A-Za-z0-9()/,\-.{WHITESPACE_CLASS}]+\z"
MIN_LETTERS = 2
MAX_WORDS = 6
TOO_MANY_WORDS = rf"\A(?:[^A-Za-z]*+[A-Za-z]++){{{MAX_WORDS + 1}}}"

# Cue phrases and the widths of the windows they are looked for in.
NAMING_CUES = (
    "נקרא גם",
    "נקראים גם",
    "נקראת גם",
    "הנקרא",
    "המכונה",
    "מכונה גם",
    "ידוע גם כ",
    "ידועה גם כ",
)
NAMING_WINDOW = 60
SOURCE_CUES = ("מקור",)
SOURCE_WINDOW = 25
ENUMERATION_CUES = (
    "מספר תתי",
    "תתי מבנים",
    "כוללים",
    "כוללת",
    "כולל ",
    "מורכב מ",
    "מורכבת מ",
    "several",
    "the following",
    "consists of",
    "includes",
)


def word_count(c: Text) -> Column:
    return count_matches(c, "[A-Za-z]+")


def is_concept_line(line: Text) -> Column:
    """A short, capitalised, ASCII-only line: the shape of a named list item.

    A line of too many words is told by its first ones, without looking at the rest.
    """
    return ~col(line).rlike(TOO_MANY_WORDS) & bind(
        strip(line),
        lambda text: text.rlike(CONCEPT_LINE)
        & (count_matches(text, "[A-Za-z]") >= MIN_LETTERS)
        & text.rlike("[A-Z]")
        & word_count(text).between(1, MAX_WORDS),
    )


def starts_lower(concept: Text) -> Column:
    """The first letter is small: the beginning of the concept was cut off."""
    return strip(concept).rlike("^[a-z]")


def is_continuation(line: Text) -> Column:
    """A line that can only be the rest of a broken word."""
    return bind(strip(line), lambda text: text.rlike(CONCEPT_LINE) & text.rlike("^[a-z]"))


def balanced_parens(c: Text) -> Column:
    return count_matches(c, r"\(") == count_matches(c, r"\)")


def cue_before(text: Text, needle: Text, cues, width: int) -> Column:
    """A cue phrase stands shortly before the needle's first occurrence."""
    text, needle = col(text), col(needle)
    return bind(
        first_index(text, needle),
        lambda at: (at >= 0) & contains_any(window_before(text, at, width), cues),
    )
