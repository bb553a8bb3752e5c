"""The forms a concept is recognised by, and what questions have covered already."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evidence_spark.functions.text import WHITESPACE_CLASS, bind, normalize, strip
from evidence_spark.operators.relations import UNSPECIFIED, classify

# The batch function below travels to the workers itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the script a bracketed counterpart of a Latin name is written in.
PAIRED_SCRIPT = r"\x{590}-\x{5ff}"
PUNCTUATION = r"[().,]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized_forms(concept: Column, ascii_only: bool = False) -> Column:
    """Distinct normal forms, in order; ASCII concepts need no compatibility form."""
    forms = [normalize(concept)]
    if not ascii_only:
        forms.append(normalize(nfkc(concept)))
    forms.append(normalize(F.regexp_replace(concept, PUNCTUATION, " ")))
    return F.filter(F.array_distinct(F.array(*forms)), lambda f: f != "")


def paired_form(bare_lines: Column, concept: Column, script: str = PAIRED_SCRIPT) -> Column:
    """Bracketed text in the paired script on a line naming the concept, or next to one.

    Of every line only its first bracket counts.  The own line is tried first, then
    the one above, then the one below; lines are taken in text order.
    """
    whole = rf"\A(?:[{script}][{script}{WHITESPACE_CLASS}]*[{script}]|[{script}])\z"
    brackets = F.transform(
        bare_lines,
        lambda line: bind(
            strip(F.regexp_extract(line, r"\(([^()]*)\)", 1)), lambda inner: F.when(inner.rlike(whole), inner)
        ),
    )
    hits = F.transform(
        bare_lines,
        lambda line, i: F.when(
            line.contains(concept), F.coalesce(F.get(brackets, i), F.get(brackets, i - 1), F.get(brackets, i + 1))
        ),
    )
    return F.get(F.array_compact(hits), F.lit(0))


def concept_forms(inventory: DataFrame, ascii_only: bool = False, script: str = PAIRED_SCRIPT) -> DataFrame:
    """Long table scope, concept, form, kind.  ``inventory`` carries the ``bare`` lines of its chunk."""
    paired = normalize(paired_form(F.col("bare"), F.col("concept"), script))
    kinds = F.concat(
        F.transform(
            normalized_forms(F.col("concept"), ascii_only),
            lambda f: F.struct(f.alias("form"), F.lit("normalized").alias("kind")),
        ),
        F.array_compact(
            F.array(F.when(paired.isNotNull(), F.struct(paired.alias("form"), F.lit("paired").alias("kind"))))
        ),
    )
    return inventory.select("scope", "concept", F.explode(kinds).alias("f")).select(
        "scope", "concept", "f.form", "f.kind"
    )


def covered_values(questions: DataFrame, lexicon=None) -> DataFrame:
    """Answers and relationship types asked for so far, one row per category and value.

    ``questions`` has category, ord, question and answer; the first occurrence of a
    value gives its ``ord``.
    """
    rows = questions.select(
        "category",
        "ord",
        strip("answer").alias("answer"),
        classify(F.lower(F.concat_ws(" ", "question", "answer")), lexicon).alias("relationship"),
    )
    kinds = F.array(
        F.struct(F.lit("concept").alias("kind"), F.nullif("answer", F.lit("")).alias("value")),
        F.struct(F.lit("relationship").alias("kind"), F.nullif("relationship", F.lit(UNSPECIFIED)).alias("value")),
    )
    return (
        rows.select("category", "ord", F.explode(kinds).alias("v"))
        .where(F.col("v.value").isNotNull())
        .groupBy("category", "v.kind", "v.value")
        .agg(F.min("ord").alias("ord"))
    )


def category_coverage(questions: DataFrame, lexicon=None) -> DataFrame:
    """The covered values of a category as two ordered lists, which is what a prompt shows.

    For categories with very many distinct answers use ``covered_values``.
    """
    first = covered_values(questions, lexicon)

    def listed(kind: str) -> Column:
        chosen = F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value")))
        return F.sort_array(chosen).getField("value")

    return first.groupBy("category").agg(
        listed("concept").alias("tested_concepts"), listed("relationship").alias("tested_relationship_types")
    )


def untested(inventory: DataFrame, tested: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Drop every concept one of whose forms equals a tested answer (scope, answer)."""
    answers = tested.select("scope", normalize("answer").alias("form")).distinct()
    seen = concept_forms(inventory, ascii_only).join(answers, ["scope", "form"], "left_semi")
    return inventory.join(seen.select("scope", "concept").distinct(), ["scope", "concept"], "left_anti")
