"""Concepts named in evidence: extraction and repair of broken names.

``evidence`` has the columns scope, rank, chunk_id and text: for every scope (a
query, a category, a file) the chunks found for it, in rank order.  All scopes
are worked on in one job.
"""

from __future__ import annotations

import sys
from itertools import takewhile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from evidence_spark.functions.concepts import (
    NAMING_CUES,
    NAMING_WINDOW,
    cue_before,
    is_concept_line,
    is_continuation,
    starts_lower,
    word_count,
)
from evidence_spark.functions.text import bind, first_index, lines, normalize, strip, window_around

# The batch function below travels to the workers itself; they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTEXT_WIDTH = 120
MAX_FRAGMENTS = 5
ORDER = ["rank", "line_no"]


def first_of(df: DataFrame, group: list, order: list[str]) -> DataFrame:
    """Keep the first row per group; Spark limits the groups before it shuffles them."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(place)).where(F.col("_n") == 1).drop("_n")


def extract_concepts(evidence: DataFrame) -> DataFrame:
    """One row per distinct concept and scope, taken from its first line."""
    found = (
        evidence.select("scope", "rank", "chunk_id", "text", F.posexplode(lines("text")).alias("line_no", "line"))
        .where(is_concept_line("line"))
        .withColumn("concept", strip("line"))
        .select(
            "scope",
            "rank",
            "line_no",
            "chunk_id",
            "concept",
            normalize("concept").alias("norm"),
            strip(
                window_around("text", first_index("text", "concept"), F.length("concept"), CONTEXT_WIDTH)
            ).alias("factual_focus"),
        )
    )
    count = word_count("concept")
    return first_of(found, ["scope", "norm"], ORDER).withColumn(
        "extraction_reason",
        F.format_string(
            "a line of its own in title form, %d word%s long",
            count,
            F.when(count == 1, "").otherwise("s"),
        ),
    )


def _leading_repair(stripped_lines, concept):
    """The concept with the one adjacent single capital in front; null if none or two fit."""

    def repaired(at):
        above, below = F.get(stripped_lines, at - 2), F.get(stripped_lines, at)
        fits_above = F.coalesce((at > 1) & above.rlike(r"\A\p{Lu}\z"), F.lit(False))
        fits_below = F.coalesce((at > 0) & below.rlike(r"\A\p{Lu}\z"), F.lit(False))
        return F.when(fits_above & ~fits_below, F.concat(above, concept)).when(
            fits_below & ~fits_above, F.concat(below, concept)
        )

    return bind(F.array_position(stripped_lines, concept).cast("int"), repaired)


_REPAIRED = T.ArrayType(
    T.StructType()
    .add("concept", T.StringType())
    .add("at", T.ArrayType(T.IntegerType()))
    .add("kept", T.BooleanType())
    .add("repaired", T.BooleanType())
)


def _repair_chunk(stripped: list[str], loose: list[bool], concepts: list[str]) -> list[tuple]:
    """Join concepts with the word ends that stand on the lines next to them.

    ``loose`` marks the lines that can only be word ends.  A line looked at for one
    concept is spent for the following ones, whether or not the repair worked.
    """
    spent: set[int] = set()
    results = []
    for concept in concepts:
        if concept not in stripped:
            results.append((concept, [], True, False))
            continue
        at = stripped.index(concept)

        def free(i: int) -> bool:
            return loose[i] and i not in spent

        above = list(takewhile(free, range(at - 1, max(at - 1 - MAX_FRAGMENTS, -1), -1)))
        below = list(takewhile(free, range(at + 1, min(at + 1 + MAX_FRAGMENTS, len(stripped)))))
        spent.update(above, below)
        if not above and not below:
            results.append((concept, [], True, False))
            continue
        joined = (concept + "".join(stripped[i] for i in above or below)).rstrip(".").strip()
        sound = not (above and below) and joined != "" and joined.count("(") == joined.count(")")
        results.append((joined, sorted([at, *above, *below]), sound, sound))
    return results


@F.pandas_udf(_REPAIRED)
def _trailing_repair(stripped: pd.Series, loose: pd.Series, concepts: pd.Series) -> pd.Series:
    names = ("concept", "at", "kept", "repaired")
    return pd.Series(
        [
            [dict(zip(names, found)) for found in _repair_chunk(list(s), list(f), list(c))]
            for s, f, c in zip(stripped, loose, concepts)
        ]
    )


def refine_concepts(evidence: DataFrame, naming_cues=NAMING_CUES) -> DataFrame:
    """Drop restated names, mend broken ones, drop what cannot be mended.

    Works on one row per chunk.  The only Python step is the one that has to know
    which lines earlier concepts of the same chunk have used up.
    """
    concept = F.struct("line_no", "concept", "factual_focus", "extraction_reason")
    grouped = extract_concepts(evidence).groupBy("scope", "rank", "chunk_id").agg(
        F.sort_array(F.collect_list(concept)).alias("found")
    )
    texts = evidence.select("scope", "rank", "chunk_id", "text")
    chunk = grouped.join(texts, ["scope", "rank", "chunk_id"]).withColumn(
        "stripped", F.transform(lines("text"), strip)
    )

    def mend(item):
        cut = starts_lower(item["concept"])
        name = F.when(cut, _leading_repair(F.col("stripped"), item["concept"])).otherwise(item["concept"])
        note = F.when(cut, F.lit(" (leading character restored from an adjacent line)")).otherwise("")
        return F.struct(
            item["line_no"].alias("line_no"),
            F.when(~cue_before("text", item["concept"], naming_cues, NAMING_WINDOW), name).alias("concept"),
            item["factual_focus"].alias("factual_focus"),
            F.concat(item["extraction_reason"], note).alias("extraction_reason"),
        )

    mended = chunk.select(
        "scope",
        "rank",
        "chunk_id",
        "stripped",
        F.transform("stripped", is_continuation).alias("loose"),
        F.filter(F.transform("found", mend), lambda item: item["concept"].isNotNull()).alias("found"),
    ).where(F.size("found") > 0)
    repaired = mended.withColumn("fixed", _trailing_repair("stripped", "loose", F.col("found.concept")))
    rows = repaired.select(
        "scope", "rank", "chunk_id", F.explode(F.arrays_zip("found", "fixed")).alias("both")
    ).where("both.fixed.kept")
    note = F.when(F.col("both.fixed.repaired"), " (word end restored from adjacent lines)").otherwise("")
    named = rows.select(
        "scope",
        "rank",
        F.col("both.found.line_no").alias("line_no"),
        "chunk_id",
        F.col("both.fixed.concept").alias("concept"),
        F.col("both.found.factual_focus").alias("factual_focus"),
        F.concat("both.found.extraction_reason", note).alias("extraction_reason"),
        F.col("both.fixed.at").alias("source_lines"),
    )
    return first_of(named.withColumn("norm", normalize("concept")), ["scope", "norm"], ORDER)
