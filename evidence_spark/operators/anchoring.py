"""Context around a concept's own line, bounded by its neighbours.

Every walk looks at a constant number of lines, so the work per concept is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.functions.concepts import ENUMERATION_CUES, is_concept_line
from evidence_spark.functions.text import bind, contains_any, count_matches, lines, normalize, strip

# (lines taken, raw lines looked at) in each direction.
NARROW = (3, 12)
BROAD = (6, 24)
MAX_BLANKS = 2
ENTITY_LINES = 6
MIN_OWN_LETTERS = 2

_WALK = "struct<blanks:int,stop:boolean,taken:array<string>>"
_FOUND = "struct<at:int,used:int>"


def with_lines(evidence: DataFrame) -> DataFrame:
    """Add what the walks need, once per chunk: ``raw`` lines, ``bare`` ones and ``named`` flags."""
    return (
        evidence.withColumn("raw", lines("text"))
        .withColumn("bare", F.transform("raw", strip))
        .withColumn("named", F.transform("bare", is_concept_line))
    )


def walk(start: Column, step: int, used: Column, bounds: tuple[int, int]) -> Column:
    """Lines met when leaving ``start`` (zero-based), in the order they are met.

    Ends at another concept's line, at two blank lines in a row or at the bounds;
    the ``used`` line is passed over.
    """
    taken_max, looked_max = bounds
    size = F.size("raw")
    reach = F.greatest(F.lit(0), F.least(F.lit(looked_max), size - 1 - start if step > 0 else start))
    places = F.when(
        reach > 0, F.sequence(start + step, start + F.lit(step) * reach, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))

    def visit(state: Column, i: Column) -> Column:
        blank = F.get("bare", i) == ""
        stop = F.when(blank, state["blanks"] + 1 >= MAX_BLANKS).otherwise(F.get("named", i))
        after = F.struct(
            F.when(blank, state["blanks"] + 1).otherwise(0).alias("blanks"),
            stop.alias("stop"),
            F.when(blank | stop, state["taken"])
            .otherwise(F.array_append(state["taken"], F.get("raw", i)))
            .alias("taken"),
        ).cast(_WALK)
        idle = state["stop"] | (F.size(state["taken"]) >= taken_max) | F.coalesce(i == used, F.lit(False))
        return F.when(idle, state).otherwise(after)

    empty = F.struct(F.lit(0), F.lit(False), F.array()).cast(_WALK)
    return F.aggregate(places, empty, visit, lambda state: state["taken"])


def find_line(concept: Column) -> Column:
    """Struct of the concept's line (zero-based) and of the line its first letters came from."""

    def suffix(drop: int) -> Column:
        rest, head = F.substring(concept, F.lit(drop + 1), F.length(concept)), F.substring(concept, 1, drop)
        return F.when(
            F.length(concept) > drop,
            bind(
                F.array_position("bare", rest).cast("int") - 1,
                lambda at: F.when(
                    at >= 0,
                    F.struct(
                        at.alias("at"),
                        F.when((at > 0) & (F.get("bare", at - 1) == head), at - 1)
                        .when(F.get("bare", at + 1) == head, at + 1)
                        .alias("used"),
                    ).cast(_FOUND),
                ),
            ),
        )

    exact = F.array_position("bare", concept).cast("int") - 1
    whole = F.when(exact >= 0, F.struct(exact.alias("at"), F.lit(None).cast("int").alias("used")).cast(_FOUND))
    return F.coalesce(whole, suffix(1), suffix(2))


def anchor(concept: Column, source_lines: Column, bounds: tuple[int, int]) -> Column:
    """The concept between its bounded context lines; the concept alone if its line is unknown."""

    def around(first: Column, last: Column, used: Column) -> Column:
        parts = F.concat(
            F.reverse(walk(first, -1, used, bounds)), F.array(concept), walk(last, 1, used, bounds)
        )
        return strip(F.array_join(parts, "\n"))

    known = F.size(source_lines) > 0
    span = F.when(known, around(F.array_min(source_lines), F.array_max(source_lines), F.lit(None).cast("int")))
    own = bind(find_line(concept), lambda f: F.when(f.isNull(), concept).otherwise(around(f["at"], f["at"], f["used"])))
    return F.coalesce(span, own)


def is_sufficient(focus: Column, concept: Column) -> Column:
    """There is something beyond the concept's own name."""
    return normalize(focus) != normalize(concept)


def split_focus(focus: Column, concept: Column) -> Column:
    """Struct of the text before and after the last line that equals the concept."""
    parts = F.split(focus, "\n", -1)
    return bind(
        F.array_position(F.reverse(parts), concept).cast("int"),
        lambda back: F.when(back == 0, F.struct(focus.alias("before"), F.lit("").alias("after"))).otherwise(
            F.struct(
                F.array_join(F.slice(parts, F.lit(1), F.size(parts) - back), "\n").alias("before"),
                F.array_join(F.slice(parts, F.size(parts) - back + 2, back - 1), "\n").alias("after"),
            )
        ),
    )


def in_enumeration(focus: Column, concept: Column, cues=ENUMERATION_CUES) -> Column:
    """The context in front introduces a list."""
    return contains_any(split_focus(focus, concept)["before"], cues)


def only_enumerated(focus: Column, concept: Column, cues=ENUMERATION_CUES) -> Column:
    """The context introduces a list and then says nothing about this member."""
    return bind(
        split_focus(focus, concept),
        lambda part: contains_any(part["before"], cues) & (count_matches(part["after"], r"\p{L}") < MIN_OWN_LETTERS),
    )


def entity_above(concept: Column) -> Column:
    """The nearest concept line within a few lines above the concept's own line."""

    def nearest(at: Column) -> Column:
        reach = F.least(at, F.lit(ENTITY_LINES))
        places = F.when(reach > 0, F.sequence(at - 1, at - reach, F.lit(-1)))
        return F.get("bare", F.get(F.filter(places, lambda i: F.get("named", i)), F.lit(0)))

    return bind(F.array_position("bare", concept).cast("int") - 1, lambda at: F.when(at > 0, nearest(at)))
