"""Checks on a generated question, as column expressions.

Where texts are compared, the arguments are their normal forms, so that each text
is normalised once however many checks look at it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from evidence_spark.functions.text import Text, bind, col, normalize, normalize_column, strip, unrolled

# Fixed value: numbering repeated at the start of an answer.
LEADING_NUMBER = r"^\s*\d+\s*[.):]\s+"
MIN_NUMBERED = 2
NON_ASCII = r"[^\x00-\x7f]"


def refs_in_range(refs: Text, size: Column) -> Column:
    """All references are 1..size; one bad or null reference spoils the response, and so do null references."""
    refs = col(refs)
    inside = F.coalesce((F.array_min(refs) >= 1) & (F.array_max(refs) <= size), F.lit(False))
    # looking for what is not there is null if a reference is null
    return F.coalesce(~F.array_contains(refs, F.lit(0)) & ((F.size(refs) == 0) | inside), F.lit(False))


def resolve_refs(refs: Text, chunk_ids: Text, distinct: bool = True) -> Column:
    """Chunk ids of the references, in order; repeated ones once unless asked otherwise."""
    refs = F.array_distinct(col(refs)) if distinct else col(refs)
    return F.transform(refs, lambda r: F.get(col(chunk_ids), r - 1))


def reference_claim_holds(mode: Text, claimed: Text, supplied: Text) -> Column:
    """A style reference may be claimed only in the mode that has one, and only the one supplied."""
    claimed, supplied = col(claimed), col(supplied)
    return claimed.isNull() | ((col(mode) != "INDEPENDENT") & claimed.eqNullSafe(supplied))


def correct_text(answers: Text, correct: Text) -> Column:
    return F.get(col(answers), col(correct) - 1)


def wrong_texts(answers: Text, correct: Text) -> Column:
    return F.filter(col(answers), lambda _a, i: i != col(correct) - 1)


def names_target(answer: Column, topic: Column) -> Column:
    """The answer contains the topic; the other direction does not count."""
    return answer.contains(topic)


def role_holds(answer: Column, source_role: Text, entity: Column) -> Column:
    """A source target must not be answered with the entity it feeds."""
    return F.coalesce(~(col(source_role) & answer.contains(entity)), F.lit(True))


def distractors_distinct(answer: Column, wrong: Column) -> Column:
    """No wrong answer contains the right one or is contained in it."""
    return ~F.exists(wrong, lambda w: _overlap(w, answer))


def _overlap(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _answers_overlap(normal: Column, correct: Text) -> Column:
    right = correct_text(normal, correct)
    return unrolled(
        normal,
        4,
        lambda four: reduce(or_, [(F.lit(i) != col(correct) - 1) & _overlap(a, right) for i, a in enumerate(four)]),
        ~distractors_distinct(right, wrong_texts(normal, correct)),
    )


def language_holds(answers: Text, normal: Column, topic: Text, normal_topic: Column) -> Column:
    """An answer naming an ASCII topic must be ASCII throughout."""
    ascii_topic = (strip(topic) != "") & ~col(topic).rlike(NON_ASCII)
    mixed = unrolled(
        normal,
        4,
        lambda four: reduce(or_, [names_target(n, normal_topic) & F.get(col(answers), F.lit(i)).rlike(NON_ASCII) for i, n in enumerate(four)]),
        F.exists(
            F.arrays_zip(col(answers).alias("a"), normal.alias("n")),
            lambda x: names_target(x["n"], normal_topic) & x["a"].rlike(NON_ASCII),
        ),
    )
    return ~(ascii_topic & mixed)


def numbered_answers(answers: Text) -> Column:
    """Positions of answers that repeat a number, if there are enough of them to matter; else null."""
    hit = F.filter(
        F.transform(col(answers), lambda a, i: F.when(a.rlike(LEADING_NUMBER), i + 1)), lambda p: p.isNotNull()
    )
    return F.when(F.size(hit) >= MIN_NUMBERED, hit)


def normal_forms(answers: Text, target: dict) -> Column:
    """Struct of the normal forms that ``first_failure`` compares: answers, topic, entity."""
    four = unrolled(col(answers), 4, lambda a: F.array(*map(normalize_column, a)), F.transform(col(answers), normalize))
    return F.struct(
        four.alias("answers"),
        normalize_column(target["topic"]).alias("topic"),
        normalize_column(target["source_entity"]).alias("entity"),
    )


def first_failure(
    refs: Text,
    size: Column,
    mode: Text,
    claimed: Text,
    supplied: Text,
    answers: Text,
    correct: Text,
    target: dict,
    normal: Column | None = None,
) -> Column:
    """Name of the first check that fails, null if all hold.

    ``target`` maps topic, named_entity, source_role and source_entity to columns.  ``normal`` is a column that holds the
    ``normal_forms``; without one they are bound by a lambda, in which everything is interpreted.
    """
    named, topic = col(target["named_entity"]), target["topic"]

    def compared(n: Column) -> Column:
        right = correct_text(n["answers"], correct)
        return (
            F.when(~role_holds(right, target["source_role"], n["entity"]), "answer names the downstream entity")
            .when(named & _answers_overlap(n["answers"], correct), "answer and distractor overlap")
            .when(named & ~names_target(right, n["topic"]), "answer does not name the target")
            .when(named & ~language_holds(answers, n["answers"], topic, n["topic"]), "answer mixes languages")
        )

    return (
        F.when(~refs_in_range(refs, size), "evidence reference out of range")
        .when(~reference_claim_holds(mode, claimed, supplied), "style reference not supplied")
        .otherwise(bind(normal_forms(answers, target), compared) if normal is None else compared(normal))
    )


def assessments_complete(assessments: Text) -> Column:
    """Exactly one assessment for each of the four answers."""
    found = F.sort_array(col(assessments)["answer_index"].cast("array<int>"))
    return found == F.array(*[F.lit(i) for i in range(1, 5)])


def folded(assessments: Text, correct: Text, chunk_ids: Text) -> dict[str, Column]:
    """By name: is the right answer supported, is no other, and by which chunks."""
    correct = col(correct)
    supported = F.filter(F.array_sort(col(assessments)), lambda a: a["supported_as_correct"])
    indices = F.transform(supported, lambda a: a["answer_index"].cast("int"))
    refs = F.flatten(F.transform(supported, lambda a: a["evidence_refs"]))

    def named(four: list[Column]) -> list[tuple[Column, Column]]:
        return [(F.coalesce(a["supported_as_correct"], F.lit(False)), a["answer_index"].cast("int") == correct) for a in four]

    return {
        "correct_answer_supported": unrolled(
            col(assessments),
            4,
            lambda four: F.when(correct.isNotNull(), reduce(or_, [held & same for held, same in named(four)])),
            F.array_contains(indices, correct),
        ),
        "other_answers_not_equally_correct": unrolled(
            col(assessments),
            4,
            lambda four: reduce(and_, [~held | same for held, same in named(four)]),
            F.forall(indices, lambda i: i == correct),
        ),
        "evidence_chunk_ids": F.array_distinct(resolve_refs(refs, chunk_ids)),
    }


def fold_assessments(assessments: Text, correct: Text, chunk_ids: Text) -> Column:
    """The same as a struct."""
    return F.struct(*[c.alias(name) for name, c in folded(assessments, correct, chunk_ids).items()])


def grounding_passed(grounded: Text, supported: Text, no_other: Text) -> Column:
    """Confidence plays no part."""
    return col(grounded) & col(supported) & col(no_other)


def accepted(grounding: Text, mcq: Text, category: Text, quality: Text, textbook_status: Text) -> Column:
    """All four primary verdicts, and no conflict with the secondary material."""
    verdict = col(grounding) & col(mcq) & col(category) & col(quality)
    return F.coalesce(verdict & (col(textbook_status) != "POTENTIAL_CONFLICT"), F.lit(False))


def one_outcome(candidate: Text, validations: Text, failure_type: Text, failure_message: Text) -> Column:
    """A candidate with verdicts, or a failure with a message, never both or halves."""
    made = col(candidate).isNotNull()
    failed = col(failure_type).isNotNull()
    return (
        (made == col(validations).isNotNull()) & (failed == col(failure_message).isNotNull()) & (made != failed)
    )
