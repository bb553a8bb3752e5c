"""Prompt sections and rendering, as column expressions.

Section wording and templates are parameters; the defaults below are this
package's own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from evidence_spark.functions.checks import NON_ASCII
from evidence_spark.functions.text import Text, col, strip

_FIELD = re.compile(r"\{([a-z_]+)\}")


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"=== {title} ===\n"), body, F.lit(f"\n=== end of {title} ==="))


def answer_block(answers: Text) -> Column:
    return F.array_join(
        F.transform(col(answers), lambda a, i: F.concat(F.lit("Answer "), i + 1, F.lit(": "), a)), "\n"
    )


def evidence_block(chunks: Text, title: str = "evidence", empty: str | None = None) -> Column:
    """Numbered evidence (source_file, page, chunk_id, text) in the given order.

    Without chunks the block says so if ``empty`` is given; else it is null, which
    makes the row an error row.
    """
    items = F.transform(
        col(chunks),
        lambda c, i: F.concat(
            F.lit("[Evidence "),
            i + 1,
            F.lit("]\nSource: "),
            c["source_file"],
            F.lit("\nPage: "),
            c["page"],
            F.lit("\nChunk: "),
            c["chunk_id"],
            F.lit("\nText:\n"),
            c["text"],
        ),
    )
    nothing = F.coalesce(F.size(col(chunks)), F.lit(0)) <= 0
    without = F.lit(None).cast("string") if empty is None else F.lit(empty)
    return section(title, F.when(nothing, without).otherwise(F.array_join(items, "\n\n")))


def reference_block(reference: Text) -> Column:
    r = col(reference)
    body = F.concat(
        F.lit("A model for style only, not a source of facts.\nReference: "),
        r["historical_question_id"].cast("string"),
        F.lit("\nCategory: "),
        r["category"],
        F.lit("\nQuestion: "),
        r["question"],
        F.lit("\n"),
        answer_block(r["answers"]),
        F.lit("\nCorrect answer: "),
        r["correct_answer"].cast("string"),
    )
    return section("style reference", F.when(r.isNull(), "No style reference is given.").otherwise(body))


def target_block(topic: Text, focus: Text) -> Column:
    return section("question target", F.concat(F.lit("Topic: "), col(topic), F.lit("\nFocus: "), col(focus)))


def competitor_block(competitors: Text) -> Column:
    items = F.transform(
        col(competitors),
        lambda c, i: F.concat(
            F.lit("[Competitor "), i + 1, F.lit("] ("), c["relationship"], F.lit(") "), c["snippet"]
        ),
    )
    nothing = F.coalesce(F.size(col(competitors)), F.lit(0)) <= 0
    return section("competing passages", F.when(nothing, "None were found.").otherwise(F.array_join(items, "\n")))


def coverage_block(concepts: Text, relationships: Text) -> Column:
    def listed(title: str, values: Column) -> Column:
        rows = F.transform(values, lambda v: F.concat(F.lit("- "), v))
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(rows, "\n")))

    body = F.concat_ws(
        "\n", listed("Answers used so far", col(concepts)), listed("Relationships used so far", col(relationships))
    )
    return section("covered so far", F.when(body == "", "Nothing has been asked yet.").otherwise(body))


def candidate_block(question: Text, answers: Text, correct: Text, category: Text, mode: Text | None = None) -> Column:
    parts = [
        F.concat(F.lit("Question: "), col(question)),
        answer_block(answers),
        F.concat(F.lit("Intended correct answer: "), col(correct).cast("string")),
        F.concat(F.lit("Category: "), col(category)),
    ]
    if mode is not None:
        parts.append(F.concat(F.lit("Mode: "), col(mode)))
    return F.concat_ws("\n", *parts)


# What a target's flags ask of its question.  {topic} and {entity} are filled in.
REQUIREMENTS = {
    "identity": "The correct answer has to be {topic} itself, not a description of it.",
    "no identity": "The correct answer may be any fact the evidence supports.",
    "english": "Write {topic} exactly so wherever it is named, in the question and in the answers.",
    "other script": "Name the target as the evidence does; do not invent a translation.",
    "no language": "There is no rule for the language of the target.",
    "source of": "The evidence gives {topic} as the source of {entity}; ask for {topic}, never for {entity}.",
    "source": "The evidence gives {topic} as the source of something else; ask for {topic}.",
    "no role": "The target is what its evidence is about.",
    "member": "{topic} is one member of a list; ask for what sets it apart from the others.",
    "no member": "The target is not known to be a member of a list.",
    "identity first": "Prefer a question that is answered by the name {topic} to one about a property.",
    "no strategy": "Ask whatever the evidence supports best.",
}


def fill(template: str, values: dict[str, Column]) -> Column:
    """Put columns into a template.

    The template is taken apart once, here; inserted text is never looked at again,
    so it may hold braces.  Names must match exactly.
    """
    parts = _FIELD.split(template)
    wanted, given = set(parts[1::2]), set(values)
    if wanted != given:
        raise ValueError(f"missing {sorted(wanted - given)}, unexpected {sorted(given - wanted)}")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def requirement_texts(texts: dict[str, str] = REQUIREMENTS) -> list[Column]:
    """The five requirement columns, chosen by the flags of a target row."""
    fields = {"topic": F.col("topic"), "entity": F.coalesce("source_entity", F.lit(""))}

    def say(name: str) -> Column:
        used = {f: fields[f] for f in _FIELD.findall(texts[name])}
        return fill(texts[name], used)

    named = F.col("named_entity")
    ascii_topic = (strip("topic") != "") & ~F.col("topic").rlike(NON_ASCII)
    source = F.col("source_role")
    return [
        F.when(named, say("identity")).otherwise(say("no identity")).alias("identity_rule"),
        F.when(~named, say("no language"))
        .when(ascii_topic, say("english"))
        .otherwise(say("other script"))
        .alias("language_rule"),
        F.when(source & F.col("source_entity").isNotNull(), say("source of"))
        .when(source, say("source"))
        .otherwise(say("no role"))
        .alias("role_rule"),
        F.when(F.col("enumeration_member"), say("member")).otherwise(say("no member")).alias("enumeration_rule"),
        F.when(F.col("strategy") == "IDENTITY_FIRST", say("identity first"))
        .otherwise(say("no strategy"))
        .alias("strategy_rule"),
    ]


def template_version(content: Text) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def messages(system: str, task: Column) -> Column:
    """System and user message, in this order."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), task.alias("content")),
    )
