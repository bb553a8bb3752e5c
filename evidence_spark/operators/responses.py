"""Responses of the external model: parsing, contract checks, ingestion.

A response that is not JSON is MALFORMED and may be asked for again; one that is
JSON but breaks its contract is DOMAIN_INVALID and is not repaired.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from evidence_spark.functions.checks import (
    accepted,
    assessments_complete,
    first_failure,
    folded,
    grounding_passed,
    normal_forms,
    refs_in_range,
    resolve_refs,
)
from evidence_spark.functions.rules import (
    DIFFICULTIES,
    DISTRACTOR_ARCHETYPES,
    TEXTBOOK_STATUSES,
    answer_number,
    failed_rules,
    filled,
    four_answers,
    one_of,
    positive,
    unit_interval,
)
from evidence_spark.functions.text import bind, unrolled

QUESTION = """
blueprint struct<knowledge_target:string, tested_relationship:string, question_style:string,
  intended_difficulty:string, correct_answer_role:string,
  distractors:array<struct<archetype:string, plausibility_reason:string, incorrectness_reason:string,
    evidence_checked:boolean>>>,
question string, answers array<string>, correct_answer int, evidence_refs array<int>, historical_reference_id long
"""
PLAN = "targets array<struct<topic:string, factual_focus:string, evidence_refs:array<int>>>"
GROUNDING = """
grounded boolean,
answer_assessments array<struct<answer_index:int, supported_as_correct:boolean, evidence_refs:array<int>, reason:string>>,
evidence_text string, reason string, confidence double
"""
# The fields of each kind of plain verdict, all of them required.
VERDICTS = {
    "structure": "valid boolean, exactly_four_answers boolean, single_best_answer boolean, reason string",
    "category": "valid boolean, requested_category string, assessed_category string, reason string",
    "quality": "valid boolean, reason string",
}
#: Fields that may be null; every other field is absent or has its type.
NULLABLE = ("historical_reference_id", "evidence_text", "assessed_category")
TEXTBOOK = "status string, evidence_refs array<int>, reason string"
# Where the reader of texts notes a response that it cannot read as it stands.
_UNREAD = "_unread"


_NUMBER = r"(?:BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))"
_PLAIN = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "bigint": "BIGINT", "double": _NUMBER}


def _shape(kind: DataType) -> str:
    """Pattern of the schemas that a contract admits, for the schema of a parsed response.

    Fields come sorted and may be absent; one that is null, of another type or unknown does not match, at any level.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        held = {f.name: _shape(f.dataType) for f in fields}
        held |= {name: f"(?:{held[name]}|VOID)" for name in NULLABLE if name in held}
        return "OBJECT<" + "".join(f"(?:{name}: {inner}(?:, |(?=>)))?" for name, inner in held.items()) + ">"
    if isinstance(kind, ArrayType):
        return f"ARRAY<(?:{_shape(kind.elementType)}|VOID)>"
    return _PLAIN[kind.simpleString()]


def _typed(parsed: Column, schema: str) -> Column:
    return F.coalesce(F.schema_of_variant(parsed).rlike(f"^{_shape(StructType.fromDDL(schema))}$"), F.lit(False))


def _known(parsed: Column, schema: str) -> Column:
    """No field at the top that the contract lacks; false for what is no object."""
    allowed = F.array(*map(F.lit, StructType.fromDDL(schema).fieldNames()))
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.coalesce(F.size(F.array_except(keys, allowed)) == 0, F.lit(False))


def _read(parsed: Column, schema: str) -> Column:
    return F.try_variant_get(parsed, "$", f"struct<{schema}>")


def _parsed(responses: DataFrame, raw: str, schema: str, out: str) -> DataFrame:
    """``responses`` with ``_v`` (the parsed value), ``_t`` (whether its schema matches) and ``out`` (the fields).

    Reading fields out of the parsed value builds an expression for each of them, in every row.  A response whose schema matches
    has nothing to convert, so its fields are read from the text; the parsed value gives those of any other, and of one with a
    number that its type cannot hold.
    """
    wide = f"{schema}, {_UNREAD} string"
    held = responses.withColumn("_v", F.try_parse_json(raw)).withColumn("_t", _typed(F.col("_v"), schema))
    held = held.withColumn("_j", F.when(F.col("_t"), F.from_json(raw, wide, {"columnNameOfCorruptRecord": _UNREAD})))
    whole = F.col("_j").isNotNull() & F.col(f"_j.{_UNREAD}").isNull()
    return held.withColumn(out, F.when(whole, F.col("_j")).otherwise(_read(F.col("_v"), wide))).drop("_j")


def _errors(rules: dict[str, Column]) -> Column:
    """What is wrong with a response, by its ``_v``.

    A lambda, even one that is seldom called, keeps Spark from fusing the rules with the steps around them: the method that
    it makes of many steps grows beyond what Java compiles.
    """
    lost = F.col("_v").isNull() & ~bind(F.col("_t"), lambda t: t)  # no schema matches a response that is lost
    return F.when(lost, F.array(F.lit("not JSON"))).otherwise(failed_rules(rules))


def _contract(parsed: Column, typed: Column, schema: str) -> dict[str, Column]:
    """``typed`` is whether the schema matches, which no object with an unknown field does: keys are looked at where it does not."""
    known = typed | _known(parsed, schema)
    return {"unknown field": known, "nested field unknown or of another type": typed | ~known}


def _status(parsed: Column, errors: Column) -> Column:
    return F.when(parsed.isNull(), "MALFORMED").when(F.size(errors) > 0, "DOMAIN_INVALID").otherwise("OK")


def judged(responses: DataFrame, schema: str, rules: dict[str, Column]) -> DataFrame:
    """``responses`` with ``r`` (the response by its contract), ``status`` and ``errors``; ``rules`` speak of ``r``.

    The schema of the parsed value is held against the contract.  Every column is a projection of its own that later ones refer to.
    """
    held = _parsed(responses, "raw", schema, "r")
    held = held.withColumn("errors", _errors({**_contract(F.col("_v"), F.col("_t"), schema), **rules}))
    return held.withColumn("status", _status(F.col("_v"), F.col("errors"))).drop("_v", "_t")


def _blueprint_rules(b: Column) -> dict[str, Column]:
    texts = ("knowledge_target", "tested_relationship", "question_style", "correct_answer_role")
    designs = b["distractors"]

    def complete(d: Column) -> Column:
        return (
            one_of(d["archetype"], DISTRACTOR_ARCHETYPES)
            & filled(d["plausibility_reason"])
            & filled(d["incorrectness_reason"])
            & d["evidence_checked"].isNotNull()
        )

    sound = unrolled(designs, 3, lambda three: reduce(and_, map(complete, three)), F.forall(designs, complete))
    return {
        **{f"blueprint {t} must not be blank": filled(b[t]) for t in texts},
        "blueprint difficulty unknown": one_of(b["intended_difficulty"], DIFFICULTIES),
        "blueprint needs exactly three distractors": F.coalesce(F.size(designs) == 3, F.lit(False)),
        "blueprint distractor incomplete": F.coalesce(sound, F.lit(False)),
    }


def ingest_questions(responses: DataFrame) -> DataFrame:
    """Candidates from generation responses.

    ``responses`` has ``raw`` and its context: category, generation_mode, chunk_ids,
    supplied_reference and the target's topic, named_entity, source_role and
    source_entity.  Each row ends as a candidate or with a failure type and message.
    """
    r = F.col("r")
    found = judged(
        responses,
        QUESTION,
        {
            **_blueprint_rules(r["blueprint"]),
            "question must not be blank": filled(r["question"]),
            "four filled answers are needed": four_answers(r["answers"]),
            "correct answer must be 1 to 4": answer_number(r["correct_answer"]),
            "style reference id must be positive": r["historical_reference_id"].isNull()
            | positive(r["historical_reference_id"]),
        },
    )
    target = {c: F.col(c) for c in ("topic", "named_entity", "source_role", "source_entity")}
    refs = F.coalesce(r["evidence_refs"], F.array().cast("array<int>"))
    good = F.col("status") == "OK"
    found = found.withColumn("_n", F.when(good, normal_forms(r["answers"], target)))
    check = first_failure(
        refs,
        F.size("chunk_ids"),
        F.col("generation_mode"),
        r["historical_reference_id"],
        F.col("supplied_reference"),
        r["answers"],
        r["correct_answer"],
        target,
        F.col("_n"),
    )
    found = found.withColumn("check", F.when(good, check))
    good = good & F.col("check").isNull()
    return found.select(
        *[c for c in responses.columns if c != "raw"],
        F.when(
            good,
            F.struct(
                r["question"].alias("question"),
                r["answers"].alias("answers"),
                r["correct_answer"].alias("correct_answer"),
                F.col("category").alias("category"),
                F.col("generation_mode").alias("generation_mode"),
            ),
        ).alias("candidate"),
        F.when(good, resolve_refs(refs, "chunk_ids")).alias("evidence_chunk_ids"),
        F.when(F.col("status") != "OK", F.col("status")).when(~good, "INVALID_OUTPUT").alias("failure_type"),
        F.when(F.col("status") != "OK", F.array_join("errors", "; ")).otherwise(F.col("check")).alias("failure_message"),
    )


def _judged_plans(responses: DataFrame) -> DataFrame:
    sound = F.forall(
        "r.targets",
        lambda t: filled(t["topic"])
        & filled(t["factual_focus"])
        & refs_in_range(F.coalesce(t["evidence_refs"], F.array().cast("array<int>")), F.size("chunk_ids")),
    )
    return judged(responses, PLAN, {"targets missing or unsound": F.coalesce(sound, F.lit(False))})


def plan_statuses(responses: DataFrame) -> DataFrame:
    """One row per planning response, discarded ones too: scope, category, count, status, errors, targets kept."""
    kept = F.when(F.col("status") == "OK", F.least(F.size("r.targets"), F.col("count"))).otherwise(0)
    return _judged_plans(responses).select("scope", "category", "count", "status", "errors", kept.alias("targets"))


def ingest_plans(responses: DataFrame) -> DataFrame:
    """Targets from planning responses (scope, category, count, chunk_ids, raw).

    One bad reference discards all targets of its response; then at most ``count``
    are kept.  ``plan_statuses`` tells of the responses that leave no target.
    """
    return (
        _judged_plans(responses)
        .where("status = 'OK'")
        .select(
            "scope", "category", "chunk_ids", F.posexplode(F.slice("r.targets", F.lit(1), F.col("count"))).alias("i", "t")
        )
        .select(
            "scope",
            "category",
            (F.col("i") + 1).alias("target_id"),
            F.col("t.topic").alias("topic"),
            F.col("t.factual_focus").alias("factual_focus"),
            resolve_refs(F.coalesce("t.evidence_refs", F.array().cast("array<int>")), "chunk_ids").alias("own_chunks"),
        )
    )


def ingest_grounding(responses: DataFrame) -> DataFrame:
    """Grounding verdicts (raw, chunk_ids, correct_answer and keys)."""
    r = F.col("r")
    given = r["answer_assessments"]
    refs = F.flatten(F.transform(given, lambda a: F.coalesce(a["evidence_refs"], F.array().cast("array<int>"))))
    size = F.size("chunk_ids")

    def complete(a: Column) -> Column:
        return a["supported_as_correct"].isNotNull() & filled(a["reason"])

    def in_range(four: list[Column]) -> Column:
        return reduce(and_, [a["evidence_refs"].isNull() | refs_in_range(a["evidence_refs"], size) for a in four])

    rules = {
        "grounded missing": r["grounded"].isNotNull(),
        "each answer needs exactly one assessment": F.coalesce(assessments_complete(given), F.lit(False)),
        "assessment incomplete": F.coalesce(
            unrolled(given, 4, lambda four: reduce(and_, map(complete, four)), F.forall(given, complete)), F.lit(False)
        ),
        "evidence reference out of range": F.coalesce(unrolled(given, 4, in_range, refs_in_range(refs, size)), F.lit(False)),
        "reason must not be blank": filled(r["reason"]),
        "confidence must be 0 to 1": unit_interval(r["confidence"]),
    }
    told = {name: F.when(F.col("status") == "OK", c) for name, c in folded(given, "correct_answer", "chunk_ids").items()}
    return (
        judged(responses, GROUNDING, rules)
        .withColumns({f"_{name}": c for name, c in told.items()})
        .select(
            *[c for c in responses.columns if c not in ("raw", "chunk_ids")],
            "status",
            "errors",
            *[F.col(f"_{name}").alias(name) for name in told],
            grounding_passed(
                r["grounded"], "_correct_answer_supported", "_other_answers_not_equally_correct"
            ).alias("grounding_passed"),
        )
    )


def ingest_textbook(responses: DataFrame) -> DataFrame:
    """Secondary verdicts (raw, chunk_ids, pages); references are resolved as given, repeats included."""
    r = F.col("r")
    refs = F.coalesce(r["evidence_refs"], F.array().cast("array<int>"))
    found = judged(
        responses,
        TEXTBOOK,
        {
            "status unknown": one_of(r["status"], TEXTBOOK_STATUSES),
            "evidence reference out of range": F.coalesce(refs_in_range(refs, F.size("chunk_ids")), F.lit(False)),
            "reason must not be blank": filled(r["reason"]),
        },
    )
    good = F.col("status") == "OK"
    return found.select(
        *[c for c in responses.columns if c not in ("raw", "chunk_ids", "pages")],
        "status",
        "errors",
        F.when(good, r["status"]).alias("textbook_status"),
        F.when(good, resolve_refs(refs, "chunk_ids", distinct=False)).alias("evidence_chunk_ids"),
        F.when(good, F.get("pages", F.get(refs, F.lit(0)) - 1)).alias("source_page"),
    )


def _verdict_rules(r: Column, schema: str) -> dict[str, Column]:
    fields = StructType.fromDDL(schema)
    flags = [f.name for f in fields if f.dataType.simpleString() == "boolean"]
    texts = [f.name for f in fields if f.dataType.simpleString() == "string"]
    blank = {f: filled(r[f]) | (r[f].isNull() if f in NULLABLE else F.lit(False)) for f in texts}
    return {f"{f} missing": r[f].isNotNull() for f in flags} | {f"{f} must not be blank": rule for f, rule in blank.items()}


def ingest_verdicts(responses: DataFrame) -> DataFrame:
    """Plain verdicts (raw and keys) by the contract of their ``check``: structure, category or quality.

    Without a column ``check`` all are quality verdicts.  ``valid`` is null unless the status is OK.  A response is parsed once,
    with the fields of all contracts; that of its check decides.
    """
    kind = F.col("check") if "check" in responses.columns else F.lit("quality")
    fields = {f.split()[0]: f for schema in VERDICTS.values() for f in schema.split(", ")}
    held = responses.withColumn("_v", F.try_parse_json("raw"))
    held = held.withColumn("_r", _read(F.col("_v"), ", ".join(fields.values())))
    broken = F.array(F.lit("unknown check"))
    for name, schema in VERDICTS.items():
        its_own = failed_rules({**_contract(F.col("_v"), _typed(F.col("_v"), schema), schema), **_verdict_rules(F.col("_r"), schema)})
        broken = F.when(kind == name, its_own).otherwise(broken)
    held = held.withColumn("errors", F.when(F.col("_v").isNull(), F.array(F.lit("not JSON"))).otherwise(broken))
    held = held.withColumn("status", _status(F.col("_v"), F.col("errors")))
    valid = F.when(F.col("status") == "OK", F.col("_r.valid"))
    return held.select(*[c for c in responses.columns if c != "raw"], valid.alias("valid"), "status", "errors")


def ingest_verdict_columns(responses: DataFrame, raw: dict[str, str]) -> DataFrame:
    """The verdicts of several checks that stand beside each other: ``raw`` names the response column of each check.

    Each response column gives way to a struct (valid, status, errors) named by its check.  Nothing is exploded or grouped.
    """
    held = responses
    for name, column in raw.items():
        schema = VERDICTS[name]
        held = _parsed(held, column, schema, "_r")
        held = held.withColumn("_e", _errors({**_contract(F.col("_v"), F.col("_t"), schema), **_verdict_rules(F.col("_r"), schema)}))
        status = _status(F.col("_v"), F.col("_e"))
        verdict = F.struct(F.when(status == "OK", F.col("_r.valid")).alias("valid"), status.alias("status"), F.col("_e").alias("errors"))
        held = held.withColumn(name, verdict).drop("_v", "_r", "_t", "_e", column)
    return held


def wide_verdicts(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Long verdicts (key, check, valid) as one row per attempt with a column per check."""
    return verdicts.groupBy(*key).agg(*[F.bool_and(F.when(F.col("check") == check, F.col("valid"))).alias(check) for check in VERDICTS])


def assemble_attempts(
    candidates: DataFrame, grounding: DataFrame, verdicts: DataFrame, textbook: DataFrame, key: list[str]
) -> DataFrame:
    """Attempt log from ingested candidates and their five verdicts.

    ``verdicts`` is long (key, check, valid), or has a column (or struct with ``valid``) per check; a failed generation has
    no verdicts and is not accepted.
    """
    wide = wide_verdicts(verdicts, key) if "check" in verdicts.columns else verdicts
    names = (("structure", "mcq_valid"), ("category", "category_valid"), ("quality", "quality_valid"))
    valid = [F.col(f"{c}.valid" if isinstance(wide.schema[c].dataType, StructType) else c).alias(name) for c, name in names]
    # whether there is a candidate is read off before the joins: its texts do not travel where only the verdict is wanted
    made = candidates.withColumn("_made", F.col("candidate").isNotNull())
    return (
        made.join(grounding.select(*key, "grounding_passed"), key, "left")
        .join(wide.select(*key, *valid), key, "left")
        .join(textbook.select(*key, "textbook_status"), key, "left")
        .withColumn(
            "accepted",
            F.col("_made") & accepted("grounding_passed", "mcq_valid", "category_valid", "quality_valid", "textbook_status"),
        )
        .drop("_made")
    )
