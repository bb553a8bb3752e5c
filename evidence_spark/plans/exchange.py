"""Registered queries over what goes to an external model and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.functions import prompts as blocks
from evidence_spark.operators import identity, metrics, prompts, responses
from evidence_spark.plans import attempts as log, concepts, corpus, tables as t
from evidence_spark.plans.concepts import FOUND, LEXICON, PART_LEXICON
from evidence_spark.plans.corpus import SEARCH
from evidence_spark.sources.tables import task_count

# Tasks that a core gets of what is judged, so that uneven ones even out.
TASKS_PER_CORE = 8
CHUNK_IDS = ["chunk a", "chunk b", "chunk c"]
PAGES = [10, 20, 30]


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt with its part and the context a response is judged in.

    Responses are dealt out by their key before they are made and judged: a call is a few bytes that take long to judge, so that tasks
    cut by bytes are few and uneven.  What is joined by that key later lies together already.
    """
    parts = t.read(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    lines = log.attempts(spark, sf).join(parts, "l_partkey")
    tasks = max(task_count(spark), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return lines.repartition(tasks, "position", "attempt_number").select(
        "*",
        F.array(*map(F.lit, CHUNK_IDS)).alias("chunk_ids"),
        F.array(*map(F.lit, PAGES)).alias("pages"),
        F.lit(7).cast("long").alias("supplied_reference"),
        F.col("p_name").alias("topic"),
        F.lit(True).alias("named_entity"),
        (F.col("p_size") > 25).alias("source_role"),
        F.col("p_brand").alias("source_entity"),
        (F.col("l_partkey") % 10).alias("kind"),
    )


def _question_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Well-formed responses and nine ways to get one wrong, by part number."""
    kind = F.col("kind")
    design = F.struct(
        F.lit("SIBLING_STRUCTURE").alias("archetype"),
        F.lit("close").alias("plausibility_reason"),
        F.lit("other").alias("incorrectness_reason"),
        F.lit(True).alias("evidence_checked"),
    )
    blueprint = F.struct(
        *[
            F.lit(name).alias(name)
            for name in ("knowledge_target", "tested_relationship", "question_style", "correct_answer_role")
        ],
        F.lit("EASY").alias("intended_difficulty"),
        F.array_repeat(design, F.when(kind == 8, 2).otherwise(3)).alias("distractors"),
    )
    right = (
        F.when(kind == 6, F.concat("p_name", F.lit(" é")))
        .when(kind == 9, F.concat("p_name", F.lit(" of "), "p_brand"))
        .otherwise(F.col("p_name"))
    )
    second = F.when(kind == 3, F.concat("p_name", F.lit(" big"))).otherwise(F.col("p_type"))
    body = F.to_json(
        F.struct(
            blueprint.alias("blueprint"),
            F.concat(F.lit("what is "), "p_type").alias("question"),
            F.array(right, second, F.lit("none"), F.concat(F.lit("size "), "p_size")).alias("answers"),
            F.when(kind == 2, 2).otherwise(1).alias("correct_answer"),
            F.when(kind == 1, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(1))).alias("evidence_refs"),
            F.when(kind == 7, 5).otherwise(F.when(F.col("generation_mode") == "STYLE_SIMILAR", 7)).alias("historical_reference_id"),
        )
    )
    calls, body = _calls(spark, sf).withColumn("_body", body), F.col("_body")  # a projection of its own: made once, whatever refers to it
    raw = F.when(kind == 4, F.substring(body, F.lit(1), F.length(body) - 2)).when(
        kind == 5, F.concat(F.lit('{"note":1,'), F.substring(body, F.lit(2), F.length(body)))
    )
    return calls.withColumn("raw", F.coalesce(raw, body)).drop("_body")


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    return responses.ingest_questions(_question_responses(spark, sf))


_FAILURE = """CASE WHEN kind = 4 THEN 'not JSON' WHEN kind = 5 THEN 'unknown field'
  WHEN kind = 8 THEN 'blueprint needs exactly three distractors' WHEN kind = 1 THEN 'evidence reference out of range'
  WHEN kind = 7 THEN 'style reference not supplied'
  WHEN kind = 9 AND p_size > 25 THEN 'answer names the downstream entity'
  WHEN kind = 3 OR contains(lower(p_name), lower(p_type)) THEN 'answer and distractor overlap'
  WHEN kind = 2 THEN 'answer does not name the target' WHEN kind = 6 THEN 'answer mixes languages' END"""
_CALLS = f"""{log._ATTEMPTS},
call_t AS (SELECT *, {_FAILURE} AS failure_message, CASE WHEN kind = 4 THEN 'MALFORMED' WHEN kind IN (5, 8) THEN 'DOMAIN_INVALID'
    WHEN {_FAILURE} IS NOT NULL THEN 'INVALID_OUTPUT' END AS failure_type
  FROM (SELECT *, l_partkey % 10 AS kind, l_partkey % 4 + 1 AS correct_answer
    FROM attempt_t JOIN part ON p_partkey = l_partkey))"""


def _grounding_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The intended answer supported if the attempt was grounded, its neighbour if its structure was bad."""
    calls = _calls(spark, sf).withColumn("correct_answer", (F.col("l_partkey") % 4 + 1).cast("int"))
    right = F.col("correct_answer")

    def assessment(i):
        supported = ((i == right) & F.col("grounding_passed")) | ((i == right % 4 + 1) & ~F.col("mcq_valid"))
        return F.struct(
            F.when(F.col("kind") == 1, F.greatest(i, F.lit(2))).otherwise(i).alias("answer_index"),
            supported.alias("supported_as_correct"),
            F.when(supported, F.array(F.when(F.col("kind") == 2, 4).otherwise(3), F.when(i == 1, 1).otherwise(2)))
            .otherwise(F.array().cast("array<int>"))
            .alias("evidence_refs"),
            F.lit("because").alias("reason"),
        )

    raw = F.to_json(
        F.struct(
            F.lit(True).alias("grounded"),
            F.transform(F.array(*[F.lit(i) for i in (3, 1, 4, 2)]), assessment).alias("answer_assessments"),
            F.lit("because").alias("reason"),
            F.lit(0.5).alias("confidence"),
        )
    )
    return calls.select("position", "attempt_number", "correct_answer", "chunk_ids", raw.alias("raw"))


def _grounding(spark: SparkSession, sf: str) -> DataFrame:
    return responses.ingest_grounding(_grounding_responses(spark, sf))


_GROUNDING = """
support_t AS (
  SELECT *, grounding_passed AS own, NOT mcq_valid AS other, correct_answer % 4 + 1 AS next,
    CASE WHEN kind = 1 THEN 'each answer needs exactly one assessment'
      WHEN kind = 2 AND (grounding_passed OR NOT mcq_valid) THEN 'evidence reference out of range' ELSE '' END AS errors
  FROM call_t),
fold_t AS (
  SELECT *, errors = '' AS good, list_concat(
    CASE WHEN own OR other THEN ['chunk c'] ELSE [] END,
    list_concat(CASE WHEN (own AND correct_answer = 1) OR (other AND next = 1) THEN ['chunk a'] ELSE [] END,
      CASE WHEN (own AND correct_answer <> 1) OR (other AND next <> 1) THEN ['chunk b'] ELSE [] END)) AS ids
  FROM support_t)
"""


def _textbook(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.to_json(
        F.struct(
            F.col("textbook_status").alias("status"),
            F.when(F.col("textbook_status") == "NOT_FOUND", F.array().cast("array<int>"))
            .otherwise(F.array(F.lit(2), F.lit(2), F.lit(1)))
            .alias("evidence_refs"),
            F.when(F.col("kind") == 0, " ").otherwise("because").alias("reason"),
        )
    )
    calls = _calls(spark, sf).select("position", "attempt_number", "chunk_ids", "pages", raw.alias("raw"))
    return responses.ingest_textbook(calls)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The responses of three checks per attempt, as columns."""
    yes, because = F.lit(True), F.lit("because").alias("reason")

    def response(flag: str, *more):
        return F.to_json(F.struct(F.col(flag).alias("valid"), *more, because))

    four = [yes.alias(c) for c in ("exactly_four_answers", "single_best_answer")]
    named = [F.lit("c").alias(c) for c in ("requested_category", "assessed_category")]
    rows = _calls(spark, sf).select(
        "position", "attempt_number",
        response("mcq_valid", *four).alias("a"), response("category_valid", *named).alias("b"), response("quality_valid").alias("c"),
    )
    return responses.ingest_verdict_columns(rows, {"structure": "a", "category": "b", "quality": "c"})


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    key = ["position", "attempt_number"]
    made = _ingested(spark, sf).select(*key, "candidate", "failure_type")
    return responses.assemble_attempts(
        made, _grounding(spark, sf), _verdicts(spark, sf), _textbook(spark, sf), key
    ).select(*key, "failure_type", "accepted")


def _evidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lists = prompts.evidence_lists(t.query_evidence(spark, sf))
    return lists.select("scope", blocks.evidence_block("chunks").alias("block"))


_BLOCK = """
block_t AS (SELECT scope, '=== evidence ===' || chr(10) || string_agg('[Evidence ' || rank || ']' || chr(10) || 'Source: '
    || source_file || chr(10) || 'Page: ' || page || chr(10) || 'Chunk: ' || chunk_id || chr(10) || 'Text:' || chr(10)
    || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || '=== end of evidence ===' AS block
  FROM (SELECT *, query_id AS scope FROM evidence_t) GROUP BY scope)
"""


def _scoped_category():
    return F.concat(F.lit("Brand#"), F.col("scope") % 30 + 1)


def _generation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for the targets of every query; some categories have no style reference, some targets disagree with what is asked."""
    targets = concepts.query_targets(spark, sf).select(
        "*",
        _scoped_category().alias("category"),
        F.when(F.col("target_id") % 2 == 1, "STYLE_SIMILAR").otherwise("INDEPENDENT").alias("generation_mode"),
        F.when(F.col("scope") % 7 == 2, 5).alias("supplied_reference"),
        F.when(F.col("scope") % 7 == 3, "other").otherwise(_scoped_category()).alias("target_category"),
        F.when(F.col("scope") % 7 == 4, "other").otherwise(F.col("factual_focus")).alias("relationship_focus"),
    )
    references = log.bank.style_references(log._good_bank(spark, sf))
    strategies = targets.where("target_id = 1").select("category", "topic", F.lit("IDENTITY_FIRST").alias("strategy"))
    made = prompts.generation_prompts(targets, t.query_evidence(spark, sf), references, strategies, LEXICON)
    return made.select(
        "scope",
        "target_id",
        "category",
        "generation_mode",
        F.col("messages")[1]["content"].alias("task"),
        F.array_join("errors", "; ").alias("errors"),
    )


def _planning_prompts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.queries(spark, sf).select(
        F.col("query_id").alias("scope"), F.concat(F.lit("Brand#"), F.col("query_id") % 30 + 1).alias("category"), F.lit(3).alias("count")
    )
    coverage = identity.category_coverage(concepts.part_questions(spark, sf), PART_LEXICON)
    made = prompts.planning_prompts(wanted, t.query_evidence(spark, sf), coverage)
    return made.select("scope", F.col("messages")[1]["content"].alias("task"), F.array_join("errors", "; ").alias("errors"))


def _checked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as candidate questions, answered by themselves in lower case."""
    return t.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit("passage").alias("category"),
        F.col("text").alias("question"),
        F.array(F.lower("text"), F.lit("1. first"), F.concat(F.lit("not "), "text"), F.concat("item_id", F.lit(") x"))).alias("answers"),
        F.lit(1).alias("correct_answer"),
        F.lit("INDEPENDENT").alias("generation_mode"),
    )


def _secondary_checks(spark: SparkSession, sf: str) -> DataFrame:
    made = prompts.evidence_check_prompts(_checked_candidates(spark, sf), t.index(spark, sf, "SECONDARY"), secondary=True)
    return made.select("query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), "decided")


def _text_checks(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.text_check_prompts(_checked_candidates(spark, sf)).select(
        "query_id",
        "check",
        F.col("messages")[1]["content"].alias("task"),
        F.array_join("numbered_answers", ",").alias("numbered_answers"),
    )


def _plan_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One planning response per benchmark query, naming the words of its text; every fifth is cut off."""
    plan = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            w.alias("topic"),
            F.concat(F.lit("about "), w).alias("factual_focus"),
            F.array(i % 3 + 1, F.when(F.col("item_id") % 4 == 0, i + 1).otherwise(i % 3 + 1)).alias("evidence_refs"),
        ),
    )
    body = F.to_json(F.struct(plan.alias("targets")))
    return t.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("scope"),
        F.lit("passage").alias("category"),
        F.lit(4).alias("count"),
        F.array(*map(F.lit, CHUNK_IDS)).alias("chunk_ids"),
        F.when(F.col("item_id") % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body).alias("raw"),
    )


def _evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every category, the attempts as a whole, and the retrieval of the same run."""
    sections = {
        "categories": (log.QUERIES["category_rollup"](spark, sf), "category"),
        "attempts": (log.QUERIES["acceptance_rates"](spark, sf), None),
        "retrieval": (corpus.QUERIES["recall_at_k"](spark, sf), None),
    }
    return metrics.evaluation_report("run 1", sections)


def _combined_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over one index: their retrieval counts once."""
    runs = F.explode(F.array(F.lit("run 1"), F.lit("run 2"))).alias("run_id")
    return metrics.combined_retrieval(corpus.QUERIES["retrieval_hits"](spark, sf).select("*", runs))


QUERIES = {
    "evaluation_report": _evaluation_report,
    "combined_retrieval": _combined_retrieval,
    "ingested_questions": lambda s, f: _ingested(s, f).select(
        "position",
        "attempt_number",
        F.col("candidate.question").alias("question"),
        F.array_join("candidate.answers", "|").alias("answers"),
        F.array_join("evidence_chunk_ids", ",").alias("evidence"),
        "failure_type",
        "failure_message",
    ),
    "ingested_grounding": lambda s, f: _grounding(s, f).select(
        "position",
        "attempt_number",
        "status",
        F.array_join("errors", "; ").alias("errors"),
        "correct_answer_supported",
        "other_answers_not_equally_correct",
        F.array_join("evidence_chunk_ids", ",").alias("evidence"),
        "grounding_passed",
    ),
    "ingested_textbook": lambda s, f: _textbook(s, f).select(
        "position",
        "attempt_number",
        "status",
        "textbook_status",
        F.array_join("evidence_chunk_ids", ",").alias("evidence"),
        "source_page",
    ),
    "assembled_attempts": _assembled,
    "ingested_plans": lambda s, f: responses.ingest_plans(_plan_responses(s, f)).withColumn("own_chunks", F.array_join("own_chunks", ",")),
    "plan_statuses": lambda s, f: responses.plan_statuses(_plan_responses(s, f)).withColumn("errors", F.array_join("errors", "; ")),
    "evidence_blocks": _evidence_blocks,
    "generation_prompts": _generation_prompts,
    "planning_prompts": _planning_prompts,
    "secondary_checks": _secondary_checks,
    "text_checks": _text_checks,
    "template_versions": lambda s, f: t.read(s, f, "documents").select(
        "doc_id", blocks.template_version("text").alias("version")
    ),
}

_CANDIDATE = """'Question: ' || text || chr(10) || 'Answer 1: ' || lower(text) || chr(10)
  || 'Answer 2: 1. first' || chr(10) || 'Answer 3: not ' || text || chr(10) || 'Answer 4: ' || item_id || ') x'
  || chr(10) || 'Intended correct answer: 1' || chr(10) || 'Category: passage' || chr(10) || 'Mode: INDEPENDENT'"""
_SECOND = SEARCH.replace("source_type = 'PRIMARY'", "source_type = 'SECONDARY'").replace(
    "FROM benchmark)", "FROM checked_t)"
).replace("query_tf AS (", """checked_t AS (SELECT item_id, 'passage ' || text || ' ' || lower(text)
    AS text FROM benchmark),
query_tf AS (""")
_RULES = {
    "identity": "'The correct answer has to be ' || topic || ' itself, not a description of it.'",
    "language": "'Write ' || topic || ' exactly so wherever it is named, in the question and in the answers.'",
    "other": "'Name the target as the evidence does; do not invent a translation.'",
    "role": """CASE WHEN source_role AND source_entity IS NOT NULL THEN 'The evidence gives ' || topic || ' as the source of '
      || source_entity || '; ask for ' || topic || ', never for ' || source_entity || '.'
      WHEN source_role THEN 'The evidence gives ' || topic || ' as the source of something else; ask for ' || topic || '.'
      ELSE 'The target is what its evidence is about.' END""",
    "member": """CASE WHEN member THEN topic || ' is one member of a list; ask for what sets it apart from the others.'
      ELSE 'The target is not known to be a member of a list.' END""",
    "strategy": """CASE WHEN approved THEN 'Prefer a question that is answered by the name ' || topic
      || ' to one about a property.' ELSE 'Ask whatever the evidence supports best.' END""",
}
_G = f"""WITH RECURSIVE {FOUND}, {concepts._INVENTORY}, {concepts._REFINED}, {concepts._PLACED}, {concepts._QUERY_TARGETS},
goal_t AS (
  SELECT scope, target_id, concept AS topic, focus, chunk_id, source_role, {concepts._ENTITY} AS source_entity,
    {concepts._any('ahead', concepts.ENUMERATION)} AS member, 'Brand#' || (scope % 30 + 1) AS category,
    CASE WHEN target_id % 2 = 1 THEN 'STYLE_SIMILAR' ELSE 'INDEPENDENT' END AS mode,
    {concepts._classify('lower(focus)', LEXICON)} AS relationship FROM target_t),
hit_k AS (SELECT g.scope, target_id, e.rank, relationship, e.text, {concepts._COMPETITOR.replace('text', 'e.text')} AS keyword
  FROM goal_t g JOIN ev_t e ON e.scope = g.scope AND e.chunk_id <> g.chunk_id),
rival_t AS (SELECT scope, target_id, list('(' || relationship || ') ' || {concepts._SNIPPET} ORDER BY rank) AS rivals
  FROM (SELECT *, instr(lower(text), keyword) - 1 AS spot FROM hit_k WHERE keyword IS NOT NULL) GROUP BY ALL),
{_BLOCK}, {log._BANK},
style_t AS (SELECT p_brand AS category, 'A model for style only, not a source of facts.' || chr(10) || 'Reference: ' || id
    || chr(10) || 'Category: ' || p_brand || chr(10) || 'Question: ' || p_name || chr(10) || 'Answer 1: ' || p_type
    || chr(10) || 'Answer 2: ' || p_brand || chr(10) || 'Answer 3: size ' || p_size || chr(10) || 'Answer 4: number '
    || p_partkey || chr(10) || 'Correct answer: ' || (p_size % 5) AS style FROM good_t
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY row_no) = 1),
full_t AS (
  SELECT g.*, rivals, block, CASE WHEN mode = 'STYLE_SIMILAR' THEN style END AS style,
    (g.category, topic) IN (SELECT (category, topic) FROM goal_t WHERE target_id = 1) AS approved
  FROM goal_t g LEFT JOIN rival_t USING (scope, target_id) LEFT JOIN block_t USING (scope) LEFT JOIN style_t USING (category)),
fault_t AS (
  SELECT *, concat_ws('; ',
    CASE WHEN mode = 'STYLE_SIMILAR' AND style IS NULL THEN 'no style reference for the category' END,
    CASE WHEN mode = 'INDEPENDENT' AND scope % 7 = 2 THEN 'a style reference is given for an independent question' END,
    CASE WHEN scope % 7 = 3 THEN 'the target belongs to another category' END,
    CASE WHEN scope % 7 = 4 THEN 'the relationship was read from another focus' END) AS errors FROM full_t)
SELECT scope, target_id, category, mode AS generation_mode, errors,
  CASE WHEN errors = '' THEN
    'Category: ' || category || chr(10) || 'Mode: ' || mode || chr(10) || 'Relationship: ' || relationship || chr(10) || chr(10)
    || '=== question target ===' || chr(10) || 'Topic: ' || topic || chr(10) || 'Focus: ' || focus || chr(10)
    || '=== end of question target ===' || chr(10) || chr(10) || {_RULES['identity']} || chr(10)
    || CASE WHEN regexp_matches(topic, '[^\\x00-\\x7f]') THEN {_RULES['other']} ELSE {_RULES['language']} END || chr(10)
    || {_RULES['role']} || chr(10) || {_RULES['member']} || chr(10) || {_RULES['strategy']} || chr(10) || chr(10)
    || '=== competing passages ===' || chr(10) || coalesce(array_to_string(list_transform(generate_series(1, len(rivals)),
      lambda i: '[Competitor ' || i || '] ' || rivals[i]), chr(10)), 'None were found.') || chr(10)
    || '=== end of competing passages ===' || chr(10) || chr(10) || block || chr(10) || chr(10)
    || '=== style reference ===' || chr(10) || coalesce(style, 'No style reference is given.') || chr(10)
    || '=== end of style reference ===' END AS task
FROM fault_t"""
_COVERED = concepts.ORACLES["category_coverage"]

ORACLES = {
    "ingested_questions": f"""WITH {_CALLS} SELECT position, attempt_number,
      CASE WHEN failure_type IS NULL THEN 'what is ' || p_type END AS question,
      CASE WHEN failure_type IS NULL THEN p_name || CASE WHEN kind = 9 THEN ' of ' || p_brand ELSE '' END || '|' || p_type
        || '|none|size ' || p_size END AS answers,
      CASE WHEN failure_type IS NULL THEN 'chunk b,chunk a' END AS evidence, failure_type, failure_message FROM call_t""",
    "ingested_grounding": f"""WITH {_CALLS}, {_GROUNDING}
      SELECT position, attempt_number, CASE WHEN good THEN 'OK' ELSE 'DOMAIN_INVALID' END AS status, errors,
        CASE WHEN good THEN own END AS correct_answer_supported, CASE WHEN good THEN NOT other END AS other_answers_not_equally_correct,
        CASE WHEN good THEN array_to_string(ids, ',') END AS evidence,
        CASE WHEN good THEN own AND NOT other END AS grounding_passed FROM fold_t""",
    "ingested_textbook": f"""WITH {_CALLS} SELECT position, attempt_number,
      CASE WHEN kind = 0 THEN 'DOMAIN_INVALID' ELSE 'OK' END AS status,
      CASE WHEN kind <> 0 THEN textbook_status END AS textbook_status,
      CASE WHEN kind = 0 THEN NULL WHEN textbook_status = 'NOT_FOUND' THEN '' ELSE 'chunk b,chunk b,chunk a' END AS evidence,
      CASE WHEN kind <> 0 AND textbook_status <> 'NOT_FOUND' THEN 20 END AS source_page FROM call_t""",
    "assembled_attempts": f"""WITH {_CALLS}, {_GROUNDING}
      SELECT position, attempt_number, failure_type, failure_type IS NULL AND good AND own AND NOT other AND mcq_valid
        AND category_valid AND quality_valid AND kind <> 0 AND textbook_status <> 'POTENTIAL_CONFLICT' AS accepted
      FROM fold_t""",
    "ingested_plans": """WITH w AS (SELECT item_id, string_split(text, ' ') AS words FROM benchmark WHERE item_id % 5 <> 0)
      SELECT item_id AS scope, 'passage' AS category, i AS target_id, words[i] AS topic, 'about ' || words[i] AS factual_focus,
        CASE WHEN item_id % 4 = 0 AND i > 3 THEN NULL ELSE ['chunk a', 'chunk b', 'chunk c'][(i - 1) % 3 + 1] END AS own_chunks
      FROM (SELECT *, unnest(generate_series(1, least(len(words), 4))) AS i FROM w) WHERE item_id % 4 <> 0 OR len(words) <= 3""",
    "plan_statuses": """SELECT item_id AS scope, 'passage' AS category, 4 AS count,
        CASE WHEN item_id % 5 = 0 THEN 'MALFORMED' WHEN bad THEN 'DOMAIN_INVALID' ELSE 'OK' END AS status,
        CASE WHEN item_id % 5 = 0 THEN 'not JSON' WHEN bad THEN 'targets missing or unsound' ELSE '' END AS errors,
        CASE WHEN item_id % 5 = 0 OR bad THEN 0 ELSE least(n, 4) END AS targets
      FROM (SELECT item_id, len(string_split(text, ' ')) AS n, item_id % 4 = 0 AND n > 3 AS bad FROM benchmark)""",
    "evidence_blocks": f"WITH RECURSIVE {SEARCH}, {_BLOCK} SELECT scope, block FROM block_t",
    "generation_prompts": _G,
    "planning_prompts": f"""WITH RECURSIVE {SEARCH}, {_BLOCK}, covered_t AS ({_COVERED})
      SELECT item_id AS scope, '' AS errors, 'Category: Brand#' || (item_id % 30 + 1) || chr(10) || 'Targets wanted: 3' || chr(10)
        || chr(10) || block || chr(10) || chr(10) || '=== covered so far ===' || chr(10)
        || coalesce('Answers used so far:' || chr(10) || '- ' || array_to_string(tested_concepts, chr(10) || '- ')
          || CASE WHEN len(tested_relationship_types) > 0 THEN chr(10) || 'Relationships used so far:' || chr(10) || '- '
            || array_to_string(tested_relationship_types, chr(10) || '- ') ELSE '' END, 'Nothing has been asked yet.')
        || chr(10) || '=== end of covered so far ===' AS task
      FROM benchmark JOIN block_t ON scope = item_id LEFT JOIN covered_t ON category = 'Brand#' || (item_id % 30 + 1)""",
    "secondary_checks": f"""WITH RECURSIVE {_SECOND},
      list_t AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM evidence_t GROUP BY query_id)
      SELECT item_id AS query_id, coalesce(chunk_ids, '') AS chunk_ids,
        CASE WHEN chunk_ids IS NULL THEN 'NOT_FOUND' END AS decided FROM benchmark LEFT JOIN list_t ON query_id = item_id""",
    "text_checks": f"""SELECT item_id AS query_id, unnest(['structure', 'category', 'quality']) AS "check",
      unnest([{_CANDIDATE}, 'Requested category: passage' || chr(10) || chr(10) || {_CANDIDATE}, NULL]) AS task,
      unnest([NULL, NULL, '2,4']) AS numbered_answers FROM benchmark""",
    "template_versions": "SELECT doc_id, sha256(text) AS version FROM documents",
}
_MEASURES = {
    "categories": ("category", ("requested_questions", "first_position", "produced_questions", "candidate_attempts", "accepted_candidates",
        "rejected_candidates", "exhausted_units", "operational_failures"), log.ORACLES["category_rollup"]),
    "attempts": ("NULL", ("attempts", "accepted", "acceptance_rate", "first_attempt_rate"), log.ORACLES["acceptance_rates"]),
    "retrieval": ("NULL", ("queries", "recall_at_3", "recall_at_5", "recall_at_8"), corpus.ORACLES["recall_at_k"]),
}
ORACLES["evaluation_report"] = " UNION ALL ".join(
    f"""SELECT 'run 1' AS run_id, '{section}' AS section, {key}::VARCHAR AS key, unnest({list(names)}) AS measure,
      unnest([{', '.join(f'{n}::DOUBLE' for n in names)}]) AS value FROM ({sql})"""
    for section, (key, names, sql) in _MEASURES.items()
)
ORACLES["combined_retrieval"] = f"SELECT query_id, expected_chunks, hit_at_3, hit_at_5, hit_at_8 FROM ({corpus.ORACLES['retrieval_hits']})"
