"""Registered queries over attempt logs, question banks, plans, audits and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidence_spark.functions import checks
from evidence_spark.operators import acceptance, analysis, audit, categories, metrics
from evidence_spark.plans import tables as t
from evidence_spark.sources import bank, experiments, requests
from evidence_spark.sources.tables import write_table

# Phrases that occur in the questions made from the part names.
SHAPES = {"membership": ["part of"], "copulas": ["is "], "naming": ["known as"], "properties": ["size"]}
STRATEGIES = {"naming": ["known as"], "copulas": ["is "], "properties": ["size", "part of"]}


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as attempts at the question of their order."""

    def build() -> DataFrame:
        lines = t.read(spark, sf, "lineitem")
        orders = t.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
        nth = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        verdicts = {
            "grounding_passed": F.col("l_quantity") <= 40,
            "mcq_valid": F.col("l_discount") <= 0.08,
            "category_valid": F.col("l_tax") <= 0.07,
            "quality_valid": F.col("l_extendedprice") > 2000,
            "textbook_status": F.when(F.col("l_returnflag") == "A", "CONSISTENT")
            .when(F.col("l_returnflag") == "N", "NOT_FOUND")
            .otherwise("POTENTIAL_CONFLICT"),
        }
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_orderkey") + 1).alias("position"),
            F.col("o_orderpriority").alias("category"),
            F.when(F.col("o_orderkey") % 2 == 0, "STYLE_SIMILAR").otherwise("INDEPENDENT").alias("generation_mode"),
            F.row_number().over(nth).alias("attempt_number"),
            "l_partkey",
            "l_returnflag",
            *[v.alias(name) for name, v in verdicts.items()],
        )
        return write_table(rows.withColumn("accepted", checks.accepted(*verdicts)), "attempts")

    return t.once(spark, sf, "attempts", build)


_ATTEMPTS = """
attempt_t AS (
  SELECT *, grounding_passed AND mcq_valid AND category_valid AND quality_valid
      AND textbook_status <> 'POTENTIAL_CONFLICT' AS accepted
  FROM (
    SELECT l_orderkey + 1 AS position, o_orderpriority AS category, l_partkey, l_returnflag,
      CASE WHEN o_orderkey % 2 = 0 THEN 'STYLE_SIMILAR' ELSE 'INDEPENDENT' END AS generation_mode,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS attempt_number,
      l_quantity <= 40 AS grounding_passed, l_discount <= 0.08 AS mcq_valid, l_tax <= 0.07 AS category_valid,
      l_extendedprice > 2000 AS quality_valid,
      CASE l_returnflag WHEN 'A' THEN 'CONSISTENT' WHEN 'N' THEN 'NOT_FOUND' ELSE 'POTENTIAL_CONFLICT' END AS textbook_status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
cut_t AS (
  SELECT * EXCLUDE (stop) FROM (
    SELECT *, min(CASE WHEN accepted THEN attempt_number END) OVER (PARTITION BY position) AS stop
    FROM attempt_t WHERE attempt_number <= 3)
  WHERE stop IS NULL OR attempt_number <= stop),
result_t AS (
  SELECT position, count(*) AS attempts, bool_or(accepted) AS produced, max(attempt_number) AS last_no FROM cut_t GROUP BY position),
clean_t AS (
  SELECT 'ALL' AS exam_id, position, row_number() OVER (ORDER BY position) AS number, c.category, c.generation_mode,
    p_name AS question, p_partkey % 4 + 1 AS correct_answer,
    [p_type, p_brand, 'size ' || p_size, 'number ' || p_partkey] AS answers
  FROM cut_t c JOIN part ON p_partkey = l_partkey WHERE accepted)
"""


def _metric_log(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).withColumnRenamed("position", "question_position")


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    return acceptance.cut_at_acceptance(attempts(spark, sf))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_name").alias("question"),
        F.array(
            "p_type",
            "p_brand",
            F.concat(F.lit("size "), "p_size"),
            F.concat(F.lit("number "), "p_partkey"),
        ).alias("answers"),
        (F.col("p_partkey") % 4 + 1).cast("int").alias("correct_answer"),
    )


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted questions of one exam over the whole log, renumbered."""

    def build() -> DataFrame:
        rows = _cut(spark, sf).where("accepted").join(_parts(spark, sf), "l_partkey")
        return write_table(acceptance.renumber(rows.withColumn("exam_id", F.lit("ALL"))), "accepted")

    return t.once(spark, sf, "accepted", build)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(spark, sf).select(*acceptance.clean_question(F.col("number")))


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without a line: planned questions that never got an attempt."""
    lines = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return (
        t.read(spark, sf, "orders")
        .join(lines, "o_orderkey", "left_anti")
        .select(
            (F.col("o_orderkey") + 1).alias("position"),
            F.col("o_orderpriority").alias("category"),
            F.when(F.col("o_orderstatus") == "O", "InsufficientDistinctTargetsError")
            .when(F.col("o_orderstatus") == "F", "InvalidGroundingOutputError")
            .otherwise("RetrievalError")
            .alias("failure_type"),
        )
    )


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("position"), F.col("o_orderpriority").alias("category")
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's outcome, once in the exam of all orders and once in its category's."""
    made = acceptance.outcomes(_cut(spark, sf)).select("position", "produced")
    rows = _plan(spark, sf).join(made, "position", "left").withColumn("accepted", F.coalesce("produced", F.lit(False)))
    return rows.select(F.explode(F.array(F.lit("ALL"), F.col("category"))).alias("exam_id"), "position", "accepted")


def _trail(column: str):
    return F.array_join(
        F.transform(column, lambda a: F.concat(a["attempt_number"], F.when(a["accepted"], "+").otherwise("-"))), ","
    )


def _question_audit(spark: SparkSession, sf: str) -> DataFrame:
    log = _cut(spark, sf).withColumn("exam_id", F.lit("ALL"))
    return audit.question_audit(_accepted(spark, sf), log).withColumn("attempts", _trail("attempts"))


def _failed_audit(spark: SparkSession, sf: str) -> DataFrame:
    log = _cut(spark, sf).withColumn("exam_id", F.lit("ALL"))
    lost = acceptance.outcomes(_cut(spark, sf)).where(~F.col("produced"))
    failures = lost.select(
        F.lit("ALL").alias("exam_id"),
        "position",
        "final_attempt.category",
        "final_attempt.generation_mode",
        F.lit("QuestionAttemptsExhaustedError").alias("failure_type"),
        F.format_string("%d attempts without an accepted candidate", "attempts").alias("message"),
    )
    return audit.failed_audit(failures, log).withColumn("attempts", _trail("attempts"))


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """An audit that took the final number for the planned position disagrees where they differ."""
    accepted = _accepted(spark, sf).withColumn("last_accepted", F.col("accepted"))
    wrong = accepted.select("exam_id", "number", F.col("number").alias("planned_position"), "category")
    found = audit.reconcile(accepted, accepted, wrong.where(F.col("category") != "5-LOW"))
    return found.withColumn("mismatches", F.array_join("mismatches", ","))


def _request_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per order year a request: its priorities, the two most urgent by their short names."""
    year = F.year("o_orderdate")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "URGENT")
        .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .otherwise(F.col("o_orderpriority"))
    )
    each = t.read(spark, sf, "orders").select(
        year.alias("request_id"), F.explode(F.array(name, F.col("o_orderpriority"))).alias("category")
    )
    counts = each.groupBy("request_id", "category").agg((F.count("*") % 7 + 1).cast("int").alias("requested"))
    maps = counts.groupBy("request_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "requested")))).alias("categories")
    )
    return requests.request_rows(maps)


def _aliases(spark: SparkSession) -> DataFrame:
    return requests.alias_table(spark, {"URGENT": "1-URGENT", "HIGH": "2-HIGH", "5-LOW": "1-URGENT", "ODD": "9-NONE", " ": "5-LOW"})


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("category")).distinct()


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    good = _aliases(spark).where(F.col("alias").isin("URGENT", "HIGH"))
    return categories.resolve_categories(_request_rows(spark, sf), _canonical(spark, sf), good)


_REQUESTS = """
name_t AS (
  SELECT year(o_orderdate) AS request_id, unnest([CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT'
    WHEN '2-HIGH' THEN 'HIGH' ELSE o_orderpriority END, o_orderpriority]) AS category FROM orders),
request_t AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY category) - 1 AS ord
  FROM (SELECT request_id, category, count(*) % 7 + 1 AS requested FROM name_t GROUP BY ALL)),
resolved_t AS (
  SELECT *, CASE category WHEN 'URGENT' THEN '1-URGENT' WHEN 'HIGH' THEN '2-HIGH' ELSE category END AS canonical
  FROM request_t),
combined_t AS (
  SELECT request_id, canonical AS category, sum(requested) AS requested, min(ord) AS ord FROM resolved_t GROUP BY ALL)
"""


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a question bank; every key also occurs a second time, with its number halved."""
    parts = t.read(spark, sf, "part").select(
        "*", F.posexplode(F.array(F.col("p_partkey"), F.floor(F.col("p_partkey") / 2))).alias("copy", "id")
    )
    raw = parts.select(
        "id",
        (F.col("p_partkey") * 2 + F.col("copy") + 2).alias("row_no"),
        F.col("p_brand").alias("category"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("answer1"),
        F.col("p_brand").alias("answer2"),
        F.concat(F.lit("size "), "p_size").alias("answer3"),
        F.concat(F.lit("number "), "p_partkey").alias("answer4"),
        (F.col("p_size") % 5).alias("correct_answer_id"),
    )
    return bank.check_bank(bank.bank_rows(raw))


_BANK = """
raw_t AS (
  SELECT unnest([p_partkey, p_partkey // 2]) AS id, p_partkey * 2 + unnest([0, 1]) + 2 AS row_no, p_brand, p_name, p_size, p_type, p_partkey
  FROM part),
rule_t AS (
  SELECT *, list_filter([CASE WHEN NOT id > 0 THEN 'id must be a positive integer' END,
    CASE WHEN NOT p_size % 5 BETWEEN 1 AND 4 THEN 'correct answer must be 1 to 4' END], lambda e: e IS NOT NULL) AS broken
  FROM raw_t),
bank_t AS (
  SELECT *, CASE WHEN len(broken) = 0 AND row_no > first_row
    THEN ['id already used in row ' || first_row] ELSE broken END AS errors
  FROM rule_t LEFT JOIN (
    SELECT id AS fid, min(row_no) AS first_row FROM rule_t WHERE len(broken) = 0 GROUP BY id) ON fid = id),
good_t AS (SELECT * FROM bank_t WHERE len(errors) = 0)
"""


def _good_bank(spark: SparkSession, sf: str) -> DataFrame:
    return _bank(spark, sf).where(F.size("errors") == 0)


def _style(spark: SparkSession, sf: str) -> DataFrame:
    r = "reference"
    return bank.style_references(_good_bank(spark, sf)).select(
        "category", f"{r}.historical_question_id", f"{r}.question", f"{r}.correct_answer"
    )


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "part").select(
        F.col("p_brand").alias("category"),
        F.col("p_partkey").alias("position"),
        F.lit(1).alias("try_no"),
        F.col("p_name").alias("question"),
        "p_retailprice",
    )


def _duplicates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Part names as questions; those of the cheapest parts exist already."""
    made = _candidates(spark, sf)
    existing = made.where(F.col("p_retailprice") < 905).withColumn("question", F.upper("question"))
    return acceptance.control_duplicates(made, existing, max_replacements=0)


def _replacements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tries of a part: its type, its size and its name, which parts of a brand share; those of some sizes exist already, and a fourth try is over the budget."""
    part = t.read(spark, sf, "part")
    texts = F.array(F.concat(F.lit("In  "), "p_type"), F.concat(F.lit("size "), "p_size"), F.concat(F.lit("Of "), "p_name"), F.concat(F.lit("by "), "p_brand"))
    made = part.select(
        F.col("p_brand").alias("category"), F.col("p_partkey").alias("position"), F.posexplode(texts).alias("try_no", "question")
    ).withColumn("try_no", F.col("try_no") + 1)
    existing = part.where("p_size % 7 = 1").select(F.col("p_brand").alias("category"), F.concat(F.lit(" OF "), "p_name").alias("question"))
    return acceptance.control_duplicates(made, existing, max_replacements=2)


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment logs of three shapes, one per order, and what their attempts are."""
    log = attempts(spark, sf)
    step = F.struct(
        "attempt_number",
        "accepted",
        F.lit("q").alias("question"),
        F.struct(F.struct(F.col("grounding_passed").alias("passed")).alias("grounding")).alias("validations"),
    )
    rounds = log.groupBy("position", "category").agg(
        F.array_sort(F.collect_list(step)).alias("attempts"), F.bool_or("accepted").alias("accepted")
    )
    kind = F.col("position") % 3
    full = F.array(F.struct(F.lit("T").alias("target"), "attempts", "accepted"))
    wrapped = F.struct(F.array(F.struct(F.lit("S").alias("selected_concept"), "attempts", "accepted")).alias("rounds"))
    brief = F.array(
        F.struct(
            F.lit("B").alias("selected_concept"), F.size("attempts").alias("attempts"), "accepted", F.lit("last").alias("question")
        )
    )
    body = F.when(kind == 0, F.to_json(full)).when(kind == 1, F.to_json(wrapped)).otherwise(F.to_json(brief))
    return rounds.select(
        F.col("position").cast("string").alias("source"),
        F.concat(F.lit('{"'), "category", F.lit('":'), body, F.lit("}")).alias("json"),
    )


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with questions in three wordings about the part's name."""
    parts = _parts(spark, sf).select("l_partkey", F.col("question").alias("target"), F.col("answers")[0].alias("kind"))
    rows = attempts(spark, sf).join(parts, "l_partkey")
    question = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("which is the "), "target"))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("what size has a "), "kind"))
        .otherwise(F.concat("target", F.lit(" is part of the "), "kind"))
    )
    worded = rows.withColumn("question", question)
    return worded.select(
        "category",
        "target",
        "accepted",
        F.col("position").alias("round"),
        "attempt_number",
        F.col("generation_mode").alias("source"),
        "question",
        F.lit(True).alias("has_detail"),
        analysis.question_shape("question", "target", **SHAPES).alias("shape"),
        analysis.strategy("question", "target", **STRATEGIES).alias("strategy"),
    )


_LONG = "list_filter(string_split(lower(target), ' '), lambda w: length(w) >= 4)"
_SHAPED = f"""
worded_t AS (
  SELECT a.*, p_name AS target, generation_mode AS source, CASE l_returnflag WHEN 'A' THEN 'which is the ' || p_name
    WHEN 'N' THEN 'what size has a ' || p_type ELSE p_name || ' is part of the ' || p_type END AS question
  FROM attempt_t a JOIN part ON p_partkey = l_partkey),
shape_t AS (
  SELECT *, position AS round,
    CASE WHEN len(list_filter({_LONG}, lambda w: contains(lower(question), w))) > 0 AND contains(question, 'is ')
        AND NOT contains(question, 'part of') THEN 'IDENTITY'
      WHEN contains(question, 'part of') THEN 'CLASSIFICATION_MEMBERSHIP'
      WHEN contains(question, 'size') THEN 'PROPERTY' ELSE 'OTHER_UNKNOWN' END AS shape,
    CASE WHEN contains(question, 'is ') AND NOT contains(question, 'size') AND NOT contains(question, 'part of')
        AND len(list_filter({_LONG}, lambda w:
          contains(substring(lower(question), instr(question, 'is ') + 3, 30), w))) > 0 THEN 'IDENTITY'
      WHEN contains(question, 'size') OR contains(question, 'part of') THEN 'PROPERTY'
      ELSE 'OTHER/UNCLEAR' END AS strategy
  FROM worded_t),
rate_t AS (
  SELECT *, round_even(total_accepted / total_attempts, 3) AS overall_rate,
    round_even(property_accepted / nullif(property_attempts, 0), 3) AS property_rate,
    round_even(identity_accepted / nullif(identity_attempts, 0), 3) AS identity_rate
  FROM (
    SELECT category, target, count(*) AS total_attempts, count(*) FILTER (accepted) AS total_accepted,
      count(*) AS detailed_attempts, 0 AS round_level_only,
      count(*) FILTER (shape = 'PROPERTY') AS property_attempts,
      count(*) FILTER (shape = 'IDENTITY') AS identity_attempts,
      count(*) FILTER (shape = 'CLASSIFICATION_MEMBERSHIP') AS classification_membership_attempts,
      count(*) FILTER (shape = 'OTHER_UNKNOWN') AS other_unknown_attempts,
      count(*) FILTER (shape = 'PROPERTY' AND accepted) AS property_accepted,
      count(*) FILTER (shape = 'IDENTITY' AND accepted) AS identity_accepted,
      count(*) FILTER (shape = 'CLASSIFICATION_MEMBERSHIP' AND accepted) AS classification_membership_accepted,
      count(*) FILTER (shape = 'OTHER_UNKNOWN' AND accepted) AS other_unknown_accepted,
      count(*) FILTER (shape = 'IDENTITY' AND accepted AND attempt_number = 1) AS first_attempt_identity_count,
      count(*) FILTER (shape = 'IDENTITY' AND accepted AND attempt_number > 1) AS post_failure_identity_count,
      0 AS unknown_order_identity_count, list_sort(list(DISTINCT source)) AS sources
    FROM shape_t GROUP BY category, target))
"""


def _by_target(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.by_target(analysis.tag_order(shaped(spark, sf)))


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    """The two generation modes as conditions; a question is aligned if its first attempt was grounded."""
    rounds = _cut(spark, sf).groupBy("position", F.col("generation_mode").alias("condition")).agg(
        F.bool_or("accepted").alias("accepted"),
        F.count("*").alias("attempts"),
        F.bool_or((F.col("attempt_number") == 1) & F.col("grounding_passed")).alias("aligned"),
    )
    return analysis.compare_conditions(rounds)


def _rates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


QUERIES = {
    "attempts_until_acceptance": lambda s, f: _cut(s, f).select("position", "attempt_number", "accepted"),
    "question_outcomes": lambda s, f: acceptance.outcomes(_cut(s, f)).select(
        "position", "attempts", "produced", F.col("final_attempt.attempt_number").alias("last_no")
    ),
    "acceptance_rates": lambda s, f: _rates(
        metrics.acceptance_rates(_metric_log(s, f)), "acceptance_rate", "first_attempt_rate"
    ),
    "attempts_per_accepted": lambda s, f: _rates(metrics.attempts_per_accepted(_metric_log(s, f)), "mean"),
    "exhaustion_rate": lambda s, f: _rates(metrics.exhaustion_rate(_metric_log(s, f)), "exhaustion_rate"),
    "validator_failures": lambda s, f: _rates(metrics.validator_failures(_metric_log(s, f)), "rate"),
    "textbook_distribution": lambda s, f: metrics.textbook_distribution(_metric_log(s, f)),
    "grouped_attempts": lambda s, f: metrics.grouped_attempts(_metric_log(s, f)).withColumn(
        "attempts", _trail("attempts")
    ),
    "category_rollup": lambda s, f: metrics.category_rollup(_plan(s, f), _metric_log(s, f), _failures(s, f)),
    "attempt_records": lambda s, f: metrics.attempt_records(
        attempts(s, f).join(_parts(s, f), "l_partkey").select("position", "attempt_number", "accepted", "question", "correct_answer")
    ),
    "combined_report": lambda s, f: _rates(
        metrics.combined_report(attempts(s, f).withColumnRenamed("generation_mode", "run_id")),
        "acceptance_rate",
        "first_attempt_rate",
    ),
    "failure_scopes": lambda s, f: acceptance.classify_failures(_failures(s, f)),
    "run_summary": lambda s, f: acceptance.run_summary(_results(s, f)),
    "clean_question_set": _clean,
    "question_audit": _question_audit,
    "failed_question_audit": _failed_audit,
    "audit_mismatches": _reconciled,
    "resolved_requests": lambda s, f: _resolved(s, f).select("request_id", "ord", "category", "canonical", "requested"),
    "unknown_categories": lambda s, f: categories.unknown_categories(
        categories.resolve_categories(_request_rows(s, f), _canonical(s, f), _aliases(s).where("alias = 'HIGH'"))
    ),
    "alias_violations": lambda s, f: categories.alias_violations(_aliases(s), _canonical(s, f)),
    "combined_requests": lambda s, f: categories.combine_requests(_resolved(s, f)),
    "question_plan": lambda s, f: categories.build_plan(categories.combine_requests(_resolved(s, f))),
    "question_bank_check": lambda s, f: _bank(s, f).select(
        F.col("historical_question_id").alias("id"), "row_no", F.array_join("errors", "; ").alias("errors")
    ),
    "canonical_categories": lambda s, f: bank.canonical_categories(_good_bank(s, f)),
    "style_references": _style,
    "duplicate_candidates": lambda s, f: _duplicates(s, f)[0].select("category", "position", "question", "duplicate"),
    "duplicate_positions": lambda s, f: _duplicates(s, f)[1],
    "replaced_candidates": lambda s, f: _replacements(s, f)[0],
    "replacement_budget": lambda s, f: _replacements(s, f)[1],
    "experiment_attempts": lambda s, f: experiments.attempts_from_records(_logs(s, f)),
    "question_shapes": lambda s, f: shaped(s, f).groupBy("shape", "strategy").agg(F.count("*").alias("n")),
    "strategy_counts": lambda s, f: analysis.strategy_counts(shaped(s, f).withColumnRenamed("category", "target_group")),
    "attempts_saved": lambda s, f: analysis.attempts_saved(shaped(s, f)),
    "attempts_by_target": lambda s, f: _by_target(s, f),
    "ranked_candidates": lambda s, f: analysis.rank_candidates(
        _by_target(s, f), s.createDataFrame([("1-URGENT", "red widget")], "category string, target string")
    ).select("category", "target", "candidate_score", "status"),
    "condition_comparison": _conditions,
    "calls_per_profile": lambda s, f: analysis.call_counts(
        attempts(s, f).select(
            F.explode(F.array(F.lit("GENERATION"), *[F.lit("VALIDATION")] * len(metrics.VALIDATORS))).alias("profile")
        )
    ),
    "retry_summary": lambda s, f: _rates(
        analysis.retry_summary(
            acceptance.outcomes(_cut(s, f)).where("attempts > 1").select(
                F.col("final_attempt.category").alias("validator"),
                F.col("attempts").alias("attempts_made"),
                F.col("produced").alias("recovered"),
            )
        ),
        "recovered_rate",
    ),
}

_RATES = """count(*) AS attempts, count(*) FILTER (accepted) AS accepted,
  round(coalesce(count(*) FILTER (accepted) / nullif(count(*), 0), 0), 6) AS acceptance_rate,
  round(coalesce(count(*) FILTER (accepted AND attempt_number = 1) / nullif(count(*) FILTER (accepted), 0), 0), 6)
    AS first_attempt_rate"""
_TRAIL = "string_agg(attempt_number || CASE WHEN accepted THEN '+' ELSE '-' END, ',' ORDER BY attempt_number)"

ORACLES = {
    "attempts_until_acceptance": f"WITH {_ATTEMPTS} SELECT position, attempt_number, accepted FROM cut_t",
    "question_outcomes": f"WITH {_ATTEMPTS} SELECT * FROM result_t",
    "acceptance_rates": f"WITH {_ATTEMPTS} SELECT {_RATES} FROM attempt_t",
    "attempts_per_accepted": f"""WITH {_ATTEMPTS} SELECT round(avg(n), 6) AS mean, median(n) AS median,
      min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, count(*) AS n
      FROM (SELECT count(*) AS n FROM attempt_t GROUP BY position HAVING bool_or(accepted))""",
    "exhaustion_rate": f"""WITH {_ATTEMPTS} SELECT count(*) AS questions, count(*) FILTER (NOT p) AS exhausted,
      round(count(*) FILTER (NOT p) / count(*), 6) AS exhaustion_rate
      FROM (SELECT bool_or(accepted) AS p FROM attempt_t GROUP BY position)""",
    "validator_failures": f"""WITH {_ATTEMPTS} SELECT validator, count(*) FILTER (NOT ok) AS failures,
      count(*) AS total_rejected, round(count(*) FILTER (NOT ok) / count(*), 6) AS rate
      FROM (SELECT unnest(['grounding', 'mcq', 'category', 'quality']) AS validator,
          unnest([grounding_passed, mcq_valid, category_valid, quality_valid]) AS ok FROM attempt_t WHERE NOT accepted)
      GROUP BY validator""",
    "textbook_distribution": f"WITH {_ATTEMPTS} SELECT textbook_status, count(*) AS attempts FROM attempt_t GROUP BY ALL",
    "grouped_attempts": f"""WITH {_ATTEMPTS} SELECT position AS question_position, {_TRAIL} AS attempts
      FROM attempt_t GROUP BY position""",
    "category_rollup": f"""WITH {_ATTEMPTS},
      q AS (SELECT category, position, count(*) AS n, count(*) FILTER (accepted) AS good FROM attempt_t GROUP BY ALL),
      a AS (SELECT category, count(*) FILTER (good > 0) AS produced_questions, sum(n) AS candidate_attempts,
        sum(good) AS accepted_candidates, sum(n - good) AS rejected_candidates, count(*) FILTER (good = 0) AS exhausted_units
        FROM q GROUP BY category)
      SELECT o_orderpriority AS category, count(*) AS requested_questions, min(o_orderkey) + 1 AS first_position,
        produced_questions, candidate_attempts, accepted_candidates, rejected_candidates, exhausted_units,
        count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS operational_failures
      FROM orders JOIN a ON a.category = o_orderpriority GROUP BY ALL""",
    "attempt_records": f"""WITH {_ATTEMPTS} SELECT position, attempt_number, accepted,
      CASE WHEN accepted THEN p_name END AS question, CASE WHEN accepted THEN p_partkey % 4 + 1 END AS correct_answer
      FROM attempt_t JOIN part ON p_partkey = l_partkey""",
    "combined_report": f"""WITH {_ATTEMPTS} SELECT generation_mode AS run_id, {_RATES} FROM attempt_t GROUP BY ALL
      UNION ALL SELECT 'all', {_RATES} FROM attempt_t""",
    "failure_scopes": """SELECT o_orderkey + 1 AS position, o_orderpriority AS category,
      CASE o_orderstatus WHEN 'O' THEN 'InsufficientDistinctTargetsError' WHEN 'F' THEN 'InvalidGroundingOutputError'
        ELSE 'RetrievalError' END AS failure_type,
      CASE WHEN o_orderstatus IN ('O', 'F') THEN 'QUESTION' ELSE 'SYSTEM' END AS scope
      FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "run_summary": f"""WITH {_ATTEMPTS},
      r AS (SELECT unnest(['ALL', o_orderpriority]) AS exam_id, o_orderkey + 1 AS position, coalesce(produced, false) AS accepted
        FROM orders LEFT JOIN result_t ON position = o_orderkey + 1)
      SELECT exam_id, count(*) AS planned, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS failed,
        CASE WHEN bool_and(accepted) THEN 'COMPLETE' ELSE 'PARTIAL' END AS status,
        min(position) = 1 AND max(position) = count(*) AND count(DISTINCT position) = count(*) AS positions_complete
      FROM r GROUP BY exam_id""",
    "clean_question_set": f"""WITH {_ATTEMPTS} SELECT number, question, answers[1] AS answer1, answers[2] AS answer2,
      answers[3] AS answer3, answers[4] AS answer4, correct_answer, category FROM clean_t""",
    "question_audit": f"""WITH {_ATTEMPTS},
      trail_t AS (SELECT position, {_TRAIL} AS attempts, count(*) AS generation_attempts FROM cut_t GROUP BY position)
      SELECT c.exam_id, c.number, c.position AS planned_position, c.category, c.generation_mode, a.grounding_passed,
        a.mcq_valid, a.category_valid, a.quality_valid, a.textbook_status, generation_attempts, attempts
      FROM clean_t c JOIN trail_t USING (position) JOIN cut_t a ON a.position = c.position AND a.accepted""",
    "failed_question_audit": f"""WITH {_ATTEMPTS} SELECT 'ALL' AS exam_id, position AS planned_position, any_value(category) AS category,
      any_value(generation_mode) AS generation_mode, 'QuestionAttemptsExhaustedError' AS failure_type,
      count(*) || ' attempts without an accepted candidate' AS message, {_TRAIL} AS attempts
      FROM cut_t GROUP BY position HAVING NOT bool_or(accepted)""",
    "audit_mismatches": f"""WITH {_ATTEMPTS} SELECT exam_id, number,
      CASE WHEN category = '5-LOW' THEN 'missing in audit' ELSE 'position' END AS mismatches
      FROM clean_t WHERE category = '5-LOW' OR position <> number""",
    "resolved_requests": f"WITH {_REQUESTS} SELECT request_id, ord, category, canonical, requested FROM resolved_t",
    "unknown_categories": f"""WITH {_REQUESTS} SELECT request_id, ord, category, requested FROM request_t
      WHERE category = 'URGENT'""",
    "alias_violations": """WITH alias_t(alias, target) AS (VALUES ('URGENT', '1-URGENT'), ('HIGH', '2-HIGH'),
        ('5-LOW', '1-URGENT'), ('ODD', '9-NONE'), (' ', '5-LOW')),
      c AS (SELECT DISTINCT o_orderpriority AS category FROM orders)
      SELECT alias, target, 'blank alias' AS reason FROM alias_t WHERE trim(alias) = ''
      UNION ALL SELECT alias, target, 'unknown target' FROM alias_t WHERE target NOT IN (SELECT category FROM c)
      UNION ALL SELECT alias, target, 'alias is a category' FROM alias_t WHERE alias IN (SELECT category FROM c)""",
    "combined_requests": f"WITH {_REQUESTS} SELECT * FROM combined_t",
    "question_plan": f"""WITH {_REQUESTS},
      offset_t AS (SELECT *, coalesce(sum(requested) OVER (PARTITION BY request_id ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM combined_t)
      SELECT request_id, before + i + 1 AS position, category,
        CASE WHEN i % 2 = 0 THEN 'STYLE_SIMILAR' ELSE 'INDEPENDENT' END AS generation_mode
      FROM (SELECT *, unnest(generate_series(0, requested::BIGINT - 1)) AS i FROM offset_t)""",
    "question_bank_check": f"WITH {_BANK} SELECT id, row_no, array_to_string(errors, '; ') AS errors FROM bank_t",
    "canonical_categories": f"""WITH {_BANK} SELECT p_brand AS category, min(row_no) AS first_row, count(*) AS questions
      FROM good_t GROUP BY ALL""",
    "style_references": f"""WITH {_BANK} SELECT p_brand AS category, id AS historical_question_id, p_name AS question,
      p_size % 5 AS correct_answer FROM good_t
      QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY row_no) = 1""",
    "duplicate_candidates": """SELECT p_brand AS category, p_partkey AS position, p_name AS question,
      row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) > 1
        OR (p_brand, lower(p_name)) IN (SELECT (p_brand, lower(p_name)) FROM part WHERE p_retailprice < 905) AS duplicate
      FROM part""",
    "experiment_attempts": f"""WITH {_ATTEMPTS},
      r AS (SELECT position, bool_or(accepted) AS accepted, any_value(category) AS category FROM attempt_t GROUP BY position)
      SELECT position::VARCHAR AS source, category, 0 AS round, CASE position % 3 WHEN 0 THEN 'T' ELSE 'S' END AS target,
        attempt_number, accepted, 'q' AS question, NULL AS correct_answer_text, grounding_passed, true AS has_detail
      FROM attempt_t WHERE position % 3 < 2
      UNION ALL SELECT position::VARCHAR, category, 0, 'B', NULL, true, 'last', NULL, NULL, false FROM r
      WHERE position % 3 = 2 AND accepted""",
    "question_shapes": f"WITH {_ATTEMPTS}, {_SHAPED} SELECT shape, strategy, count(*) AS n FROM shape_t GROUP BY ALL",
    "strategy_counts": f"""WITH {_ATTEMPTS}, {_SHAPED}
      SELECT category AS target_group, strategy, accepted, count(*) AS attempts FROM shape_t GROUP BY ALL""",
    "attempts_saved": f"""WITH {_ATTEMPTS}, {_SHAPED},
      f AS (SELECT source, round, min(attempt_number) AS first FROM shape_t WHERE strategy = 'IDENTITY' GROUP BY ALL)
      SELECT (SELECT count(*) FROM f) AS rounds, count(*) AS attempts_saved
      FROM shape_t JOIN f USING (source, round) WHERE attempt_number < first""",
    "attempts_by_target": f"WITH {_ATTEMPTS}, {_SHAPED} SELECT * FROM rate_t",
    "ranked_candidates": f"""WITH {_ATTEMPTS}, {_SHAPED},
      s AS (SELECT *, least(identity_accepted, 3) * 2 + least(property_attempts - property_accepted, 4)
        + CASE WHEN identity_rate - property_rate >= 0.4 THEN 2 ELSE 0 END + CASE WHEN total_attempts >= 4 THEN 1 ELSE 0 END
        + CASE WHEN first_attempt_identity_count >= 1 THEN 1 ELSE 0 END
        - CASE WHEN identity_accepted = 0 THEN 2 ELSE 0 END AS candidate_score FROM rate_t)
      SELECT category, target, candidate_score, CASE WHEN candidate_score >= 6 AND identity_accepted >= 2
          AND total_attempts >= 4 THEN 'TIER_A_EXPERIMENT_CANDIDATE' WHEN candidate_score >= 3 THEN 'TIER_B_MONITOR'
          ELSE 'TIER_C_NOT_SUPPORTED' END AS status
      FROM s WHERE NOT (category = '1-URGENT' AND target = 'red widget')""",
    "condition_comparison": f"""WITH {_ATTEMPTS},
      r AS (SELECT position, generation_mode AS condition, bool_or(accepted) AS accepted, count(*) AS attempts,
        bool_or(attempt_number = 1 AND grounding_passed) AS aligned FROM cut_t GROUP BY ALL)
      SELECT condition, count(*) AS rounds, count(*) FILTER (accepted) AS accepted, sum(attempts) AS attempts,
        count(*) FILTER (aligned) AS aligned FROM r GROUP BY ALL""",
    "calls_per_profile": """SELECT unnest(['GENERATION', 'VALIDATION']) AS profile, unnest([n, 4 * n]) AS calls
      FROM (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "retry_summary": f"""WITH {_ATTEMPTS},
      r AS (SELECT any_value(category) AS validator, count(*) AS n, bool_or(accepted) AS recovered
        FROM cut_t GROUP BY position HAVING count(*) > 1)
      SELECT validator, count(*) AS operations, sum(n) AS attempts_made, round(avg(recovered::INT), 6) AS recovered_rate
      FROM r GROUP BY validator""",
}
ORACLES["duplicate_positions"] = f"""WITH d AS ({ORACLES['duplicate_candidates']})
  SELECT category, position, NOT duplicate AS accepted, duplicate::INT AS duplicates, duplicate AS exhausted FROM d"""
_TURNS = """WITH RECURSIVE try_t AS (
  SELECT p_brand AS category, p_partkey AS position, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, p_name, p_size, p_type
  FROM part),
text_t AS (
  SELECT category, position, (place - 1) * 3 + try_no AS step, try_no,
    CASE try_no WHEN 1 THEN 'In  ' || p_type WHEN 2 THEN 'size ' || p_size ELSE 'Of ' || p_name END AS question
  FROM try_t, (SELECT unnest([1, 2, 3]) AS try_no)),
known_t AS (SELECT p_brand AS category, list(DISTINCT 'of ' || lower(p_name)) AS seen FROM part WHERE p_size % 7 = 1 GROUP BY p_brand),
walk_t AS (
  SELECT DISTINCT t.category, 0::BIGINT AS step, coalesce(k.seen, []) AS seen, NULL::BIGINT AS position, 0 AS try_no, NULL::VARCHAR AS question,
    false AS made, false AS ended, false AS duplicate
  FROM text_t t LEFT JOIN known_t k USING (category)
  UNION ALL
  SELECT category, step, CASE WHEN made AND NOT duplicate THEN list_append(seen, norm) ELSE seen END, position, try_no, question,
    made, NOT (made AND duplicate), duplicate
  FROM (
    SELECT w.category, x.step, w.seen, x.position, x.try_no, x.question, lower(replace(x.question, '  ', ' ')) AS norm,
      x.try_no = 1 OR NOT w.ended AS made, list_contains(w.seen, lower(replace(x.question, '  ', ' '))) AS duplicate
    FROM walk_t w JOIN text_t x ON x.category = w.category AND x.step = w.step + 1))
"""
ORACLES["replaced_candidates"] = f"{_TURNS} SELECT category, position, try_no, question, duplicate FROM walk_t WHERE made"
ORACLES["replacement_budget"] = f"""{_TURNS} SELECT category, position, bool_or(NOT duplicate) AS accepted,
    count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (duplicate) > 2 AND NOT bool_or(NOT duplicate) AS exhausted
  FROM walk_t WHERE made GROUP BY ALL"""
