"""What judging a response costs: no rule is evaluated outside generated code, no candidate's text travels unasked."""

from pyspark.sql import functions as F

from evidence_spark.functions.rules import failed_rules, filled
from evidence_spark.functions.text import is_blank
from evidence_spark.operators import responses


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_failed_rules_need_no_lambda(spark):
    rows = spark.createDataFrame([(1, "x"), (-1, " "), (None, None)], "n int, t string")
    found = rows.select("n", failed_rules({"n > 0": F.col("n") > 0, "t filled": filled("t")}).alias("errors"))
    assert "lambda" not in _plan(found)
    # a rule that is neither true nor false says nothing
    assert {r["n"]: r["errors"] for r in found.collect()} == {1: [], -1: ["n > 0", "t filled"], None: ["t filled"]}


def test_blank_texts(spark):
    texts = ["", " ", "　\t", "a", "~", "!", " a", "\x7f", "\x1f", "\x85", "é", "\U0001f600", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_blank("t").alias("b"))
    assert {r["t"]: r["b"] for r in rows.collect()} == {t: None if t is None else not t.strip() for t in texts}


def test_keys_that_read_like_a_schema_stay_unknown(spark):
    raw = ['{"valid":true,"reason":"r"}', '{"reason: STRING, valid":true}', '{"valid":true,"reason":"r","x":1}', '{"valid":1,"reason":"r"}', "[1]", "{"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    told = {r["i"]: r["errors"] for r in responses.ingest_verdicts(rows).collect()}
    column = responses.ingest_verdict_columns(rows, {"quality": "raw"}).select("i", "quality.errors")
    assert told == {r["i"]: r["errors"] for r in column.collect()}
    nested = "nested field unknown or of another type"
    assert told[0] == [] and "unknown field" in told[1] and told[2] == ["unknown field"] and nested in told[3] and nested not in told[2]
    assert "unknown field" in told[4] and told[5] == ["not JSON"]


def test_candidates_do_not_travel_for_a_verdict(spark):
    made = spark.sql("SELECT id AS position, IF(id < 2, named_struct('question', concat('q', id)), NULL) AS candidate, IF(id < 2, NULL, 'x') AS failure_type FROM range(3)")
    grounding = spark.sql("SELECT id AS position, true AS grounding_passed FROM range(3)")
    verdicts = spark.sql("SELECT id AS position, true AS structure, id <> 1 AS category, true AS quality FROM range(3)")
    textbook = spark.sql("SELECT id AS position, 'NOT_FOUND' AS textbook_status FROM range(3)")
    log = responses.assemble_attempts(made, grounding, verdicts, textbook, ["position"])
    assert log.columns == ["position", "candidate", "failure_type", "grounding_passed", "mcq_valid", "category_valid", "quality_valid", "textbook_status", "accepted"]
    verdict = log.select("position", "accepted")
    assert {r["position"]: r["accepted"] for r in verdict.collect()} == {0: True, 1: False, 2: False}
    joined = _plan(verdict).split("Join", 1)[1]
    assert "AS candidate" not in joined and "candidate#" not in joined
