"""Checks on candidates, responses and their folding."""

from pyspark.sql import functions as F

from evidence_spark.functions import checks, rules
from evidence_spark.operators import responses


def failure(spark, rows):
    """rows: refs, mode, claimed, answers, correct, topic, named, source_role, entity"""
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, refs array<int>, mode string, claimed long, answers array<string>, correct int, topic string, "
        "named boolean, source_role boolean, entity string",
    )
    target = {"topic": "topic", "named_entity": "named", "source_role": "source_role", "source_entity": "entity"}
    out = df.select(
        "i",
        checks.first_failure(
            "refs", F.lit(3), "mode", "claimed", F.lit(7).cast("long"), "answers", "correct", target
        ).alias("f"),
    )
    return [r.f for r in out.orderBy("i").collect()]


def test_first_failure(spark):
    good = ["Mid Name", "other", "third", "last"]
    base = ([1, 3], "STYLE_SIMILAR", 7, good, 1, "mid  NAME", True, False, None)

    def changed(**changes):
        names = ("refs", "mode", "claimed", "answers", "correct", "topic", "named", "source_role", "entity")
        return tuple(changes.get(n, v) for n, v in zip(names, base))

    hebrew = "שם"
    cases = [
        (base, None),
        (changed(refs=[]), None),
        (changed(refs=[0]), "evidence reference out of range"),
        (changed(refs=[-1]), "evidence reference out of range"),
        (changed(refs=[1, 4]), "evidence reference out of range"),
        (changed(claimed=None), None),
        (changed(claimed=8), "style reference not supplied"),
        (changed(mode="INDEPENDENT"), "style reference not supplied"),
        (changed(mode="INDEPENDENT", claimed=None), None),
        (changed(source_role=True, entity="name"), "answer names the downstream entity"),
        (changed(source_role=True), None),
        (changed(source_role=False, entity="name"), None),
        (changed(answers=["Mid Name", "the mid name here", "c", "d"]), "answer and distractor overlap"),
        (changed(answers=["Mid Name", "mid", "c", "d"]), "answer and distractor overlap"),
        (changed(answers=["Mid Name", "mid", "c", "d"], named=False), None),
        (changed(answers=["Some", "b", "c", "d"]), "answer does not name the target"),
        (changed(answers=[f"Mid Name {hebrew}", "x", "y", "z"]), "answer mixes languages"),
        (changed(answers=[hebrew, "b", "c", "d"], topic=hebrew), None),
    ]
    assert failure(spark, [c for c, _ in cases]) == [f for _, f in cases]


def test_numbered_answers(spark):
    df = spark.createDataFrame(
        [(0, ["1. a", "b", "c", "d"]), (1, ["1. a", " 2) b", "c", "d"]), (2, ["2:1 ratio", "3:1 ratio", "c", "d"])],
        "i int, a array<string>",
    )
    got = [r.n for r in df.select("i", checks.numbered_answers("a").alias("n")).orderBy("i").collect()]
    assert got == [None, [1, 2], None]


def test_references_and_folding(spark):
    df = spark.createDataFrame([([1, 1, 3], ["a", "b", "c"])], "refs array<int>, ids array<string>")
    row = df.select(
        checks.resolve_refs("refs", "ids").alias("once"), checks.resolve_refs("refs", "ids", False).alias("all")
    ).first()
    assert row.once == ["a", "c"] and row["all"] == ["a", "a", "c"]
    schema = "a array<struct<answer_index:int,supported_as_correct:boolean,evidence_refs:array<int>>>, correct int"
    assessed = [
        ([(2, True, [3, 1]), (1, False, [2]), (4, False, []), (3, False, [])], 2),
        ([(2, True, [3]), (1, True, [1, 3]), (4, False, []), (3, False, [])], 2),
        ([(1, False, []), (2, False, []), (3, False, []), (3, False, [])], 2),
    ]
    out = spark.createDataFrame(assessed, schema).select(
        checks.assessments_complete("a").alias("whole"),
        checks.fold_assessments("a", "correct", F.array(*map(F.lit, "xyz"))).alias("f"),
    ).collect()
    assert [r.whole for r in out] == [True, True, False]
    assert tuple(out[0].f) == (True, True, ["z", "x"])
    assert tuple(out[1].f) == (True, False, ["x", "z"])
    assert tuple(out[2].f)[:2] == (False, True)


def test_acceptance_and_outcome(spark):
    rows = [(True, True, True, True, s) for s in rules.TEXTBOOK_STATUSES] + [(True, False, True, True, "CONSISTENT")]
    df = spark.createDataFrame(rows, "g boolean, m boolean, c boolean, q boolean, t string")
    assert [r.a for r in df.select(checks.accepted("g", "m", "c", "q", "t").alias("a")).collect()] == [
        True,
        True,
        False,
        False,
    ]
    parts = [("c", "v", None, None), (None, None, "f", "m"), ("c", "v", "f", "m"), ("c", None, None, None), (None,) * 4]
    df = spark.createDataFrame(parts, "c string, v string, f string, m string")
    got = [r.o for r in df.select(checks.one_outcome("c", "v", "f", "m").alias("o")).collect()]
    assert got == [True, True, False, False, False]


def test_row_rules(spark):
    df = spark.createDataFrame([("x", 1, ["a", "b", "c", "d"]), (" \xa0", 0, ["a", "", "c", "d"]), (None, None, None)], "s string, n int, a array<string>")
    checked = rules.check_rows(
        df, {"s": rules.filled("s"), "n": rules.positive("n"), "a": rules.four_answers("a"), "c": rules.answer_number("n")}
    )
    good, bad = rules.split_checked(checked)
    assert good.count() == 1 and [r.errors for r in bad.collect()] == [["s", "n", "a", "c"]] * 2


def test_malformed_and_invalid_verdicts(spark):
    raw = ['{"valid": true, "reason": "r"}', '{"valid": true', '{"valid": true, "reason": " "}', '{"valid": true, "reason": "r", "x": 1}', "[1]"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = [r.status for r in responses.ingest_verdicts(df).orderBy("i").collect()]
    assert got == ["OK", "MALFORMED", "DOMAIN_INVALID", "DOMAIN_INVALID", "DOMAIN_INVALID"]


def test_verdict_contract_by_check(spark):
    rows = [
        ("structure", '{"valid": true, "reason": "r"}', "DOMAIN_INVALID"),
        ("structure", '{"valid": true, "exactly_four_answers": true, "single_best_answer": false, "reason": "r"}', "OK"),
        ("structure", '{"valid": true, "exactly_four_answers": "true", "single_best_answer": true, "reason": "r"}', "DOMAIN_INVALID"),
        ("category", '{"valid": false, "requested_category": "a", "assessed_category": "b", "reason": "r"}', "OK"),
        ("category", '{"valid": true, "requested_category": "a", "assessed_category": " ", "reason": "r"}', "DOMAIN_INVALID"),
        ("category", '{"valid": true, "requested_category": "a", "assessed_category": null, "reason": "r"}', "OK"),
        ("other", '{"valid": true, "reason": "r"}', "DOMAIN_INVALID"),
    ]
    got = responses.ingest_verdicts(spark.createDataFrame(rows, "check string, raw string, want string")).collect()
    assert [r.status for r in got] == [r.want for r in got]
    assert [r.valid for r in got] == [None, True, None, False, None, True, None]


def test_provenance_and_nested_fields_fail_closed(spark):
    refs = ["[1, 2]", '["PRIMARY:a:0001"]', "[1, null]", "null", "[3]", "[]", '"1"', "[1.5]"]
    raw = ['{"status": "NOT_FOUND", "evidence_refs": %s, "reason": "r"}' % x for x in refs]
    raw += ['{"status": "NOT_FOUND", "reason": "r"}', '{"status": "NOT_FOUND", "reason": 5}']
    df = spark.createDataFrame([(i, r, ["x", "y"], [1, 2]) for i, r in enumerate(raw)], "i int, raw string, chunk_ids array<string>, pages array<int>")
    good = [r.i for r in responses.ingest_textbook(df).orderBy("i").collect() if r.status == "OK"]
    assert good == [0, 5, 8]
    part = '{"answer_index": %d, "supported_as_correct": %s, "evidence_refs": [1], "reason": "r"%s}'
    whole = '{"grounded": true, "answer_assessments": [%s], "reason": "r", "confidence": 1, "evidence_text": null}'
    many = [
        whole % ", ".join(part % (i, "true" if i == 1 else "false", extra if i == 2 else "") for i in range(1, 5))
        for extra in ("", ', "note": 1', ', "note": null')
    ]
    df = spark.createDataFrame([(i, r, ["x"], 1) for i, r in enumerate(many)], "i int, raw string, chunk_ids array<string>, correct_answer int")
    got = responses.ingest_grounding(df).orderBy("i").collect()
    assert [r.status for r in got] == ["OK", "DOMAIN_INVALID", "DOMAIN_INVALID"] and got[0].grounding_passed


def test_plan_statuses_count_every_response(spark):
    raw = ['{"targets": [{"topic": "t", "factual_focus": "f", "evidence_refs": [1]}]}', '{"targets": [{"topic": "t", "factual_focus": "f", "evidence_refs": [9]}]}', "{"]
    df = spark.createDataFrame([(i, "c", 2, ["x"], r) for i, r in enumerate(raw)], "scope int, category string, count int, chunk_ids array<string>, raw string")
    got = responses.plan_statuses(df).orderBy("scope").collect()
    assert [(r.status, r.targets) for r in got] == [("OK", 1), ("DOMAIN_INVALID", 0), ("MALFORMED", 0)]
    assert responses.ingest_plans(df).count() == 1


def test_contract_shapes(spark):
    """Fields in any order, absent and null ones, numbers too large for their type, keys that imitate a schema."""
    part = '{"answer_index": %s, "supported_as_correct": true, "evidence_refs": [1], "reason": "r"}'
    whole = '{"reason": "r", %s"answer_assessments": [%s], "grounded": true, "confidence": %s}'
    four = ", ".join(part % i for i in (4, 2, 3, 1))
    raw = [
        whole % ("", four, "1"),
        whole % ("", four, "0.25"),
        whole % ("", four, "1e-3"),
        whole % ('"evidence_text": null, ', four, "0"),
        whole % ('"evidence_text": "t", ', four, "0"),
        whole % ('"evidence_text": 3, ', four, "0"),
        whole % ("", four, '"1"'),
        whole % ("", four, "null"),
        whole % ("", four.replace('"reason": "r"', '"reason": null', 1), "1"),
        whole % ("", four.replace("4", "4.0", 1), "1"),
        whole % ("", four.replace("4", "4294967300", 1), "1"),
        whole % ("", four.replace("[1]", "[]", 1), "1"),
        whole % ("", four + ", null", "1"),
        whole % ('"a: STRING, grounded": true, ', four, "1"),
        "null",
        '"text"',
        "",
        None,
    ]
    df = spark.createDataFrame([(i, r, ["x"], 1) for i, r in enumerate(raw)], "i int, raw string, chunk_ids array<string>, correct_answer int")
    got = [r.status for r in responses.ingest_grounding(df).orderBy("i").collect()]
    ok, bad, mal = "OK", "DOMAIN_INVALID", "MALFORMED"
    assert got == [ok] * 5 + [bad] * 6 + [ok] + [bad] * 4 + [mal] * 2


def test_verdict_columns_are_the_long_verdicts(spark):
    good, cut = '{"valid": true, "reason": "r"}', '{"valid": true'
    full = '{"valid": true, "exactly_four_answers": true, "single_best_answer": true, "reason": "r"}'
    rows = [(1, full, good), (2, good, good), (3, full, cut), (4, None, '{"valid": false, "reason": "r"}')]
    df = spark.createDataFrame(rows, "k int, s string, q string")
    wide = responses.ingest_verdict_columns(df, {"structure": "s", "quality": "q"})
    assert wide.columns == ["k", "structure", "quality"]
    got = {(r.k, c, r[c].status, r[c].valid, tuple(r[c].errors)) for r in wide.collect() for c in ("structure", "quality")}
    long = df.selectExpr("k", "stack(2, 'structure', s, 'quality', q) as (check, raw)")
    assert got == {(r.k, r.check, r.status, r.valid, tuple(r.errors)) for r in responses.ingest_verdicts(long).collect()}
