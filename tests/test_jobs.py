"""Sources, plans, acceptance, audits, metrics and experiment logs on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidence_spark.functions import prompts
from evidence_spark.operators import acceptance, analysis, audit, categories, metrics, numbering
from evidence_spark.sources import bank, experiments, pages, requests, sinks, tables


def test_numbering_is_exact_for_any_block(spark):
    rows = [("hot", i * 3) for i in range(200)] + [("cold", 5), ("cold", 1000)]
    df = spark.createDataFrame(rows, "g string, o long")
    expected = {("hot", i * 3, i + 1) for i in range(200)} | {("cold", 5, 1), ("cold", 1000, 2)}
    for block in (1, 7, 10_000):
        out = numbering.number_within(df, ["g"], "o", "n", block)
        assert {tuple(r) for r in out.select("g", "o", "n").collect()} == expected


def test_page_contract(spark):
    rows = [("a", 1, "x"), ("a", 2, " "), ("b", 1, "x"), ("b", 3, "y"), ("c", 1, " \xa0"), ("d", 1, "x"), ("d", 1, "y")]
    df = spark.createDataFrame(rows, "source_file string, page int, text string").withColumn("source_type", F.lit("P"))
    usable = {r.source_file: r.usable for r in pages.page_report(df).collect()}
    assert usable == {"a": True, "b": False, "c": False, "d": False}
    assert {r.source_file for r in pages.usable_pages(df).collect()} == {"a"}


def test_read_documents(spark, tmp_path):
    (tmp_path / "one.TXT").write_text("p1\fp2")
    (tmp_path / "book.txt").write_text("b")
    (tmp_path / "skip.md").write_text("m")
    got = pages.read_text_pages(spark, str(tmp_path), ".txt", "book.txt").collect()
    assert {tuple(r) for r in got} == {
        ("PRIMARY", "one.TXT", 1, "p1"),
        ("PRIMARY", "one.TXT", 2, "p2"),
        ("SECONDARY", "book.txt", 1, "b"),
    }
    listed = pages.list_documents(spark, str(tmp_path), ".txt", "book.txt").collect()
    assert {tuple(r) for r in listed} == {("one.TXT", "PRIMARY"), ("book.txt", "SECONDARY")}
    out = str(tmp_path / "table")
    spark.createDataFrame([("book.txt", 1, "b")], "source_file string, page int, text string").write.json(out)
    assert pages.read_page_table(spark, out, "json", "book.txt").first().source_type == "SECONDARY"


def test_question_bank(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text(
        "category,extra,id,question,answer1,answer2,answer3,answer4,correct_answer_id\n"
        "k,,3,q1,a,b,c,d,1\n,,,,,,,,\nk,,3,q2,a,b,c,d,2\nm,,0,q3,a,b,c,d,5\nm,,9,q4,a,b,c,d,4\n"
    )
    checked = bank.check_bank(bank.bank_rows(bank.read_bank_csv(spark, str(path))))
    errors = {r.row_no: r.errors for r in checked.collect()}
    assert errors == {
        2: [],
        4: ["id already used in row 2"],
        5: ["id must be a positive integer", "correct answer must be 1 to 4"],
        6: [],
    }
    good = checked.where(F.size("errors") == 0)
    assert {(r.category, r.first_row) for r in bank.canonical_categories(good).collect()} == {("k", 2), ("m", 6)}
    assert {r.reference.question for r in bank.style_references(good).collect()} == {"q1", "q4"}
    with pytest.raises(ValueError, match="missing columns: answer4"):
        bank.check_header([c for c in bank.REQUIRED if c != "answer4"])
    with pytest.raises(ValueError, match="more than once: id"):
        bank.check_header([*bank.REQUIRED, "id"])


def test_requests_resolution_and_plan(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"categories": {"B": 3, "A": 2, "beta": 1, "no": 1}}))
    rows = requests.request_rows(requests.read_requests(spark, str(tmp_path / "r.json")))
    assert {r.category for r in requests.check_request(rows).where(F.size("errors") > 0).collect()} == set()
    canonical = spark.createDataFrame([("A",), ("B",)], "category string")
    aliases = requests.alias_table(spark, {"beta": "B", "A": "B", "bad": "Z", "": "A"})
    reasons = {(r.alias, r.reason) for r in categories.alias_violations(aliases, canonical).collect()}
    assert reasons == {("A", "alias is a category"), ("bad", "unknown target"), ("", "blank alias")}
    resolved = categories.resolve_categories(rows, canonical, aliases)
    assert [r.category for r in categories.unknown_categories(resolved).collect()] == ["no"]
    combined = categories.combine_requests(resolved.where("canonical is not null"))
    for block in (2, 10_000):
        plan = categories.build_plan(combined, block).orderBy("position").collect()
        assert [(r.position, r.category) for r in plan] == list(enumerate("BBBBAA", 1))
        assert [r.generation_mode[0] for r in plan] == list("SISISI")


ATTEMPTS = "position long, attempt_number int, accepted boolean, category string"


def test_cut_outcomes_and_renumbering(spark):
    rows = [(1, 1, False, "a"), (1, 2, True, "a"), (1, 3, True, "a"), (2, 1, False, "a"), (2, 2, False, "a"),
            (2, 3, False, "a"), (2, 4, True, "a"), (5, 1, True, "b")]
    cut = acceptance.cut_at_acceptance(spark.createDataFrame(rows, ATTEMPTS))
    assert {(r.position, r.attempt_number) for r in cut.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (5, 1)}
    out = {r.position: (r.attempts, r.produced, r.final_attempt.attempt_number) for r in acceptance.outcomes(cut).collect()}
    assert out == {1: (2, True, 2), 2: (3, False, 3), 5: (1, True, 1)}
    accepted = cut.where("accepted").withColumn("exam_id", F.lit("e"))
    numbered = acceptance.renumber(accepted, block=2).collect()
    assert {(r.position, r.number) for r in numbered} == {(1, 1), (5, 2)}


def test_duplicates_with_a_hot_text(spark):
    rows = [("k", i, 1, " Same  TEXT" if i % 2 else "same text") for i in range(1, 41)]
    rows += [("k", 41, 1, "new"), ("k", 42, 1, "Old"), ("k", 42, 2, "old"), ("k", 42, 3, "OLD"), ("m", 1, 1, "same text")]
    made = spark.createDataFrame(rows, "category string, position long, try_no int, question string")
    existing = spark.createDataFrame([("k", "old ")], "category string, question string")
    flagged, positions = acceptance.control_duplicates(made, existing)
    fresh = {(r.category, r.position) for r in flagged.where(~F.col("duplicate")).collect()}
    assert fresh == {("k", 1), ("k", 41), ("m", 1)}
    last = positions.where("position = 42").first()
    assert not last.accepted and last.duplicates == 3 and last.exhausted
    assert not positions.where("position = 2").first().exhausted


def _in_turn(rows, known, budget):
    """Positions one after the other, as a loop over the questions makes them."""
    seen, out = set(known), {}
    for position in sorted({r[0] for r in rows}):
        out[position] = (False, 0)
        for _, _, text in sorted(r for r in rows if r[0] == position and r[1] <= budget + 1):
            if text not in seen:
                seen.add(text)
                out[position] = (True, out[position][1])
                break
            out[position] = (False, out[position][1] + 1)
    return out


def test_duplicate_budget_in_turn(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a"), (2, 3, "a"), (2, 4, "n"), (3, 1, "n"), (4, 1, "b"), (4, 2, "c"), (5, 1, "c"), (6, 1, "old"), (6, 2, "b")]
    made = spark.createDataFrame([("k", *r) for r in rows], "category string, position long, try_no int, question string")
    existing = spark.createDataFrame([("k", "old")], "category string, question string")
    _, positions = acceptance.control_duplicates(made, existing, max_replacements=2)
    got = {r.position: (r.accepted, r.duplicates) for r in positions.collect()}
    assert got == _in_turn(rows, {"old"}, 2)
    assert got[2] == (False, 3) and got[3] == (True, 0)


def test_long_chains_of_replacements_take_no_more_rounds(spark, monkeypatch):
    """Every position waits for the one before it; the tables written do not grow with the chain."""
    from evidence_spark.operators import graph

    rng = random.Random(6)
    written = []
    for module in (acceptance, graph):
        real = module.write_table
        monkeypatch.setattr(module, "write_table", lambda df, name, real=real: written.append(name) or real(df, name))
    counts = {}
    for n in (8, 64):
        chain = [(1, 1, "old"), (1, 2, "t1")] + [(i, k, f"t{i - 2 + k}") for i in range(2, n) for k in (1, 2)]
        chain += [(n + i, k, f"t{rng.randrange(n // 2)}") for i in range(20) for k in (1, 2, 3, 4)]
        made = spark.createDataFrame([(c, *r) for r in chain for c in ("k", None)], "category string, position long, try_no int, question string")
        existing = spark.createDataFrame([("k", "old"), (None, "old")], "category string, question string")
        written.clear()
        _, positions = acceptance.control_duplicates(made, existing if n == 8 else existing.where("category = 'k'"), max_replacements=2)
        got = {r.position: (r.accepted, r.duplicates) for r in positions.where("category = 'k'").collect()}
        assert got == _in_turn(chain, {"old"}, 2)
        assert positions.count() == 2 * len(got)
        counts[n] = len(written)
    assert counts[64] <= counts[8] + 12


def test_components(spark):
    from evidence_spark.operators.graph import connected

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(900, 900), (500, 501), (501, 500), (-5, 500)]
    edges += [(1000, x) for x in range(1001, 1100)]
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == least
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_requests_keep_what_cannot_be_read(spark, tmp_path):
    from evidence_spark.sources import requests

    (tmp_path / "a.json").write_text('{"categories": {"x": 1}}\n{"categories": \n')
    read = requests.read_requests(spark, str(tmp_path / "a.json"))
    assert requests.request_rows(read).count() == 1
    assert [r.error for r in requests.rejected_requests(read).collect()] == ["not JSON of a request"]
    (tmp_path / "b.json").write_text('{\n  "categories": {\n    "x": 1,\n    "y": 2\n  }\n}\n')
    assert requests.request_rows(requests.read_requests(spark, str(tmp_path / "b.json"), indented=True)).count() == 2


def test_summary_and_failures(spark):
    rows = [("e", 1, True), ("e", 2, False), ("f", 1, True), ("g", 2, True)]
    got = acceptance.run_summary(spark.createDataFrame(rows, "exam_id string, position long, accepted boolean"))
    assert {(r.exam_id, r.status, r.positions_complete) for r in got.collect()} == {
        ("e", "PARTIAL", True), ("f", "COMPLETE", True), ("g", "COMPLETE", False)}
    local = spark.createDataFrame([("InvalidGroundingOutputError", "m")], "failure_type string, message string")
    assert acceptance.assert_no_system_failure(local).first().scope == "QUESTION"
    system = spark.createDataFrame([("LLMError", "down")], "failure_type string, message string")
    with pytest.raises(Exception, match="system failure: LLMError: down"):
        acceptance.assert_no_system_failure(system).collect()


def test_reconciliation(spark):
    schema = "exam_id string, number long, position long, category string, question string, answers array<string>, correct_answer int, last_accepted boolean, planned_position long"
    base = [("e", n, n, "k", f"q{n}", list("abcd"), 1, True, n) for n in range(1, 6)]
    good = spark.createDataFrame(base, schema)
    assert audit.reconcile(good, good, good).count() == 0
    bent = [base[0], (*base[1][:5], list("abcx"), 1, True, 2), (*base[2][:6], 2, False, 3), (*base[3][:3], "z", "q9", *base[3][5:])]
    found = audit.reconcile(good, spark.createDataFrame(bent, schema), good)
    assert {r.number: r.mismatches for r in found.collect()} == {
        2: ["answers"], 3: ["correct answer", "last attempt not accepted"], 4: ["category", "question"],
        5: ["missing in production"]}
    failed = spark.createDataFrame([("e", 7, "k", "m")], "exam_id string, position long, category string, generation_mode string")
    other = spark.createDataFrame([("e", 7, "j", "m"), ("e", 8, "k", "m")], "exam_id string, planned_position long, category string, generation_mode string")
    assert {r.position: r.mismatches for r in audit.reconcile_failed(failed, other).collect()} == {
        7: ["category"], 8: ["missing in result"]}


def test_metrics_on_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "question_position long, attempt_number int, accepted boolean, grounding_passed boolean, mcq_valid boolean, category_valid boolean, quality_valid boolean")
    rates = metrics.acceptance_rates(empty).first()
    assert (rates.acceptance_rate, rates.first_attempt_rate) == (0.0, 0.0)
    assert tuple(metrics.attempts_per_accepted(empty).first()) == (0.0, 0.0, 0.0, 0.0, 0)
    assert metrics.exhaustion_rate(empty).first().exhaustion_rate == 0.0
    assert {r.rate for r in metrics.validator_failures(empty).collect()} == {0.0}
    assert analysis.by_target(spark.createDataFrame(
        [("k", "t", False, "PROPERTY", None, True, "s")],
        "category string, target string, accepted boolean, shape string, retrospective_order string, has_detail boolean, source string",
    )).first().identity_rate is None


def test_rate_rounding(spark):
    df = spark.createDataFrame([(1, 16), (1, 3), (1, 0), (2, 3)], "n int, d int")
    got = [r.r for r in df.select(analysis.rounded_rate(F.col("n"), F.col("d")).alias("r")).collect()]
    assert got == [0.062, 0.333, None, 0.667]


def test_experiment_logs_of_three_shapes(spark):
    detail = {"attempt_number": 2, "accepted": True, "question": "q", "correct_answer_text": "c",
              "validations": {"grounding": {"passed": False}}}
    logs = [
        ("a", {"k": [{"target": "T", "attempts": [detail, {"attempt_number": 1}]}]}),
        ("b", {"k": {"rounds": [{"selected_concept": "S", "attempts": 3, "accepted": True, "question": "z"}]}}),
        ("c", {"k": [{"selected_concept": "S", "attempts": 3, "accepted": False, "question": "z"}, {"attempts": [detail]}]}),
        ("d", {"k": [{"target": "", "selected_concept": "S", "attempts": [], "accepted": True, "question": "y"}], "m": 5}),
    ]
    df = spark.createDataFrame([(s, json.dumps(j)) for s, j in logs] + [("e", "{broken")], "source string, json string")
    got = {(r.source, r.target, r.attempt_number, r.accepted, r.question, r.grounding_passed, r.has_detail)
           for r in experiments.attempts_from_records(df).collect()}
    assert got == {
        ("a", "T", 2, True, "q", False, True),
        ("a", "T", 1, False, None, None, True),
        ("b", "S", None, True, "z", None, False),
        ("d", "S", None, True, "y", None, False),
    }
    assert set(experiments.union_logs([df, df.select("source")]).columns) == {"source", "json"}


def test_shapes_and_strategies(spark):
    rows = [
        ("which Valley is it", "Great Valley", "IDENTITY", "IDENTITY"),
        ("which is part of it", "Great Valley", "CLASSIFICATION_MEMBERSHIP", "PROPERTY"),
        ("what size", "Great Valley", "PROPERTY", "PROPERTY"),
        ("hm", "Great Valley", "OTHER_UNKNOWN", "OTHER/UNCLEAR"),
        ("is " + "x" * 40 + " is great", "Great Valley", "IDENTITY", "IDENTITY"),
        ("known as " + "x" * 31 + " valley", "Great Valley", "IDENTITY", "OTHER/UNCLEAR"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, q string, t string")
    shapes = {"membership": ["part of"], "copulas": ["is "], "naming": ["known as"], "properties": ["size"]}
    near = {"naming": ["known as"], "copulas": ["is ", "which "], "properties": ["size", "part of"]}
    got = df.select(
        "i", analysis.question_shape("q", "t", **shapes).alias("s"), analysis.strategy("q", "t", **near).alias("y")
    ).orderBy("i").collect()
    assert [(r.s, r.y) for r in got] == [r[2:] for r in rows]


def test_rendering_never_parses_inserted_text(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(prompts.fill("{a}-{b}", {"a": F.col("a"), "b": F.col("b")}).alias("t")).first().t == "{b}-x"
    for given in ({"a": F.col("a")}, {"a": F.col("a"), "b": F.col("b"), "c": F.col("b")}):
        with pytest.raises(ValueError):
            prompts.fill("{a}-{b}", given)


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([(1, "q", "a", "b", "c", "d", 1, "k", "hidden")], [*sinks.QUESTION_FIELDS, "note"])
    target = str(tmp_path / "out")
    sinks.write_bundle(q, q.select("number"), target)
    assert set(spark.read.json(f"{target}/questions").columns) == set(sinks.QUESTION_FIELDS)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_bundle(q, q, target)
    sinks.write_bundle(q.limit(0), q, target, force=True)
    empty = str(tmp_path / "empty")
    sinks.write_bundle(q.limit(0), q, empty)
    assert (tmp_path / "empty" / "audit").exists() and not (tmp_path / "empty" / "questions").exists()


def test_broadcast_needs_a_measured_size(spark):
    df = spark.range(10)
    assert tables.has_at_most(df, 10) and not tables.has_at_most(df, 9)
    big = tables.broadcast_checked(df, 9)._jdf.queryExecution().logical().toString()
    assert "merge" in big and "broadcast" not in big
    assert "broadcast" in tables.broadcast_checked(df, 10)._jdf.queryExecution().logical().toString()


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default=None):
            return self.value or default

    class Session:
        def __init__(self, master, value):
            self.conf = Conf(value)
            context = type("Context", (), {})()
            context.master, context.applicationId = master, "app"
            context.getConf = lambda: Conf(None)
            self.sparkContext = context

    assert tables.shared_folder(Session("spark://host", "hdfs://shared")) == "hdfs://shared"
    own = tables.shared_folder(Session("local[2]", None))
    assert own == tables.shared_folder(Session("local[2]", None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session("spark://host", None))


def test_report_is_one_table_and_its_sink_keeps_the_run(spark, tmp_path):
    rates = spark.createDataFrame([(4, 0.5, None)], "attempts int, rate double, missing double")
    kinds = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "category string, n long, complete boolean")
    report = metrics.evaluation_report("r1", {"attempts": (rates, None), "categories": (kinds, "category")})
    got = {tuple(r) for r in report.collect()}
    assert got == {
        ("r1", "attempts", None, "attempts", 4.0), ("r1", "attempts", None, "rate", 0.5),
        ("r1", "categories", "a", "n", 1.0), ("r1", "categories", "a", "complete", 1.0),
        ("r1", "categories", "b", "n", 2.0), ("r1", "categories", "b", "complete", 0.0),
    }
    sinks.write_report(report, {"top_k": "8"}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/report")).where("section = 'categories'").count() == 4
    run = spark.read.json(str(tmp_path / "out/run")).first()
    assert run.run_id == "r1" and run.config.top_k == "8" and "T" in run.generated_at
    with pytest.raises(FileExistsError):
        sinks.write_report(report, {}, str(tmp_path / "out"))
    sinks.write_report(report, {}, str(tmp_path / "out"), force=True)


def test_retrieval_of_several_runs_counts_once(spark):
    rows = [("r1", 1, 2, True), ("r2", 1, 2, True), ("r1", 2, 5, False), ("r3", 3, 1, True)]
    results = spark.createDataFrame(rows, "run_id string, query_id long, expected_chunks long, hit_at_3 boolean")
    assert {tuple(r) for r in metrics.combined_retrieval(results).collect()} == {(1, 2, True), (2, 5, False), (3, 1, True)}
    bent = results.union(spark.createDataFrame([("r2", 2, 5, True)], results.schema))
    with pytest.raises(Exception, match="runs disagree on query 2"):
        metrics.combined_retrieval(bent).collect()
