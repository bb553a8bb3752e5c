"""Concept extraction, repair, anchoring, identity and targets on hand-made evidence."""

from pyspark.sql import functions as F

from evidence_spark.operators import anchoring, concepts, identity, relations, targets


def make(spark, *texts, scope="s"):
    rows = [(scope, i + 1, f"c{i + 1}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "scope string, rank int, chunk_id string, text string")


def names(df):
    return [r.concept for r in df.orderBy("scope", "rank", "line_no").collect()]


def test_concept_lines_and_first_seen(spark):
    ev = make(
        spark,
        "Big Valley\nlower only\nX\nA B C D E F G\nΑlpha line\n  Red River (RR)  \nH2O and more, ok. Yes!",
        "BIG  VALLEY\nGrey Hill",
    )
    out = concepts.extract_concepts(ev)
    assert names(out) == ["Big Valley", "Red River (RR)", "Grey Hill"]
    reasons = {r.concept: r.extraction_reason for r in out.collect()}
    assert "2 words" in reasons["Big Valley"] and "3 words" in reasons["Red River (RR)"]


def test_context_is_cut_around_first_occurrence(spark):
    text = "x" * 200 + "\nMain Gate\n" + "y" * 200
    row = concepts.extract_concepts(make(spark, text)).first()
    assert row.factual_focus == "x" * 119 + "\nMain Gate\n" + "y" * 119


REPAIRS = [
    # a single capital on one neighbouring line completes the name; on both or none it is dropped
    ("M\nedial Band Tract", ["Medial Band Tract"]),
    ("edial Band Tract\nM", ["Medial Band Tract"]),
    ("M\nedial Band Tract\nL", []),
    ("edial Band Tract", []),
    # word ends on the lines above or below
    ("ia\ntum\nCorpos Str", ["Corpos Strtumia"]),
    ("Inter Nod\nes.", ["Inter Nodes"]),
    ("ia\nCorpos Str\num", []),
    ("Black P\na\nrs Ret (", []),
    ("Globe Pal\nlidus\nPutame\nn", ["Globe Pallidus", "Putamen"]),
    ("Whole Name\nText with öther words", ["Whole Name"]),
    # the first name fails on its brackets and spends the lines, so the second stays as it is
    ("Black P\na\nrs Ret (\nNSp.)", ["NSp.)"]),
]


def test_repairs(spark):
    cases = [(str(i), 1, f"c{i}", text) for i, (text, _) in enumerate(REPAIRS)]
    ev = spark.createDataFrame(cases, "scope string, rank int, chunk_id string, text string")
    got = {str(i): [] for i in range(len(REPAIRS))}
    for row in concepts.refine_concepts(ev).orderBy("line_no").collect():
        got[row.scope].append(row.concept)
    assert got == {str(i): expected for i, (_, expected) in enumerate(REPAIRS)}


def test_repair_bound_and_dedup_across_chunks(spark):
    long = "Long Na\n" + "\n".join("abcdefg")
    got = concepts.refine_concepts(make(spark, long, "Longg\nInter Nod\nes", "INTER  NODES"))
    assert names(got) == ["Long Naabcde", "Longg", "Inter Nodes"]


def test_source_lines_of_a_repair(spark):
    row = concepts.refine_concepts(make(spark, "öx\nInter Nod\nes\nö")).first()
    assert row.source_lines == [1, 2] and "word end restored" in row.extraction_reason


def test_naming_cue_drops_restatement(spark):
    ev = make(spark, "area, called\nThe Basal Set\n" + "ö" * 70 + "\nOther Item")
    assert names(concepts.refine_concepts(ev, naming_cues=["called"])) == ["Other Item"]


def lined(spark, cases, schema):
    """One row per case with its lines; ``cases`` are tuples that start with the text."""
    rows = [(str(i), i, f"c{i}", *case) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"scope string, rank int, chunk_id string, text string, {schema}")
    return anchoring.with_lines(df).orderBy("rank")


ANCHORS = [
    ("Solo Name", "Solo Name", [], "Solo Name"),
    ("nothing here", "Solo Name", [], "Solo Name"),
    ("öne\n\nMid Name\n\ntwö", "Mid Name", [], "öne\nMid Name\ntwö"),
    ("öne\n\n\nMid Name\n \n\ntwö", "Mid Name", [], "Mid Name"),
    ("öne\nOther Name\nä\nMid Name\nb ö\nThird Name\nö", "Mid Name", [], "ä\nMid Name\nb ö"),
    ("ö1\nö2\nö3\nö4\nMid Name\nä1\nä2\nä3\nä4", "Mid Name", [], "ö2\nö3\nö4\nMid Name\nä1\nä2\nä3"),
    ("ö\nM\nedial Band\nä", "Medial Band", [], "ö\nMedial Band\nä"),
    ("ö\nInter Nod\nes\nä", "Inter Nodes", [1, 2], "ö\nInter Nodes\nä"),
    ("Mid Name\n" + "\n".join(["", "ö"] * 10), "Mid Name", [], "Mid Name\nö\nö\nö"),
]


def test_anchor(spark):
    df = lined(spark, [c[:3] for c in ANCHORS], "concept string, at array<int>")
    out = df.select("rank", anchoring.anchor(F.col("concept"), F.col("at"), anchoring.NARROW).alias("a"))
    got = [r.a for r in out.orderBy("rank").collect()]
    assert got == [c[3] for c in ANCHORS]


def test_anchor_bounds(spark):
    few = "ö1\nö2\nö3\nö4\nMid Name\nä1"
    spaced = "Mid Name\n" + "\n".join(f"ö{i}\n" for i in range(20))
    df = lined(spark, [(few, "Mid Name"), (spaced, "Mid Name")], "concept string")
    none = F.array().cast("array<int>")
    out = df.select(
        "rank",
        anchoring.anchor(F.col("concept"), none, anchoring.BROAD).alias("broad"),
        anchoring.anchor(F.col("concept"), none, (30, 24)).alias("wide"),
    ).orderBy("rank").collect()
    assert out[0].broad == few
    assert len(out[1].wide.split("\n")) == 13  # 24 raw lines, every second one blank


ENUMERATIONS = [
    ("the following\nMid Name", True, True),
    ("the following\nMid Name\no", True, True),
    ("the following\nMid Name\nlies left", True, False),
    ("something\nMid Name", False, False),
    ("the following, no line", True, True),
]


def test_enumeration(spark):
    df = spark.createDataFrame([(i, c[0], "Mid Name") for i, c in enumerate(ENUMERATIONS)], "i int, f string, c string")
    rows = df.select(
        "i",
        anchoring.in_enumeration(F.col("f"), F.col("c")).alias("member"),
        anchoring.only_enumerated(F.col("f"), F.col("c")).alias("only"),
    ).orderBy("i").collect()
    assert [(r.member, r.only) for r in rows] == [c[1:] for c in ENUMERATIONS]


def test_entity_above(spark):
    cases = [("Upper Name\n" + "ö\n" * gap + "Low Name", "Low Name") for gap in (2, 5, 6)]
    out = lined(spark, cases, "concept string").select("rank", anchoring.entity_above(F.col("concept")).alias("e"))
    assert [r.e for r in out.orderBy("rank").collect()] == ["Upper Name", "Upper Name", None]


PAIRED = [
    ("Mid Name (שלום עולם)", "שלום עולם"),
    ("(שלום)\nMid Name", "שלום"),
    ("Mid Name\n(שלום)", "שלום"),
    ("Mid Name (שלום abc)", None),
    ("Mid Name (abc) (שלום)", None),
    ("Mid Name\nö\n(שלום)", None),
]


def test_paired_form(spark):
    df = lined(spark, [(c[0], "Mid Name") for c in PAIRED], "concept string")
    out = df.select("rank", identity.paired_form(F.col("bare"), F.col("concept")).alias("p"))
    assert [r.p for r in out.orderBy("rank").collect()] == [c[1] for c in PAIRED]


def test_forms_and_coverage(spark):
    df = anchoring.with_lines(make(spark, "Ｍid (NAME)\nA.B\n(שם)")).withColumn(
        "concept", F.explode(F.array(F.lit("Ｍid (NAME)"), F.lit("A.B")))
    )
    forms = {(r.concept, r.form) for r in identity.concept_forms(df).collect()}
    assert {("Ｍid (NAME)", "mid (name)"), ("Ｍid (NAME)", "ｍid name"), ("A.B", "a b"), ("A.B", "שם")} <= forms
    tested = spark.createDataFrame([("s", " a  B ")], "scope string, answer string")
    assert [r.concept for r in identity.untested(df, tested).collect()] == ["Ｍid (NAME)"]


def test_category_coverage_order(spark):
    rows = [
        ("k", 1, "what supplies it", " B "),
        ("k", 2, "where is it located in", "A"),
        ("k", 3, "supplies?", "B"),
        ("k", 4, "plain", " "),
    ]
    out = identity.category_coverage(
        spark.createDataFrame(rows, "category string, ord int, question string, answer string")
    ).first()
    assert out.tested_concepts == ["B", "A"] and out.tested_relationship_types == ["SUPPLIES", "LOCATED_IN"]


def test_plan_targets(spark):
    ev = make(
        spark,
        "the following\nFirst Name\no",
        "Upper Name\nö\nsource:\nSecond Name\nit lies lëft",
        "Lonely Name",
        "Tested Name\nhas tëxt",
        "Third Name\nsupplies the ärea",
    )
    tested = spark.createDataFrame([("s", "tested name")], "scope string, answer string")
    refined = concepts.refine_concepts(ev)
    out = targets.with_relationship(targets.plan_targets(refined, ev, tested, count=3, source_cues=["source"]))
    got = {r.target_id: r for r in out.collect()}
    assert [got[i].topic for i in (1, 2, 3)] == ["Upper Name", "Second Name", "Third Name"]
    assert got[2].source_role and got[2].source_entity == "Upper Name"
    assert got[3].relationship == "SUPPLIES" and not got[3].source_role
    rel = relations.discover_competitors(
        out, make(spark, "", "x supplies y", "no", "no", "Third Name supplies"), None
    ).collect()
    assert [(r.target_id, r.chunk_id) for r in rel] == [(3, "c2")]


def test_proximity_counts_every_occurrence(spark):
    ev = make(spark, "Great Valley supplies and supplies " + "q" * 90 + " supplies")
    con = spark.createDataFrame([("s", "Great Oak"), ("s", "An It")], "scope string, concept string")
    hits = relations.proximity_hits(con, ev).collect()
    assert len(hits) == 2 and {h.concept for h in hits} == {"Great Oak"}
    assert relations.mention_counts(con, ev).count() == 0
