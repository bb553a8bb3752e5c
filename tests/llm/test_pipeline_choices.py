"""What the pipeline's stages drop: letterless texts, exact copies and planted near copies, against brute force."""

import random

import numpy as np

import corpus_pipeline
from evidence_spark.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nothing_learned_drops_nothing(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 0), (2, None, None, "s", 0), (3, "12", None, "s", 0)], COLUMNS)
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, 2, 3}
    held_out = spark.createDataFrame([(i, "some words", "en" if i in (1, 4) else None, "s", 0) for i in range(9)], COLUMNS)
    assert corpus_pipeline.language_id(spark, held_out, "").count() == 9


def test_languages_reject_only_letterless_texts(spark):
    texts = {1: "the word of the day", 2: "le mot du jour", 3: "qqq zzz", 4: "123 456", 5: "", 6: None, 7: "it is a day", 8: "7é"}
    lang = {1: "en", 2: "fr", 7: "en"}
    made = [(i, t, lang.get(i), "s", 0) for i, t in texts.items()]
    found = corpus_pipeline.language_id(spark, spark.createDataFrame(made, COLUMNS), "")
    assert {r["doc_id"] for r in found.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}


def test_planted_near_copies(spark):
    rng = random.Random(21)
    made = []
    for i in range(12):
        listed = [f"w{rng.randrange(500)}" for _ in range(300)]
        made += [(10 * i, listed), (10 * i + 1, [*listed[:-1], "end"]), (10 * i + 2, [*listed[:150], "mid", *listed[150:]])]
    prints = simhash.fingerprints_of([" ".join(w).encode() for _, w in made])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.MAX_DISTANCE
    component = np.arange(len(made))
    for _ in made:
        component = np.where(near, component[None], len(made)).min(axis=1)
    wanted = {made[i][0] for i in np.flatnonzero(component == np.arange(len(made)))}
    docs = spark.createDataFrame([(d, " ".join(w), "xx", "s", 0) for d, w in made], COLUMNS).repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == wanted
    assert len(wanted) < len(made)
