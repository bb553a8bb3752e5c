"""Rows without an id, repeated ids, vectors whose squares vanish or overflow, long domains: the operators that choose by id."""

import random

import numpy as np
import pytest

from evidence_spark.llm import mixing, personal_data, simhash, vectors


def test_fingerprints_without_an_id(spark):
    rows = [(None, "a b c d e"), (None, "A B C D E"), (None, None), (7, "x y z w"), (None, "x y z w"), (9, "x y z w"), (9, "lone text here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as node", "2 as rep", "3 as component_id")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["fingerprint"], []).append((r["doc_id"], r["component_id"]))
    prints = {t: f"{int(p):016x}" for t, p in zip(("a b c d e", "x y z w"), simhash.fingerprints_of([b"a b c d e", b"x y z w"]), strict=True)}
    assert by[prints["a b c d e"]] == [(None, None)] * 2
    assert sorted(by[prints["x y z w"]], key=str) == sorted([(7, 7), (9, 7), (None, 7)], key=str)
    lone = spark.createDataFrame([(None, "only text")], "doc_id long, text string")
    assert simhash.near_duplicates(lone).first()["component_id"] is None


def test_vectors_without_an_id_and_at_the_edge_of_doubles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i].tolist(), "a") for i in range(40)]
    rows += [(None, (base[3] * 2).tolist(), "a"), (None, rng.normal(size=8).tolist(), "b"), (None, None, "b"), (None, [0.0] * 8, "b")]
    rows += [(60, [1e-200] * 8, "c"), (61, [1e-190] * 8, "c"), (62, [1e200] * 8, "c"), (63, [5e-324] + [0.0] * 7, "c"), (64, [1.0] * 7, "c")]
    rows += [(60, base[5].tolist(), "a"), (70, (base[9] + 1e-9).tolist(), "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as rep", "2 as cell", "3 as copies", "4 as id")
    found = vectors.near_vectors(table).collect()
    assert len(found) == len(rows)

    def unit(v):
        v = np.array(v) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    sound = [i for i, r in enumerate(rows) if r[1] is not None and any(r[1])]
    linked = {i: [j for j in sound if j != i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit(rows[i][1]) @ unit(rows[j][1]) >= 0.98] for i in sound}

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        return min(ids, default=None)

    wanted = []
    for i, r in enumerate(rows):
        c = component(i) if i in linked else r[0]
        wanted.append((r[0], len(linked.get(i, ())), c, r[0] == c))
    assert sorted((tuple(r) for r in found), key=str) == sorted(wanted, key=str)
    assert next(r for r in found if r["vec_id"] == 61)["n_links"] == 2


def test_a_mix_of_repeated_ids_is_one_mix(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 400))), "a") for _ in range(30)]
    results = []
    for parts in (1, 3, 7):
        shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string, source string").repartition(parts)
        results.append(sorted(map(tuple, mixing.taken(mixing.mix(shuffled, block_words=8, shard_slots=16)).collect())))
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("text", ["a@b" + ".c" * 20_000, "a@" + "b" * 20_000 + ".de", "x" * 20_000 + "@y", "+1" + " 1" * 10_000])
def test_long_personal_data(spark, text):
    docs = spark.createDataFrame([(1, "mail " + text + " end"), (1, "mail " + text + " end")], "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as base")
    found = personal_data.digest(personal_data.find(docs)).collect()
    assert len(found) == 2 and found[0] == found[1]
    whole = "@" in text and "." in text
    assert found[0]["n_email"] == whole
    if whole:
        assert f"email:5:{5 + len(text)}" in found[0]["spans"]
