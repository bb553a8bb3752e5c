"""Vectors of several lengths, and sources that differ behind their first bytes."""

import numpy as np

from evidence_spark.llm import sharding, vectors


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(12)
    made, number = [], 0
    for size, rows in ((8, 60), (6, 30), (3, 20), (1, 6)):
        base = rng.normal(size=(max(2, rows // 4), size))
        for i in range(rows):
            made.append((number, (base[i % len(base)] + rng.normal(size=size) * 0.03).tolist(), number % 2))
            number += 1
    found = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")).collect()}
    near = np.zeros((number, number), bool)
    for i, one, a in made:
        for j, two, b in made:
            if a == b and len(one) == len(two):
                near[i, j] = np.dot(one, two) / np.linalg.norm(one) / np.linalg.norm(two) >= 0.98
    component = np.arange(number)
    for _ in range(number):
        component = np.where(near, component[None], number).min(axis=1)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == {
        i: (near[i].sum() - 1, component[i], component[i] == i) for i in range(number)
    }
    assert near[60:90].sum() > 30  # a smaller group has links of its own


def test_sources_with_one_beginning_are_apart(spark):
    names = ["common_crawl_a", "common_crawl_b", "https://one.example", "https://two.example"]
    made = [(i, "word", "en", names[i % 4]) for i in range(400)]
    found = sharding.shard(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    places = {n: {r["hilbert"] for r in found if names[r["doc_id"] % 4] == n} for n in names}
    assert len(found) == 400
    assert all(not places[a] & places[b] for a in names for b in names if a < b)


def test_languages_and_sources_may_be_null(spark):
    made = [(i, "word", "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None) for i in range(60)]
    found = sharding.shard(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(60))
