"""Lines whose names collide stay apart; similarities other than the default lose no pair."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from evidence_spark.llm import lines


def test_equal_names_are_not_enough():
    """Two different sets of one size with one 48-bit name, and a true copy."""
    name = 12 << 16 | 5
    made = {"h": [name] * 3, "d": [1, 2, 2], "before": [0] * 3, "bits": [0] * 3, "doc": [1, 2, 3], "start": [0] * 3, "size": [5] * 3, "rest": [lines._NAME] * 3}
    batch = lines._entries(np.zeros(3, np.int64), {k: np.array(v, np.int64) for k, v in made.items()})
    found = list(lines._settler(lines.SIMILARITY)([batch]))
    assert [r["doc"] for b in found for r in b.to_pylist()] == [3]


def test_second_hash_tells_sets_apart():
    sketch = np.zeros(1 << lines.SKETCH_BITS, np.uint16)
    texts = ["a b c d e", "e d c b a a", "a b c d f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = [lines._entry_columns(p) for b in lines._scanner(sketch, 4, lines.SIMILARITY)([batch]) for p in b.column(1).to_pylist()]
    second = {}
    for r in rows:
        for doc, d in zip(r["doc"], r["d"], strict=True):
            second.setdefault(doc, set()).add(d)
    assert all(len(d) == 1 for d in second.values()) and second[0] == second[1] != second[2]


def test_entries_come_back():
    rng = np.random.default_rng(3)
    low, high = -(1 << 63), (1 << 63) - 1
    made = {k: rng.integers(low, high, 50) for k in (*lines._RANDOM, *lines._PLAIN)}
    made["rest"][:20], made["rest"][20:30] = lines._GONE, lines._NAME
    bucket = rng.integers(0, 3, 50)
    batch = lines._entries(bucket, made)
    assert batch.column(0).to_pylist() == [0, 1, 2]
    for number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        back = lines._entry_columns(packed)
        assert sorted(zip(*(back[k] for k in made), strict=True)) == sorted(zip(*(made[k][bucket == number] for k in made), strict=True))


def test_lines_come_back_as_sets():
    sketch = np.zeros(1 << lines.SKETCH_BITS, np.uint16)
    texts = [b"a b c", b"c  b a b", "\u00e9 \u00e8".encode(), b"x " * 9000]
    columns = [pa.array([1, 0, 1, 1], pa.int32()), pa.array([7, 8, -7, 7]), pa.array([1, 2, 3, 4]), pa.array([0, 5, 6, 1], pa.int32()), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in lines._LINES.split(", ")])
    (packed,) = lines._line_packer([batch.slice(0, 2), batch.slice(2)])
    found = {}
    for piece in packed.column(1).to_pylist():
        places, sets = lines._line_sets(piece, sketch)
        found.update({(k, d, s): frozenset(t.tolist()) for k, d, s, t in zip(*places.tolist(), sets, strict=True)})
    assert {k: len(t) for k, t in found.items()} == {(7, 1, 0): 3, (8, 2, 5): 3, (-7, 3, 6): 2, (7, 4, 1): 1}
    assert found[7, 1, 0] == found[8, 2, 5]


@pytest.mark.parametrize("similarity", [Fraction(1, 2), Fraction(3, 4), Fraction(9, 10), Fraction(1)])
def test_other_similarities(spark, similarity):
    rng = random.Random(8)
    made = [(0, "a b c\na b c d"), (1, "a\na b\nb a")]
    made += [(i, "\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 12))) for _ in range(3))) for i in range(2, 30)]
    seen, wanted = [], {}
    for doc, text in made:
        gone = 0
        for line in text.split("\n"):
            words = frozenset(line.split())
            gone += any(Fraction(len(words & s), len(words | s)) >= similarity for s in seen)
            seen.append(words)
        wanted[doc] = gone
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    found = lines.remove_similar_lines(table, similarity=similarity).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == wanted
