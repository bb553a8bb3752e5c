"""What many rows hold is sent once per run, and large groups are compared in bounded memory."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa

from evidence_spark.llm import lines, repeats


def runs(texts):
    return [pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])]


def entries(packed, settled):
    """Entries that meet in a bucket by their hash, and those that need no meeting."""
    met, done = [], []
    for batch in packed:
        for r in batch.to_pylist():
            for i, h in enumerate(r["h"]):
                (done if settled(r, i) else met).append((h, r["c"][i], r["doc"][i], r["start"][i], r["bucket"]))
    return met, done


def test_a_common_line_meets_once_per_run():
    sketch = np.zeros(1 << lines.SKETCH_BITS, np.uint16)
    scan = lines._scanner(sketch, 8, lines.SIMILARITY)
    met, done = [], []
    for batch in scan(runs(["a line that all rows hold"] * 500)):
        for bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = {k: v.tolist() for k, v in lines._entry_columns(packed).items()}
            for h, doc, start, rest in zip(*(found[k] for k in ("h", "doc", "start", "rest")), strict=True):
                (done if rest == lines._GONE else met).append((h, rest, doc, start, bucket))
    assert len(met) <= 4 and {d[2] for d in done} == set(range(1, 500))
    assert len({d[4] for d in done}) == 8  # dealt by document


def test_a_common_passage_meets_once_per_run():
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    scan = repeats._scanner(repeats.WINDOW, repeats.GRAM, 8)
    met, done = entries(scan(runs([text] * 500)), lambda r, i: r["settled"][i])
    assert len(met) == len({m[:2] for m in met}) and {m[2] for m in met} == {0}
    assert len({d[4] for d in done}) == 8 and {d[2] for d in done} == set(range(1, 500))


def test_large_groups_of_lines_hold_two_blocks():
    rng = np.random.default_rng(2)
    key, many = 7, 3000
    sets = [np.unique(np.append(rng.integers(1 << 20, 1 << 62, 12).astype(np.uint64), np.uint64(key))) for _ in range(many)]
    for j in range(100, many, 100):
        sets[j] = np.unique(np.append(sets[j - 50][:-1], np.uint64((1 << 62) + j)))  # 12 of 14 are shared
    tracemalloc.start()
    found = lines.later_matches(key, sets, Fraction(4, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == list(range(100, many, 100))
    assert peak < 150e6  # all blocks are 3000 * 36,000 * 4 bytes
