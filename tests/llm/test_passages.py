"""Passage removal against brute force: hot anchors, small automata, nulls, repeated rows, long texts, clashing columns, empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest

from evidence_spark.llm import passages

SCHEMA = "doc_id long, text string, h long, run long, role int, phrase string, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(t) if i not in gone)
        out.append((doc, len(t), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n, words=300):
    return [rng.choice("abcé") + str(rng.randrange(words)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (34, 35, 36, 60, 200)]
    line = prose(rng, 12)
    made = []
    for i in range(150):
        words = prose(rng, rng.choice([0, 3, 34, 35, 80, 300]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            passage = rng.choice(shared)
            cut = rng.randrange(len(passage)) if rng.random() < 0.4 else 0
            words[at:at] = passage[cut:]
        if i % 2:
            words += line + prose(rng, 40) + line  # a line that many documents have among different words
        if i % 9 == 0:
            words += ["the"] * rng.randrange(90) + ["la", "li"] * rng.randrange(60)
        made.append((i, rng.choice([" ", "\n", " \t\x0b", "  "]).join(words)))
    near = made[7][1].split()
    made += [(200, " ".join([*near[:50], "new", *near[50:]])), (201, made[11][1]), (201, made[11][1]), (None, made[13][1]), (None, None), (202, ""), (202, None)]
    made += [(203, " ".join(prose(rng, 40_000, 20_000))), (204, "x" * 300_000), (205, " \n ")]
    return [(*r, 1, 2, 3, "phrase", "kept") for r in made]


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 3, "shard": 40}, {"window": 12, "gram": 3, "hot": 20}, {"window": 8, "gram": 8}])
def test_passages(spark, rows, options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(passages.remove_passages(docs, **options)) == brute(rows, options.get("window", 35))


def test_runs_of_any_size_and_empty_table(spark, rows, monkeypatch):
    monkeypatch.setattr(passages, "RUN_BYTES", 500)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(passages.remove_passages(docs)) == brute(rows, 35)
    assert passages.remove_passages(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        passages.remove_passages(docs, window=50, gram=4)


def test_automata_find_every_occurrence_and_no_other():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(60)] for _ in range(20)]
    phrases = [t[i : i + n] for t in texts[:5] for i, n in ((3, 6), (10, 7), (20, 9))]
    for shard in (1, 20, 1000):
        cover = passages.Phrases(phrases, shard).cover(texts)
        expected = []
        for t in texts:
            gone = [False] * len(t)
            for p in phrases:
                for i in range(len(t) - len(p) + 1):
                    if t[i : i + len(p)] == p:
                        gone[i : i + len(p)] = [True] * len(p)
            expected += gone
        assert cover.tolist() == expected


def test_an_equal_hash_is_no_confirmation():
    first, second = (b" ".join(b"w%d" % (i + k) for i in range(36)) for k in (0, 100))
    assert passages.confirmed({1: [first, second]}, 35) == {}
    assert passages.confirmed({1: [first, first]}, 35) == {1: [first]}
    longer = first + b" more"
    assert passages.confirmed({1: [first], 2: [longer]}, 35) == {1: [first], 2: [first]}
