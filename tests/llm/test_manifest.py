"""The manifest against a tree built in plain Python: nulls, repeated rows, one and many blocks, empty tables, clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, rank long, hash string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(level):
    paths, own = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, held = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for j in range(len(run)):
                for i in own[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            held.append(sum(own[a : a + 8], []))
        level, own = above, held
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    held = {}
    for lang in langs:
        mine = sorted(by[lang], key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4])))
        held[lang] = (mine, *tree([leaf(r, r[4]) for r in mine]))
    root, up = tree([held[x][1] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        mine, sub, paths = held[lang]
        for r, path in zip(mine, paths, strict=True):
            path, text = path + up[k], r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], leaf(r, r[4]), sub, root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 9, 600, 4700])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        lang = rng.choice([None, "en", "fr", ""]) if n < 4000 else "de" if i % 20 == 0 else "en"
        rows.append((i if i % 50 else None, rng.choice([None, "a", "bé"]), lang, rng.choice([None, i]), rng.choice([None, "", "Abc É", "x\ny Z"]), "g", 7, "h"))
    rows += rows[:3] + [(5, "other", "en", None, "long " * 50_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=str) == brute(rows)


def test_every_language_is_a_tree(spark):
    rows = [(i, None, f"l{i % 70}", i, "T", "g", 0, "h") for i in range(140)]
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_tampering_is_found_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "Text", "g", 0, "h") for i in range(20)], SCHEMA)
    found = manifest.manifest(docs, F.col("doc_id") == 4, F.lit("other")).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {4}
    assert {r["doc_id"] for r in manifest.manifest(docs, F.col("doc_id") == 4, F.col("text")).collect() if not r["verified"]} == set()
    assert manifest.manifest(docs.where("false")).count() == 0
