"""Rows without a doc_id, and doc_ids with several texts, against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from evidence_spark.llm import exact_dedup, language, lines, mixing, repeats, simhash
from evidence_spark.sources.tables import write_table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["ba", "du", "lo", "mi"]) + rng.choice(["ra", "to", "ne", "su"]) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null ids with texts of their own, copies with and without id, one id with two texts, ids above 2**53, a near copy."""
    rng = random.Random(11)
    texts = [words(rng, 120) for _ in range(30)]
    made = [(i, t) for i, t in enumerate(texts[:20])]
    made += [(None, texts[20]), (None, texts[21]), (None, texts[21]), (None, texts[3]), (None, None)]
    made += [(5, texts[22]), (5, texts[6]), (7, texts[23]), (7, texts[23])]
    made += [((1 << 53) + 1, texts[24]), (1 << 53, texts[24]), ((1 << 53) + 2, texts[25])]
    near = texts[8].split(" ")
    made += [(None, " ".join([*near[:-1], "end"])), (50, "\n".join([texts[26], texts[9], texts[26]]))]
    return made


def first_last(r):
    return (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())


def documents(rows):
    return sorted(set((d, t or "") for d, t in rows), key=first_last)


def test_pipeline_stages_choose_rows(spark, rows):
    docs = spark.createDataFrame([(d, t, "xx", f"src{i % 2}", 0) for i, (d, t) in enumerate(rows)], COLUMNS)
    docs = write_table(corpus_pipeline.language_id(spark, docs, ""), "language")
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == Counter(r for r in rows if r[1])
    best = {}
    for doc, text in got:
        best[text] = max([doc, best.get(text)], key=lambda d: (d is not None, d or 0))
    docs = write_table(corpus_pipeline.exact_copies(spark, docs, ""), "exact")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter((d, t) for t, d in best.items())

    held = sorted(((d, t) for t, d in best.items()), key=first_last)
    prints = simhash.fingerprints_of([t.encode() for _, t in held])
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.MAX_DISTANCE
    component = np.arange(len(held))
    for _ in held:
        component = np.where(near, component[None], len(held)).min(axis=1)
    wanted = [held[i] for i in np.flatnonzero(component == np.arange(len(held)))]
    docs = write_table(corpus_pipeline.near_copies(spark, docs, ""), "near")
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == Counter(wanted) and len(wanted) < len(held)  # the planted near copy, without an id, goes

    mixed = corpus_pipeline.mixture(spark, docs, "").collect()
    assert mixed and all(any(r["doc_id"] == d and set(r["text"].split()) <= set(t.split()) for d, t in wanted) for r in mixed)
    total = sum(len(t.split()) for _, t in wanted)
    assert abs(sum(len(r["text"].split()) for r in mixed) - mixing.SHARE * total) <= 2


def test_exact_groups(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    wanted = Counter()
    for g in groups.values():
        keep = max((d for d in g if d is not None), default=None)
        wanted.update((d, keep, len(g), None if d is None else d == keep) for d in g)
    for limit in (exact_dedup.TABLE_BYTES, 3000):
        found = exact_dedup.group_copies(table, table_bytes=limit, buckets=3).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == wanted


def test_repeats(spark, rows):
    seen, wanted = set(), {}
    for doc, text in documents(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        wanted[doc, text] = int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter((d, *wanted[d, t or ""]) for d, t in rows)


def test_lines(spark, rows):
    seen, wanted = [], {}
    for doc, text in documents(rows):
        kept = []
        for line in text.split("\n"):
            tokens = frozenset(line.split())
            gone = bool(tokens) and any(Fraction(len(tokens & s), len(tokens | s)) >= lines.SIMILARITY for s in seen)
            seen += [tokens] * bool(tokens)
            kept += [line] * (not gone)
        wanted[doc, text] = text.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    found = lines.remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in found) == Counter((d, *wanted[d, t or ""]) for d, t in rows)


def test_rows_without_id_take_part_in_learning(spark):
    docs = spark.createDataFrame([(None, "le mot du jour", "fr"), (None, "the word of it", "en")], "doc_id long, text string, lang string")
    assert language.train(docs.where(~language.is_held_out())).labels == ["en", "fr"]
