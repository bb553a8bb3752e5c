"""The audit against filters run one after the other in plain Python, and its contractions against loops."""

import random
import re
from itertools import permutations, product

import numpy as np

from evidence_spark.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, code int, n long, good boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefgh") + (str(rng.randrange(400)) if i % 3 else "") for _ in range(rng.choice([0, 5, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "#", " É ", " ABCDEFGH " * 9])
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    rows += [(rng.randrange(400), rng.choice(rows)[1], rng.choice(["en", "fr", None])) for _ in range(60)]
    rows += [(None, rows[0][1], "en"), (None, None, "en"), (500, None, "fr"), (501, "", None), (501, "", None), (502, "A" * 200_000, "xx")]
    labels = [(rng.randrange(200), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1), (502, 1, 0), (502, 0, 1)]
    return rows, labels


def fails(rows):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, _ in rows:
        text = text or ""
        words = WORDS.findall(text)
        yield {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and doc > least[text],
        }


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    flags = list(fails(rows))
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, flags, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, now in enumerate(order, 1):
                gone = [m for m in left if m[1][now]]
                left = [m for m in left if not m[1][now]]
                shapley[now] += len(gone)
                failing = sum(m[1][now] for m in mine)
                unique = sum(m[1][now] and sum(m[1].values()) == 1 for m in mine)
                lost = [sum(m[0] in s for m in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, "clash", 1, 2, True) for r in rows], SCHEMA).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, known).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in found} == brute(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(docs.where("false"), known).count() == 0
    nobody = filter_audit.audit(docs, known.where("false")).selectExpr("sum(good_lost) + sum(toxic_lost)").first()[0]
    assert nobody == 0


def test_contractions_are_sums_over_the_selected_cells():
    tensor = np.random.default_rng(2).integers(0, 9, (3, 2, 2, 2, 2, 2))
    plan = filter_audit.Plan()
    for figure, selectors in plan.selectors.items():
        got = plan.contract(tensor, figure)
        for row in (0, 7, 333, 599):
            cells = [c for c in product((0, 1), repeat=5) if all(selectors[row][a][v] for a, v in enumerate(c))]
            assert got[:, row].tolist() == [int(sum(tensor[(z, *c)] for c in cells)) for z in range(3)]
