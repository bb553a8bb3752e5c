"""Every operator against a brute-force version, on nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from evidence_spark.llm import exact_dedup, language, lines, mixing, packing, personal_data, repeats, sharding, simhash, vectors
from evidence_spark.llm.queries import VOCABULARY

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passages = [prose(rng, 40) for _ in range(4)]
    made = []
    for i in range(90):
        text = prose(rng, rng.randint(0, 50)) + rng.choice([" ", "\n", "  "]) + rng.choice(passages)[rng.randint(0, 40) :]
        if i % 7 == 0:
            text += " The" * rng.randint(10, 90)
        if i % 11 == 0 and made:
            text = rng.choice(made)[1]
        made.append((i, text, "en" if i % 2 else "fr", None if i % 10 == 0 else f"src{i % 3}"))
    made += [(200, None, None, None), (201, "", "en", "src1"), (202, "x" * 4000, "en", "src1"), (203, "Ab  c\t" * 3000, "fr", "src0")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.selectExpr("*", "'extra' as component_id", "0 as size", "null as h").repartition(4).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repeats(docs, rows, empty):
    seen, wanted = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            part = raw[i : i + 100]
            if part in seen:
                gone[i : i + 100] = True
            seen.add(part)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        wanted[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    for hot in (2048, 2):
        found = repeats.remove_repeats(docs, hot=hot, index_bytes=9000)
        assert by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == wanted
    assert repeats.remove_repeats(empty).count() == 0


def test_run_length_index_rows_are_sorted_suffixes():
    texts = [b"abracadabra", b"abra", b"", b"cadabra"]
    index = repeats.RunLengthIndex(texts)
    held = {}
    for k, (text, row, match) in enumerate(index.stream(20), start=1):
        held |= {int(r): (texts[t][len(texts[t]) - k :], int(m)) for t, r, m in zip(text, row, match, strict=True)}
    ordered = [held[r][0] for r in sorted(held)]
    assert ordered == sorted(ordered)
    for before, now in zip(sorted(held), sorted(held)[1:], strict=False):
        a, (b, m) = held[before][0], held[now]
        assert m == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m=m, d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda m=m, d=digits: 9 <= len(d) <= 15,
            }[kind]
            if good():
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(spark):
    rng = random.Random(8)
    made = [(i, "".join(rng.choice("aZ9.%+-@@ ..-+45()\né12367890 ") for _ in range(90))) for i in range(300)]
    made += [(400 + i, "".join(rng.choice("4111111111111111 --9") for _ in range(rng.randint(12, 40)))) for i in range(300)]
    made += [(900, None), (901, ""), (902, "call (415) 555-2671, joe (at) site (dot) com"), (903, "é😀 a@b.co 4111 1111-1111 1111 10.0.0.1")]
    found = by_id(personal_data.digest(personal_data.find(spark.createDataFrame(made, "doc_id long, text string"))), "base_sha256", "spans", "n_email")
    for doc, text in made:
        base = list(base_spans(text))
        assert found[doc][0] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[doc][1].split(",")) | {""}
        assert found[doc][2] == sum(s.startswith("email") for s in base)
    assert personal_data.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forward_backward_and_language(spark, docs, empty):
    rng = np.random.default_rng(0)
    scores, moves, counts = rng.normal(size=(90, 3)), rng.normal(size=(3, 3)), np.array([70, 0, 20])
    found = language.marginals(scores, counts, moves)
    for low, n in ((0, 70), (70, 20)):
        ahead, back = np.zeros((n, 3)), np.ones((n, 3))
        now = np.ones(3)
        for t in range(n):
            now = (now @ np.exp(moves)) * np.exp(scores[low + t])
            ahead[t] = now = now / now.sum()
        for t in range(n - 2, -1, -1):
            back[t] = np.exp(moves) @ (np.exp(scores[low + t + 1]) * back[t + 1])
            back[t] /= back[t].sum()
        share = ahead * back
        assert np.allclose(found[low : low + n], share / share.sum(axis=1, keepdims=True))
    text = {"aa": "bada gadu lamo bidu ", "zz": "striçk plønkt qwerz "}
    made = [(i, text["aa" if i % 2 else "zz"] * 9, "aa" if i % 2 else "zz") for i in range(80)]
    made += [(900, None, "aa"), (901, "12 34 !!", "zz"), (902, text["aa"] * 3, None)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(table.where(~language.is_held_out()))
    labelled = by_id(language.label(table, model, with_runs=True), "lang_pred", "score", "lang")
    assert all(labelled[i][0] == labelled[i][2] for i in range(80))
    assert [labelled[i][0] for i in (900, 901, 902)] == ["und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s, _ in labelled.values())
    switched = spark.createDataFrame([(1, text["aa"] * 4 + text["zz"] * 4)], "doc_id long, text string")
    assert {r["lang"] for r in language.label(switched, model, with_runs=True).first()["runs"]} == {"aa", "zz"}
    assert language.label(empty.select("doc_id", "text"), language.train(empty)).count() == 0


def test_exact_dedup(spark, docs, rows, empty):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc)
    wanted = {
        d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g
    }
    for limit in (exact_dedup.TABLE_BYTES, 3000):  # the small table spills and needs more levels
        found = exact_dedup.group_copies(docs, table_bytes=limit, buckets=3)
        assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == wanted
    assert exact_dedup.group_copies(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    made = [(i, (base[i % 40] + rng.normal(size=8) * 0.05).tolist(), i % 3) for i in range(300)]
    made += [(i, made[i - 300][1], made[i - 300][2]) for i in range(300, 330)]
    made += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, made[0][1], None), (404, [1.0, 2.0], 0), (405, [None] + [1.0] * 7, 0)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    rows = np.array([m[1] for m in made[:330]])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    label = np.array([m[2] for m in made[:330]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    component = np.arange(330)
    for _ in range(330):
        component = np.where(near, component[None], 10**9).min(axis=1)
    for i in range(330):
        assert (found[i]["n_links"], found[i]["component_id"]) == (near[i].sum() - 1, component[i])
    assert all((found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True) for i in range(400, 406))
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY[0])
    ids = {r[0]: whole.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    made = packing.pack(docs, VOCABULARY).collect()
    for doc, listed in ids.items():
        at = 0
        for k, p in enumerate(sorted((r for r in made if r["doc_id"] == doc), key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 2048)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(listed[p["start"] : at], "<u4").tobytes())
        assert at == len(listed)
    sequences = {}
    for p in made:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_packing_plan_is_whole_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 101, rng.integers(1, 400)), minlength=101) * (1 + 5 * (seed % 2))
    plan = packing.plan(counts, 100)
    ends = np.append(plan.first[1:], counts.sum())
    lengths = np.repeat(np.arange(101), counts)
    used = {}
    for first, end, sequence, offset in zip(plan.first, ends, plan.sequence, plan.offset, strict=True):
        for k in range(first, end):
            used.setdefault(sequence + k - first, []).append((offset, int(lengths[k])))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert sum(map(len, used.values())) == counts.sum()
    assert len(used) == plan.sequences <= 1.06 * -(-(counts @ np.arange(101)) // 100) + 1


def test_sharding(docs, rows, empty):
    made = sharding.shard(docs).collect()
    assert len(made) == len(rows)
    slots = {}
    for r in made:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in made)
    assert sharding.shard(empty).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_lines(spark, empty):
    rng = random.Random(6)
    made = []
    for i in range(60):
        listed = []
        for _ in range(rng.randint(0, 5)):
            line = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 14))]
            if made and rng.random() < 0.5:
                line = rng.choice((rng.choice(made)[1] or "").split("\n")).split(" ")
                line[rng.randrange(len(line))] = f"w{rng.randrange(40)}"
            listed.append(" ".join(line))
        made.append((i, "\n".join(listed) if i % 20 else None))
    seen, wanted = [], {}
    for doc, text in made:
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(WORDS.findall(line))
            gone = bool(words) and any(Fraction(len(words & s), len(words | s)) >= lines.SIMILARITY for s in seen)
            if words:
                seen.append(words)
            if not gone:
                kept.append(line)
        count = len((text or "").split("\n"))
        wanted[doc] = (count, count - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert by_id(lines.remove_similar_lines(table), "n_lines", "n_removed", "kept_sha256") == wanted
    assert lines.remove_similar_lines(empty).count() == 0


def test_mixing(docs, rows, empty):
    mixed = mixing.mix(docs, block_words=8, shard_slots=64)
    made = mixing.taken(mixed).collect()
    sizes = {r[0]: len(WORDS.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    whole = [sum(n for d, n in sizes.items() if source[d] == s) for s in names]
    wanted = mixing.targets(whole, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))])
    assert abs(sum(wanted) - 1.5 * sum(whole)) < 1e-6
    assert {r["doc_id"]: r["size"] for r in made} == sizes and len(made) == len(rows)
    for name, n, target in zip(names, whole, wanted, strict=True):
        mine = [r for r in made if source[r["doc_id"]] == name]
        assert all(r["source_size"] == n and abs(r["target"] - target) < 1e-6 and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(docs, block_words=8, shard_slots=64)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in made}
    shown = mixing.mixed_documents(docs, mixed).collect()
    words = {}
    for r in shown:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORDS.findall(r["text"]))
    assert words == {d: t for d, t in again.items() if t}
    assert mixing.taken(mixing.mix(empty)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_round_trip(n):
    made = mixing.Permutation(n, 77)
    image = made(np.arange(n))
    assert sorted(image) == list(range(n))
    assert all(made.inverse(int(v)) == i for i, v in enumerate(image))


def fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    found = by_id(simhash.near_duplicates(docs, shard_size=8), "fingerprint", "component_id")
    assert {d: f for d, (f, _) in found.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    label = {d: d for d in prints}
    for _ in prints:
        label = {d: min(label[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 2) for d in prints}
    assert {d: c for d, (_, c) in found.items()} == label
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_shards_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    points = np.unique(centres[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    table = spark.createDataFrame([(int(np.int64(p.view(np.int64))), i) for i, p in enumerate(points)], "fp long, rep long")
    dealt = simhash.shards(table, 2, 64).toPandas()
    own = dict(zip(dealt[dealt.own].rep, dealt[dealt.own].node, strict=True))
    assert len(own) == len(points) == int(dealt.own.sum())
    at = set(zip(dealt.rep, dealt.node, strict=True))
    for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 2), strict=True):
        assert (i, own[j]) in at or (j, own[i]) in at
