"""Language of words in code-switched text: a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evidence_spark.llm.common import slices, texts_of, word_bounds

UNKNOWN = "und"
#: Labels that can be learned.
MAX_LABELS = 200
#: Training is fitted on about so many documents a language, and so many consecutive words of each.
SAMPLE_DOCUMENTS = 800
SAMPLE_WORDS = 64
#: Hashed features: affixes and n-grams share one table, words have the lexicon's.
FEATURE_BITS = 16
LEXICON_BITS = 15
LONGEST_GRAM = 4
EPOCHS = 5
#: Words per segment of the forward-backward pass.
SEGMENT = 32
_RUN_BYTES = 3 << 18
_BASE = np.uint64(0xFF51AFD7ED558CCD)
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM, _PREFIX, _SUFFIX = 1, 2, 3
#: Bytes of letters: A-Z, a-z and everything beyond ASCII.
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)], dtype=np.int64)


def _word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, one place of all words at a time."""
    out = np.zeros(len(starts), np.uint64)
    alive = np.arange(len(starts))
    place = 0
    while len(alive):
        alive = alive[starts[alive] + place < ends[alive]]
        if place >= 64:
            for i in alive.tolist():  # very long words are rare
                out[i] = xxhash.xxh64_intdigest(body[starts[i] : ends[i]].tobytes())
            break
        out[alive] = (out[alive] ^ _BYTE[body[starts[alive] + place]]) * _BASE
        place += 1
    return out ^ (out >> np.uint64(31))


def _features(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affix and n-gram features of words, and the word that each belongs to (in word order per kind)."""
    length = ends - starts
    found, owner = [], []
    shift = np.uint64(64 - FEATURE_BITS)

    def add(words: np.ndarray, at: np.ndarray, n: int, kind: int) -> None:
        packed = np.zeros(len(at), np.uint64)
        for k in range(n):
            packed = (packed << np.uint64(8)) | body[at + k].astype(np.uint64)
        salted = packed * np.uint64(16) + np.uint64(4 * kind + n - 1)
        found.append(((salted * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
        owner.append(words)

    for n in range(1, LONGEST_GRAM + 1):
        have = np.flatnonzero(length >= n)
        add(have, starts[have], n, _PREFIX)
        add(have, ends[have] - n, n, _SUFFIX)
        if n > 1:
            each = length[have] - n + 1
            words = np.repeat(have, each)
            at = starts[words] + (np.arange(len(words)) - np.repeat(np.cumsum(each) - each, each))
            add(words, at, n, _GRAM)
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class Model:
    """Label names, feature weights, lexicon vectors and their weight, transition scores."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weight: float
    moves: np.ndarray

    def scores(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Label scores of every word; equal words of the run are worked out once."""
        hashes = _word_hashes(body, starts, ends)
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        features, owner = _features(body, starts[first], ends[first])
        found = np.stack(
            [np.bincount(owner, self.weights[features, k], minlength=len(first)) for k in range(len(self.labels))], axis=1
        )
        found = found / np.maximum(1, np.bincount(owner, minlength=len(first)))[:, None] ** 0.5
        found += self.lexicon_weight * self.lexicon[_slot(hashes[first])]
        return found[place]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _BASE) >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)


def marginals(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior label shares of every word by forward-backward, for many sequences at once.

    Sequences are cut into segments.  All segments are multiplied out side by side, the segments' matrices are
    passed along each sequence, and vectors then run inside the segments: the same sums as one long pass.
    """
    labels = scores.shape[1]
    segments = -(-counts // SEGMENT)
    total = int(segments.sum())
    if not total:
        return np.zeros((0, labels))
    sequence = np.repeat(np.arange(len(counts)), segments)
    first_segment = np.cumsum(segments) - segments
    order = np.arange(total) - first_segment[sequence]
    first_word = (np.cumsum(counts) - counts)[sequence] + order * SEGMENT
    size = np.minimum(SEGMENT, counts[sequence] - order * SEGMENT)
    place = first_word[:, None] + np.arange(SEGMENT)
    valid = np.arange(SEGMENT) < size[:, None]
    place = np.where(valid, place, 0)
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))
    local = likely[place]
    jump = np.exp(moves)
    through = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(SEGMENT):
        on = valid[:, t]
        step = (through[on] @ jump) * local[on, t][:, None, :]
        through[on] = step / step.max(axis=(1, 2), keepdims=True)
    into = np.full((total, labels), 1.0)
    behind = np.full((total, labels), 1.0)
    longest = int(segments.max())
    for k in range(1, longest):
        at = first_segment[segments > k] + k
        moved = np.einsum("nl,nlm->nm", into[at - 1], through[at - 1])
        into[at] = moved / moved.max(axis=1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = first_segment[segments > k + 1] + k
        moved = np.einsum("nlm,nm->nl", through[at + 1], behind[at + 1])
        behind[at] = moved / moved.max(axis=1, keepdims=True)
    forward = np.empty((total, SEGMENT, labels))
    now = into
    for t in range(SEGMENT):
        step = (now @ jump) * local[:, t]
        step /= step.max(axis=1, keepdims=True)
        now = np.where(valid[:, t][:, None], step, now)
        forward[:, t] = now
    now = behind
    for t in range(SEGMENT - 1, -1, -1):
        forward[:, t] *= now
        step = (local[:, t] * now) @ jump.T
        step /= step.max(axis=1, keepdims=True)
        now = np.where(valid[:, t][:, None], step, now)
    found = forward[valid]
    return found / found.sum(axis=1, keepdims=True)


def _expected(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label shares of every word and expected moves, of sequences of equal length (n, length, labels)."""
    n, length, labels = scores.shape
    likely = np.exp(scores - scores.max(axis=2, keepdims=True))
    jump = np.exp(moves)
    ahead, behind = np.empty_like(likely), np.ones_like(likely)
    now = np.ones((n, labels))
    for t in range(length):
        now = (now @ jump) * likely[:, t]
        now /= now.max(axis=1, keepdims=True)
        ahead[:, t] = now
    for t in range(length - 2, -1, -1):
        now = (likely[:, t + 1] * behind[:, t + 1]) @ jump.T
        behind[:, t] = now / now.max(axis=1, keepdims=True)
    share = ahead * behind
    pair = ahead[:, :-1, :, None] * jump * (likely * behind)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return (share / share.sum(axis=2, keepdims=True)).reshape(-1, labels), pair.sum(axis=(0, 1))


def _fit(samples: list[tuple[int, bytes]], labels: list[str], lexicon: np.ndarray, seed: int = 3) -> Model:
    """Maximise the conditional likelihood of label sequences.

    Training sequences are code-switched: runs of 4 to 24 words of different sampled documents stand behind one another,
    half of the time of another language, so that transitions are learned with the emissions.
    """
    rng = np.random.default_rng(seed)
    count = len(labels)
    model = Model(labels, np.zeros((1 << FEATURE_BITS, count)), lexicon, 1.0, np.zeros((count, count)))
    texts = [t for _, t in samples]
    if count < 2 or not texts:
        return model
    truth = np.array([k for k, _ in samples])
    body = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    starts, ends, counts = word_bounds(body, offsets)
    first = np.cumsum(counts) - counts
    runs = []
    for i in rng.permutation(len(texts)).tolist():
        a = 0
        while a < counts[i]:
            n = int(rng.integers(4, 25))
            runs.append((first[i] + a, min(n, counts[i] - a), truth[i]))
            a += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    words = np.concatenate([np.arange(a, a + n) for a, n, _ in runs])
    named = np.concatenate([np.full(n, k) for _, n, k in runs])
    length = 48
    used = len(words) // length * length
    if not used:
        return model
    words, named = words[:used].reshape(-1, length), named[:used].reshape(-1, length)
    features, owner = _features(body, starts, ends)
    by_word = np.argsort(owner, kind="stable")
    features, owner = features[by_word], owner[by_word]
    begins = np.searchsorted(owner, np.arange(len(starts) + 1))
    number = np.diff(begins)
    lex = lexicon[_slot(_word_hashes(body, starts, ends))]
    speed_w, speed_m, speed_l = np.full_like(model.weights, 1e-3), np.full_like(model.moves, 1e-3), 1e-3
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(words)), max(1, len(words) // 128)):
            w, y = words[batch].reshape(-1), named[batch].reshape(-1)
            each = number[w]
            mine = np.repeat(np.arange(len(w)), each)
            at = features[begins[w][mine] + (np.arange(len(mine)) - (np.cumsum(each) - each)[mine])]
            root = np.maximum(1, each) ** 0.5
            plain = np.stack([np.bincount(mine, model.weights[at, k], minlength=len(w)) for k in range(count)], axis=1)
            scores = plain / root[:, None] + model.lexicon_weight * lex[w]
            share, expected = _expected(scores.reshape(len(batch), length, count), model.moves)
            error = share.copy()
            error[np.arange(len(y)), y] -= 1.0
            spread = (error / root[:, None])[mine]
            slope = np.stack([np.bincount(at, spread[:, k], minlength=1 << FEATURE_BITS) for k in range(count)], axis=1) / len(w)
            speed_w += slope**2
            model.weights -= 0.5 * slope / np.sqrt(speed_w)
            pull = float((error * lex[w]).sum()) / len(w)
            speed_l += pull**2
            model.lexicon_weight = max(0.05, model.lexicon_weight - 0.05 * pull / speed_l**0.5)
            seen = np.zeros_like(expected)
            z = y.reshape(len(batch), length)
            np.add.at(seen, (z[:, :-1].reshape(-1), z[:, 1:].reshape(-1)), 1)
            slope = (expected - seen) / len(w)
            speed_m += slope**2
            model.moves -= 0.1 * slope / np.sqrt(speed_m)
    model.weights = model.weights.astype(np.float32)
    return model


def _lexicon_counter(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((count, 1 << LEXICON_BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", _RUN_BYTES):
                body, offsets = texts_of(part.column(1))
                starts, ends, counts = word_bounds(body, offsets)
                label = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), counts)
                at = label * (1 << LEXICON_BITS) + _slot(_word_hashes(body, starts, ends))
                held += np.bincount(at, minlength=held.size).reshape(held.shape)
        label, slot = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(slot), pa.array(held[label, slot])], names=["label", "slot", "n"])

    return run


def _sampler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                listed = text.split()
                start = doc % max(1, len(listed) - words + 1)
                texts.append(" ".join(listed[start : start + words]).encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["label", "words"])

    return run


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learn from all rows of ``docs`` with a language and a text.

    The lexicon counts every word of every such row.  Feature and transition weights are fitted on a sample
    of about ``SAMPLE_DOCUMENTS`` rows a language (chosen by a hash of doc_id) and ``SAMPLE_WORDS`` words of each.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.lower(F.col(text).cast("string")).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))).alias("doc"),
    )
    found = known.groupBy("lang").count().limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    found.sort(key=lambda r: r["lang"])
    labels = [r["lang"] for r in found]
    if not labels:
        return Model([], np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((1 << LEXICON_BITS, 0)), 1.0, np.zeros((0, 0)))
    shares = [(r["lang"], i, min(1.0, SAMPLE_DOCUMENTS / r["count"])) for i, r in enumerate(found)]
    named = known.join(F.broadcast(spark.createDataFrame(shares, "lang string, label int, share double")), "lang")
    counted = (
        named.select("label", "text")
        .mapInArrow(_lexicon_counter(len(labels)), "label long, slot long, n long")
        .groupBy("label", "slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((1 << LEXICON_BITS, len(labels)))
    counts[counted["slot"], counted["label"]] = counted["n"]
    log = np.log(counts + 0.1) - np.log(counts.sum(axis=0) + 1.0)
    lexicon = log - log.mean(axis=1, keepdims=True)
    lexicon[counts.sum(axis=1) == 0] = 0.0
    lexicon = np.clip(lexicon, -4, 4)
    chosen = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = named.where(chosen).select("label", "text", "doc").mapInArrow(_sampler(SAMPLE_WORDS), "label int, words binary").toPandas()
    sample = sample.sort_values(["label", "words"], kind="stable")
    return _fit(list(zip(sample["label"].tolist(), sample["words"].tolist(), strict=True)), labels, lexicon.astype(np.float32))


def starts_and_ends(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Alternating bounds for ``reduceat``; the last end is left out."""
    return np.stack([starts, ends], axis=1).reshape(-1)[:-1]


def _labeller(model: Model, with_runs: bool):
    names = [*model.labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _RUN_BYTES):
                body, offsets = texts_of(part.column(0))
                starts, ends, counts = word_bounds(body, offsets)
                share = np.zeros((len(counts), len(names)))
                best = np.zeros(len(starts), np.int64)
                if len(starts):
                    found = marginals(model.scores(body, starts, ends), counts, model.moves)
                    best = found.argmax(axis=1)
                    owner = np.repeat(np.arange(len(counts)), counts)
                    letters = np.add.reduceat(_LETTER[body], starts_and_ends(starts, ends))[::2] > 0
                    weight = np.where(letters, 1.0, 1e-6)  # numbers and marks decide only where nothing else is
                    for k in range(len(names)):
                        share[:, k] = np.bincount(owner, found[:, k] * weight, minlength=len(counts))
                    share /= np.maximum(1e-9, share.sum(axis=1, keepdims=True))
                top = share.argmax(axis=1)
                columns = [
                    pa.array([names[k] for k in top], pa.string()),
                    pa.array(np.clip(share[np.arange(len(top)), top], 0.0, 1.0)),
                ]
                if with_runs:
                    first = np.cumsum(counts) - counts
                    runs = []
                    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
                        mine = best[a : a + n]
                        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if n else np.zeros(0, int)
                        tails = np.append(heads[1:], n) if n else heads
                        runs.append([{"first": int(x), "end": int(z), "lang": names[mine[x]]} for x, z in zip(heads, tails, strict=True)])
                    columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in kept), *columns],
                    names=[*kept, "_lang", "_score", *["runs"] * with_runs],
                )

    return run


def label(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None, with_runs: bool = False) -> DataFrame:
    """The ``keep`` columns with (lang_pred, score) and, on request, ``runs``: word ranges of one language.

    A document's shares are the mean of the label shares of its words with letters; the largest wins (ties: the first label).
    ``und`` with score 0 if the text is null or holds no letter, or if nothing was learned.
    Every row is labelled on its own; repeated rows get the same.
    """
    raw = F.col(text).cast("string")
    held = [F.lower(F.coalesce(raw, F.lit(""))).alias("text"), F.coalesce(raw.rlike("\\p{L}"), F.lit(False)).alias("_letters")]
    rows = docs.select(*held, *(keep or [F.col(c) for c in docs.columns if c != text]))
    names = [c for c in rows.columns if c not in ("text", "_letters")]
    if not model.labels:
        return rows.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shape = rows.drop("text").select("*", F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema
    if with_runs:
        run = T.StructType().add("first", "long").add("end", "long").add("lang", "string")
        shape = shape.add("runs", T.ArrayType(run))
    found = rows.mapInArrow(_labeller(model, with_runs), shape)
    return found.select(
        *names,
        F.when(F.col("_letters"), F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.col("_score")).otherwise(0.0).alias("score"),
        *["runs"] * with_runs,
    )


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Every third document, by checksum of its id, takes no part in learning; one without an id does."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("long").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
