"""Removal of passages that recur, by repeated-phrase automata.

1. Documents are packed into runs of about a megabyte, written once.  The least gram of a window of ``WINDOW`` words is its anchor; windows
   with one anchor form a segment, and equal windows have equal anchors.  A run sends the hashes of its segments.
2. Anchors that occur once hold no recurring window.  Of the others, each different segment's words are fetched from two of its places.
3. Recurring passages are confirmed word by word: a segment that has two places, and in a segment the windows that another segment of
   its anchor has too.  An anchor with more than ``HOT`` segments is dealt out again by its single windows.
4. A run gets the confirmed phrases of its segments, compiles them into Aho-Corasick automata of bounded size and streams its documents
   through them: every occurrence is located in the words themselves, and its words are removed.
"""

from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from evidence_spark.llm.common import partitions, slices, texts_of
from evidence_spark.sources.tables import write_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 35
#: Words of an anchor; a segment has at most WINDOW - GRAM + 1 windows, which fit the low bits of its hash.
GRAM = 8
#: Different segments of one anchor that are compared in one place.
HOT = 512
#: Text of a run, and words of the phrases in one automaton.
RUN_BYTES = 1 << 20
SHARD_WORDS = 200_000
_LOW = 31
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)


# Runs


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=6)
    for batch in batches:
        for part in slices(batch, "text", RUN_BYTES):
            body, offsets = texts_of(part.column(1))
            whole = np.diff(offsets).astype(np.int64).tobytes() + body.tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
            packed = pa.array([codec.compress(whole, asbytes=True) if whole else b""], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(whole)], pa.int64()), packed], names=["ids", "size", "packed"])


def _unpacked(n: int, size: int, packed: bytes) -> list[bytes]:
    whole = pa.Codec("zstd").decompress(packed, decompressed_size=size, asbytes=True)
    ends = 8 * n + np.cumsum(np.frombuffer(whole, np.int64, n))
    return [whole[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def runs_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(run, n, ids, size, packed): the documents in runs; ``bytes.split`` cuts words where the contract does."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(_packer, "ids array<long>, size long, packed binary")
    return write_table(packed.withColumn("n", F.size("ids")).withColumn("run", F.monotonically_increasing_id()), "runs")


# Segments


class _Sums:
    """Hashes of any stretches of ``values`` from running sums."""

    def __init__(self, values: np.ndarray):
        up, down = (np.full(len(values) + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts] * _MIX
        x ^= x >> np.uint64(32)
        return x * _MIX


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in every ``width`` neighbours."""
    place, held, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        left, right = slice(None, len(held) - step), slice(step, None)
        take = held[right] < held[left]
        place, held = np.where(take, place[right], place[left]), np.where(take, held[right], held[left])
        span += step
    return place


def segments(texts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first word) of all segments; the low bits of a segment's hash are its number of windows."""
    counts = np.array([len(t) for t in texts], np.int64)
    total = int(counts.sum())
    none = np.zeros(0, np.int64)
    if total < window:
        return none, none, none
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, total)
    both = b"".join(xxhash.xxh3_128_digest(w) for w in number)
    hashes = np.frombuffer(both, np.uint64).reshape(-1, 2)[words]
    ends = np.cumsum(counts)
    edge = np.zeros(total + 1, np.int64)
    long = counts >= window
    np.add.at(edge, (ends - counts)[long], 1)
    np.add.at(edge, (ends - window + 1)[long], -1)
    valid = np.cumsum(edge)[: total - window + 1] > 0
    low = _Sums(hashes[:, 0])
    at = np.arange(total - gram + 1)
    grams = low.of(at, at + gram)
    anchor = np.where(valid, _first_least(grams, window - gram + 1), -1)
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(heads, len(anchor)))
    real = anchor[heads] >= 0
    heads, n = heads[real], n[real]
    content = _Sums(hashes[:, 1]).of(heads, heads + n + window - 1)
    content = (content & ~np.uint64(_LOW)) | n.astype(np.uint64)
    return grams[anchor[heads]].view(np.int64), content.view(np.int64), heads


_ENTRY = "h long, c long, run long, at int, again int"


def _scanner(window: int, gram: int):
    """Every run's different segments: the first place, and the second or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                texts = [t.split() for t in _unpacked(one["n"], one["size"], one["packed"])]
                h, c, at = segments(texts, window, gram)
                if not len(h):
                    continue
                order = np.lexsort((at, c, h))
                h, c, at = h[order], c[order], at[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                first = np.flatnonzero(new)
                second = np.minimum(first + 1, len(h) - 1)
                again = np.where(new[second], -1, at[second])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[first]), pa.array(c[first]), pa.array(np.full(len(first), one["run"], np.int64)),
                        pa.array(at[first].astype(np.int32)), pa.array(again.astype(np.int32)),
                    ],
                    names=["h", "c", "run", "at", "again"],
                )

    return run


# Candidates

#: What a row is for: a segment's words, the words of its single windows, a run that holds the segment.
_WORDS, _WINDOWS, _HOLDER = 1, 2, 3


def wanted(entries: DataFrame, hot: int) -> DataFrame:
    """(h, c, run, at, role, twice) of the anchors that occur more than once; all is counted in one exchange by anchor, which spills.

    A segment of a hot anchor that has two places gets a key of its own; each different one is also dealt out by its windows.
    """
    anchor, segment = Window.partitionBy("h"), Window.partitionBy("h", "c")
    places = 1 + F.when(F.col("again") >= 0, 1).otherwise(0)
    counted = (
        entries.withColumn("rank", F.row_number().over(segment.orderBy("run")))
        .withColumn("inside", F.first("again").over(segment.orderBy("run")) >= 0)
        .withColumn("twice", F.sum(places).over(segment) > 1)
        .withColumn("kind", F.dense_rank().over(anchor.orderBy("c")))
        .withColumn("total", F.sum(places).over(anchor))
        .where("total > 1")
        .withColumn("spread", F.max("kind").over(anchor) > hot)
    )
    key = F.when(F.col("spread"), F.xxhash64("h", "c")).otherwise(F.col("h"))
    whole, first = F.col("twice") | ~F.col("spread"), F.col("rank") == 1

    def row(when, role: int, at="at", h=key):
        return F.when(when, F.struct(h.alias("h"), "c", "run", F.col(at).alias("at"), F.lit(role).alias("role"), "twice"))

    roles = F.array(
        row(whole, _HOLDER),
        row(whole & (first | ((F.col("rank") == 2) & ~F.col("inside"))), _WORDS),
        row(whole & first & (F.col("again") >= 0), _WORDS, "again"),
        row(first & F.col("spread"), _WINDOWS, h=F.col("h")),
    )
    return counted.select(F.explode(F.array_compact(roles)).alias("r")).select("r.*")


# Confirmation

_FETCHED = "h long, c long, run long, role int, text binary, twice boolean"


def _fetcher(window: int):
    """Per run, its wanted segments and then its documents: the words of the segments, and the windows of those to be spread."""

    def work(run: int, rows: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        words = list(chain.from_iterable(t.split() for t in texts))
        out, single = [], {}
        for h, c, at, role, twice in rows:
            n = c & _LOW
            if role == _WORDS:
                out.append((h, c, run, role, b" ".join(words[at : at + n + window - 1]), twice))
            else:
                for i in range(at, at + n):
                    text = b" ".join(words[i : i + window])
                    single[text] = twice or text in single
        for text, twice in single.items():
            out.append((xxhash.xxh3_64_intdigest(text) - (1 << 63), 0, run, _WINDOWS, text, twice))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["h", "c", "run", "role", "text", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for run, n, size, packed, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if packed is None:
                    rows.append(row)
                elif rows:
                    yield work(run, rows, _unpacked(n, size, packed))
                    rows = []

    return run


def confirmed(found: dict[int, list[bytes]], window: int) -> dict[int, list[bytes]]:
    """The phrases of an anchor's segments: maximal stretches of windows that occur twice; the words decide."""
    kinds = [(c, text, texts.count(text) > 1) for c, texts in found.items() for text in dict.fromkeys(texts)]
    phrases: dict[int, list[bytes]] = {}
    if len(kinds) == 1:
        c, text, twice = kinds[0]
        return {c: [text]} if twice else {}
    held: dict[bytes, int] = defaultdict(int)
    cut = []
    for c, text, twice in kinds:
        words = text.split(b" ")
        windows = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
        for w in windows:
            held[w] += 2 if twice else 1
        cut.append((c, words, windows))
    for c, words, windows in cut:
        begin = None
        for i, w in enumerate([*windows, None]):
            if w is not None and held[w] > 1:
                begin = i if begin is None else begin
            elif begin is not None:
                phrases.setdefault(c, []).append(b" ".join(words[begin : i + window - 1]))
                begin = None
    return phrases


def _confirmer(window: int):
    """Rows sorted by key and role, words first: a key's words are held, its holders are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, phrases, waiting = None, {}, None, {}
        for batch in batches:
            out = []
            for h, c, run, role, text, twice in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if h != key:
                    key, found, phrases, waiting = h, {}, None, {}
                if role == _WORDS:
                    found.setdefault(c, []).append(text)
                elif role == _WINDOWS:
                    first = waiting.pop(text, run if twice else -1)
                    if first == -1:  # the first one waits for a second
                        waiting[text] = run
                        continue
                    out += [(r, text) for r in {first, run} if r is not None]
                    waiting[text] = None
                else:
                    phrases = confirmed(found, window) if phrases is None else phrases
                    out += [(run, p) for p in phrases.get(c, ())]
            if out:
                runs, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(texts, pa.binary())], names=["run", "phrase"])

    return run


# Location


class Phrases:
    """Aho-Corasick automata of word phrases.

    A word is spelled with two letters, one of each of two alphabets of about the square root of the vocabulary, so that nodes stay
    narrow; a word of no phrase is spelled with letters that no phrase has.  An automaton holds about ``shard`` words.
    """

    _HIGH, _LOW = 0x10000, 0x80000

    def __init__(self, phrases: list[list[bytes]], shard: int = SHARD_WORDS):
        known = dict.fromkeys(chain.from_iterable(phrases))
        base = max(1, int(np.ceil(np.sqrt(len(known)))))
        self.spelling = {w: chr(self._HIGH + i // base) + chr(self._LOW + i % base) for i, w in enumerate(known)}
        self.phrases, self.shard = phrases, shard

    def spelled(self, words: list[bytes]) -> str:
        of = self.spelling.get
        return "".join([of(w, "..") for w in words])

    def automata(self) -> Iterator[ahocorasick.Automaton]:
        """One after the other, so that one is held at a time."""
        begin = 0
        while begin < len(self.phrases):
            made, size = ahocorasick.Automaton(), 0
            while begin < len(self.phrases) and (not size or size + len(self.phrases[begin]) <= self.shard):
                phrase = self.phrases[begin]
                made.add_word(self.spelled(phrase), len(phrase))
                size += len(phrase)
                begin += 1
            made.make_automaton()
            yield made

    def cover(self, texts: list[list[bytes]]) -> np.ndarray:
        """Which words of the texts, end to end, lie in an occurrence of a phrase; occurrences do not cross texts."""
        spelled = [self.spelled(t) for t in texts]
        edge = np.zeros(sum(map(len, texts)) + 1, np.int64)
        for automaton in self.automata():
            starts, ends, before = [], [], 0
            for text in spelled:
                for last, n in automaton.iter(text):
                    end = before + (last + 1) // 2
                    starts.append(end - n)
                    ends.append(end)
                before += len(text) // 2
            np.add.at(edge, np.array(starts, np.int64), 1)
            np.add.at(edge, np.array(ends, np.int64), -1)
        return np.cumsum(edge)[:-1] > 0


def _locator(shard: int):
    """Per run, its phrases and then its documents."""

    def work(ids: list[int | None], texts: list[bytes], phrases: dict[bytes, None]) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        gone = Phrases([p.split(b" ") for p in phrases], shard).cover(words) if phrases else np.zeros(sum(map(len, words)), bool)
        ends = np.cumsum([len(w) for w in words])
        rows = []
        for doc, own, end in zip(ids, words, ends.tolist(), strict=True):
            mine = gone[end - len(own) : end]
            removed = int(mine.sum())
            kept = b" ".join([w for w, x in zip(own, mine.tolist(), strict=True) if not x] if removed else own)
            rows.append((doc, len(own), removed, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: dict[bytes, None] = {}
        for batch in batches:
            for _, n, size, packed, ids, phrase in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if packed is None:
                    phrases[phrase] = None
                else:
                    yield work(ids, _unpacked(n, size, packed), phrases)
                    phrases = {}

    return run


def remove_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row per input row.

    A word goes if a window of ``window`` words over it also starts anywhere else, in the same document or another one; windows are judged on
    the input.  Words are separated by spaces and bytes 0x09 to 0x0D.  Null is the empty text.  Every row is a document of its own: rows
    that repeat a text, with or without the same doc_id, lose the windows that they share.  ``kept`` are the remaining words, joined by one space.
    """
    if not 0 < gram <= window or window - gram + 1 > _LOW:
        raise ValueError(f"a segment of {window - gram + 1} windows does not fit; raise gram")
    tasks = partitions(docs.sparkSession)
    runs = runs_of(docs, doc_id, text)
    entries = runs.select("run", "n", "size", "packed").mapInArrow(_scanner(window, gram), _ENTRY)
    rows = write_table(wanted(entries, hot), "wanted")

    def missing(frame: DataFrame, *columns: str) -> list:
        return [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in columns]

    held = runs.select("run", "n", "size", "packed", *missing(rows, "h", "c", "at", "role", "twice"))
    asked = rows.where(F.col("role") != _HOLDER).select("run", *missing(runs, "n", "size", "packed"), "h", "c", "at", "role", "twice")
    fetched = asked.union(held).repartition(tasks, "run").sortWithinPartitions("run", F.col("packed").isNotNull()).mapInArrow(_fetcher(window), _FETCHED)

    holders = rows.where(F.col("role") == _HOLDER).select("h", "c", "run", "role", F.lit(None).cast("binary").alias("text"), "twice")
    phrases = fetched.union(holders).repartition(tasks, "h").sortWithinPartitions("h", "role", "c", "run").mapInArrow(_confirmer(window), "run long, phrase binary")

    sent = phrases.select("run", *missing(runs, "n", "size", "packed", "ids"), "phrase")
    both = sent.union(runs.select("run", "n", "size", "packed", "ids", F.lit(None).cast("binary").alias("phrase")))
    located = both.repartition(tasks, "run").sortWithinPartitions("run", F.col("packed").isNotNull())
    return located.mapInArrow(_locator(shard), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
