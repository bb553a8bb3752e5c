"""Packing documents into token sequences: dominance reduction, then best fit."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import global_rank, slices
from evidence_spark.sources.tables import write_table

CAPACITY = 2048
SEPARATOR = 0
#: Distinct words whose ids a task remembers.
CACHE_WORDS = 400_000
_SPECIAL = "<|endoftext|>"
_ODD = re.compile(r" (?:\s|$)")


class Encoder:
    """Token ids of texts, equal to those of the tokenizer file.

    The splitter ends a word before every space that something other than white space follows, so ids can be found per
    space-led word and remembered.  Texts with other spaces or with special tokens go to the tokenizer whole.
    With ``ranks_path`` (the same vocabulary as ranks, and its splitting ``pattern``) new words are encoded by the
    faster library of the two.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.limit = cache_words
        self.known: dict[str, bytes] = {}
        self.encode = lambda words: [e.ids for e in self.whole.encode_batch(words, add_special_tokens=False)]
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            coding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: list(map(coding.encode_ordinary, words))

    def _learn(self, groups: list[list[str]]) -> None:
        missing = {w for words in groups for w in words if w not in self.known}
        if len(self.known) + len(missing) > self.limit:
            self.known = {}
            missing = {w for words in groups for w in words}
        listed = list(missing)
        for word, ids in zip(listed, self.encode(listed), strict=True):
            self.known[word] = np.array(ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out: list[bytes] = [b""] * len(texts)
        cut, odd = [], []
        for i, text in enumerate(texts):
            if _ODD.search(text) or _SPECIAL in text:
                odd.append(i)
            elif text:
                first, *rest = text.split(" ")
                cut.append((i, [first] * bool(first) + [" " + w for w in rest]))
        for i, coded in zip(odd, self.whole.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(coded.ids, dtype="<u4").tobytes()
        for at in range(0, len(cut), 64):
            group = cut[at : at + 64]
            self._learn([words for _, words in group])
            for i, words in group:
                out[i] = b"".join(map(self.known.__getitem__, words))
        return out


def _piece_maker(vocabulary: tuple[str, str | None, str | None], capacity: int, separator: int):
    end = np.array([separator], dtype="<u4").tobytes()
    schema = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [
                        (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                    ]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(schema))

    return run


def pieces(
    docs: DataFrame,
    vocabulary: tuple[str, str | None, str | None],
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one separator, cut from the end."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(
        _piece_maker(vocabulary, capacity, separator), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


@dataclass
class Plan:
    """Runs of pieces in length order: run i begins at rank ``first[i]``, goes one piece each to the sequences from
    ``sequence[i]`` on, at ``offset[i]``."""

    first: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0


def _reduce(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fix sets that dominate every other set with their largest piece; ``counts`` by length shrinks in place.

    For the largest piece j: a piece that fills the gap exactly dominates whatever else could share its sequence
    (the others fit in that piece's place).  If only one more piece fits, the largest that does dominates.  If two
    more fit at most and no pair is larger than the best single one, that single one dominates.
    """
    fixed: list[tuple[list[int], int]] = []

    def fix(lengths: list[int], times: int) -> None:
        for length in lengths:
            counts[length] -= times
        fixed.append((lengths, times))

    if counts[capacity]:
        fix([capacity], int(counts[capacity]))
    for j in range(capacity - 1, capacity // 2 - 1, -1):
        k = capacity - j
        times = int(counts[j] // 2 if j == k else min(counts[j], counts[k]))
        if times and k > 0:
            fix([j, k], times)
    for j in range(capacity - 1, 0, -1):
        while counts[j] > 0:
            small = np.flatnonzero(counts)
            spread = np.repeat(small[:4], np.minimum(counts[small[:4]], 4))
            others = list(spread)
            if j in others:
                others.remove(j)
            others = others[:3]
            gap = capacity - j
            if not others or others[0] > gap:
                fix([j], int(counts[j]))
                continue
            below = small[small <= gap]
            if j in below and counts[j] < 2:
                below = below[below != j]
            k = int(below[-1])
            one = len(others) < 2 or others[0] + others[1] > gap
            two = len(others) < 3 or others[0] + others[1] + others[2] > gap
            if one or two and _best_pair(counts, j, gap) <= k:
                # taking pieces away only raises the smallest ones, so the choice repeats until j or k runs out
                fix([j, k], int(counts[j] // 2 if j == k else min(counts[j], counts[k])))
                continue
            break
        else:
            continue
        break
    return fixed


def _best_pair(counts: np.ndarray, j: int, gap: int) -> int:
    """Largest sum of two pieces besides one of length j that fits in ``gap``; 0 if none does."""
    left = counts.copy()
    left[j] -= 1
    sizes = np.flatnonzero(left[: gap + 1])
    best = 0
    for a in sizes:
        room = gap - a
        at = int(np.searchsorted(sizes, min(room, a), side="right")) - 1
        while at >= 0:
            b = sizes[at]
            if b != a or left[a] > 1:
                best = max(best, int(a + b))
                break
            at -= 1
    return best


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, on counts by length: [(lengths of a sequence, how many such)]."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []
    closed: list[tuple[list[int], int]] = []

    def put(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        if not gap:
            closed.append((lengths, times))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((lengths, times))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                times = left // each
                if times:
                    put([length] * each, times)
                if left % each:
                    put([length] * (left % each), 1)
                break
            gap = gaps[at]
            lengths, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            used = min(times, left)
            left -= used
            if times > used:
                put(lengths, times - used)
            put([*lengths, length], used)
    return closed + [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Pack pieces given by their counts per length (index 0 to ``capacity``).  Work and result are bounded by the
    capacity, not by the number of pieces."""
    counts = counts.astype(np.int64)
    start = np.concatenate([[0], np.cumsum(counts)])[:-1]
    left = counts.copy()
    fixed = _reduce(left, capacity)
    result = Plan(fixed=sum(n for _, n in fixed))
    runs = []
    next_of = start.copy()
    for lengths, times in fixed + _best_fit(left, capacity):
        offset = 0
        for length in lengths:
            runs.append((int(next_of[length]), result.sequences, offset))
            next_of[length] += times
            offset += length
        result.sequences += times
    for first, sequence, offset in sorted(runs):
        result.first.append(first)
        result.sequence.append(sequence)
        result.offset.append(offset)
    return result


def pack(
    docs: DataFrame, vocabulary: tuple[str, str | None, str | None], doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    ``vocabulary``: path of the tokenizer file, and optionally of its ranks with the splitting pattern.
    Only the counts per length go to the driver (``capacity`` numbers); the plan has runs of equal lengths,
    and each piece finds its run by its rank in length order.  Null is the empty text: one separator.  Rows that repeat
    a doc_id are packed one by one.  An empty table gives an empty result.
    """
    cut = write_table(pieces(docs, vocabulary, doc_id, text, capacity), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    made = plan(counts, capacity)
    first, sequence, offset = (np.array(x, dtype=np.int64) for x in (made.first, made.sequence, made.offset))
    ranked = global_rank(cut, ["length", "doc_id", "piece", "ids_crc32"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            run = np.searchsorted(first, rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[run] + rank - first[run]), pa.array(offset[run])], names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
