"""Line deduplication by an exact set-similarity join: prefix, length and positional filters, then verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import partitions, release, slices, texts_of, with_document_key, with_ids, word_bounds
from evidence_spark.llm.repeats import _bucket, _copies, _doc_bucket, _first_places, _Hashes, _marked, _MARKED, _mixed, _with_documents
from evidence_spark.sources.tables import write_table

SIMILARITY = Fraction(4, 5)
#: Counters of the frequency sketch that orders tokens by rarity: fixed size, whatever the input.
SKETCH_BITS = 16
#: Lines of one token that are compared pair by pair in sets; more are compared as matrices.
_FEW = 48
_RUN_BYTES = 3 << 20
#: In place of the tokens behind a prefix token: the line has an equal one before it in its run; the entry is for a whole line.
_GONE, _NAME = -1, -2


def _needed(n: int, similarity: Fraction) -> int:
    """Tokens that two lines share at least, if one has n of them and they are similar enough."""
    return -(-n * similarity.numerator // similarity.denominator)


def _least_size(similarity: Fraction) -> int:
    """Tokens of the smaller of two different sets that are similar enough, at least; no such sets at similarity 1."""
    apart = similarity.denominator - similarity.numerator
    return -(-similarity.numerator // apart) if apart else 1 << 62


def _line_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line: text number and number in its text; per word: hash and line."""
    breaks = np.flatnonzero(body == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.searchsorted(offsets, np.minimum(starts, offsets[-1] - 1 if len(body) else 0), side="right") - 1
    text[: len(offsets) - 1] = np.arange(len(offsets) - 1)
    text[len(offsets) - 1 :] = np.searchsorted(offsets, breaks, side="right") - 1
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    a, b, counts = word_bounds(body, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    # lines are ordered by (text, start); a word is in the last line of its text that starts before it
    key = starts + text  # texts may share a start where one is empty
    line = np.searchsorted(key, a + owner, side="right") - 1
    return text, number, _Hashes(body).of(a, b), line


def _tokens(hashes: np.ndarray, line: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens per line, rare ones first.  A token is named by its count's rank and its hash."""
    count = sketch[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    token = (count.astype(np.uint64) << np.uint64(48)) | (_mixed(hashes) >> np.uint64(16))
    order = np.lexsort((token, line))
    token, line = token[order], line[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (line[1:] != line[:-1])]) if len(token) else np.zeros(0, bool)
    return token[new], line[new]


def _counters(token: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """Per line 16 counters of four bits: its tokens by hash, modulo 16."""
    slot = (_mixed(token + np.uint64(11)) >> np.uint64(60)).astype(np.int64)
    counts = np.bincount(line * 16 + slot, minlength=lines * 16).reshape(lines, 16).astype(np.uint64) & np.uint64(15)
    return np.bitwise_or.reduce(counts << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


_BYTES, _CARRY, _FOUR = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x1010101010101010), np.uint64(4)
_ROUND = np.minimum(np.arange(16), 16 - np.arange(16)).astype(np.int64)


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Tokens in which two lines differ at least, by their counters."""
    total = np.zeros(len(one), np.int64)
    for shift in (np.uint64(0), _FOUR):
        gap = ((((one >> shift) & _BYTES) | _CARRY) - ((two >> shift) & _BYTES)) & _BYTES
        total += _ROUND[gap.view(np.uint8).reshape(-1, 8)].sum(axis=1)
    return total


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for part in slices(batch, "text", _RUN_BYTES):
            body, offsets = texts_of(part.column(1))
            a, b, _ = word_bounds(body, offsets)
            if len(a):
                held += np.bincount((_Hashes(body).of(a, b) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(held))
    slot = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], names=["slot", "n"])


_MET = "bucket int, packed binary"
#: Columns of an entry; the first ones are as good as random and stay as they are, the others are compressed.
_RANDOM, _PLAIN = ("h", "d", "before"), ("bits", "doc", "start", "size", "rest")


def _entries(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with its entries in the order given: their number, the random columns, and the others compressed."""
    short = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket  # sorted by digits
    order = np.argsort(short, kind="stable")
    columns = {k: np.ascontiguousarray(v[order].astype(np.int64, copy=False)) for k, v in columns.items()}
    found, heads = np.unique(bucket[order], return_index=True)
    codec = pa.Codec("zstd", compression_level=1)
    rows = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        # the bytes of a column lie by significance, so that the high ones, which agree, vanish
        planes = b"".join(columns[k][a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for k in _PLAIN)
        rows.append(np.array([b - a], np.int64).tobytes() + b"".join(columns[k][a:b].tobytes() for k in _RANDOM) + codec.compress(planes, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "packed"])


def _entry_columns(packed: bytes) -> dict[str, np.ndarray]:
    n = int(np.frombuffer(packed[:8], np.int64)[0])
    cut = 8 + 8 * n * len(_RANDOM)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[cut:], decompressed_size=8 * n * len(_PLAIN), asbytes=True), np.uint8)
    plain = np.ascontiguousarray(planes.reshape(len(_PLAIN), 8, n).transpose(0, 2, 1)).view(np.int64).reshape(len(_PLAIN), n)
    return dict(zip((*_RANDOM, *_PLAIN), [*np.frombuffer(packed[8:cut], np.int64).reshape(len(_RANDOM), n), *plain], strict=True))


def _scanner(sketch: np.ndarray, buckets: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _RUN_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                text, number, hashes, line = _line_words(*texts_of(part.column(1)))
                token, line = _tokens(hashes, line, sketch)
                if not len(token):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                size = np.diff(np.append(heads, len(line)))
                name = np.add.reduceat(_mixed(token ^ np.uint64(0x5851F42D4C957F2D)), heads)
                name = (_mixed(name) & ~np.uint64(0xFFFF)) | np.minimum(size, 0xFFFF).astype(np.uint64)
                # sets are equal if both hashes are: 112 bits, besides the size
                second = _mixed(np.add.reduceat(_mixed(_mixed(token + np.uint64(0x2545F4914F6CDD1D))), heads) + np.uint64(5))
                lines = line[heads]
                bits = _counters(token, np.repeat(np.arange(len(heads)), size), len(heads))
                doc, start = ids[text[lines]], number[lines].astype(np.int32)
                first, later = (np.sort(x) for x in _first_places(doc, start, second, name))  # the later ones go, whatever other runs hold
                once = first[size[first] >= _least_size(similarity)]  # shorter sets are similar only when equal
                n = size[once]
                prefix = n - -(-n * similarity.numerator // similarity.denominator) + 1
                owner = np.repeat(once, prefix)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                at = heads[owner] + place
                which = np.concatenate([first, owner, later])
                named, gone = np.zeros(len(first), np.int64), np.zeros(len(later), np.int64)
                h = np.concatenate([name[first], token[at], name[later]])
                rest = np.concatenate([named + _NAME, size[owner] - 1 - place, gone + _GONE])
                before = np.where(place > 0, token[np.maximum(at, 1) - 1], second[owner])  # no two sets share it
                yield _entries(
                    np.where(rest == _GONE, _doc_bucket(doc[which], buckets), _bucket(_mixed(h).view(np.int64), buckets)),
                    {
                        "h": h, "d": second[which], "before": np.concatenate([named, before.view(np.int64), gone]),
                        "bits": np.concatenate([named, bits[owner].view(np.int64), gone]),
                        "doc": doc[which], "start": start[which], "size": size[which], "rest": rest,
                    },
                )

    return run


def _settler(similarity: Fraction):
    """Equal lines: all but the first go.  Two lines are wanted at the first prefix token that they share, if their
    lengths, the tokens behind it and their counters do not rule the pair out (which they never do to a similar one).
    A pair that shares the token just before as well meets there, so its sets are not sent again here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                entry = _entry_columns(packed)
                gone = entry["rest"] == _GONE
                if gone.any():
                    yield _copies(entry["doc"][gone], entry["start"][gone].astype(np.int32), np.zeros(int(gone.sum()), np.int32))
                held.append({k: v[~gone].astype(np.int32 if k in ("start", "size", "rest") else np.int64) for k, v in entry.items()})
        if not sum(len(x["h"]) for x in held):
            return
        column = {k: np.concatenate([x[k] for x in held]) for k in (*_RANDOM, *_PLAIN)}
        del held
        # sets are equal if size, key, second hash and counters are
        order = np.lexsort([column[k] for k in ("start", "doc", "bits", "d", "size", "h")])
        column = {k: v[order] for k, v in column.items()}
        h, d, doc, start, size, bits, rest, before = (column[k] for k in ("h", "d", "doc", "start", "size", "bits", "rest", "before"))
        named = rest == _NAME
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (size[1:] != size[:-1]) | (d[1:] != d[:-1]) | (bits[1:] != bits[:-1]) | (named[1:] != named[:-1])])
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
        gone = ~new & named & ~same
        yield _copies(doc[gone], start[gone], np.zeros(int(gone.sum()), np.int32))
        lead = np.flatnonzero(new & ~named)
        h, doc, start, size, bits = h[lead], doc[lead], start[lead], size[lead].astype(np.int64), bits[lead].view(np.uint64)
        rest, before = rest[lead].astype(np.int64), before[lead]
        wanted = np.zeros(len(h), bool)
        one, step = np.arange(len(h)), 0
        top, low = similarity.numerator, similarity.denominator
        while len(one):
            # each line with the one ``step`` places on, as long as both have the token; sizes ascend
            step += 1
            one = one[one + step < len(h)]
            two = one + step
            meets = (h[one] == h[two]) & (size[one] * low >= size[two] * top)
            one, two = one[meets], two[meets]
            both = size[one] + size[two]
            near = ((1 + np.minimum(rest[one], rest[two])) * (low + top) >= both * top) & (before[one] != before[two])
            i, j = one[near], two[near]
            near = _apart(bits[i], bits[j]) <= both[near] * (low - top) // (low + top)
            wanted[i[near]] = True
            wanted[j[near]] = True
        yield _marked(doc[wanted], start[wanted], size[wanted].astype(np.int32), h[wanted], np.zeros(int(wanted.sum()), bool))

    return run


_LINES = "bucket int, key long, doc long, start int, line binary"
#: Text of lines that are compressed together, one piece per bucket.
_PACK_BYTES = 8 << 20


def _fetcher(buckets: int):
    """Lines that are wanted at some token, by the token's bucket."""
    def work(texts: Iterator[tuple[int, bytes]], table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in texts:
            a, b = np.searchsorted(table[0], [doc, doc + 1])
            if a < b:
                cut = text.split(b"\n")
                rows += [(h, doc, start, cut[start]) for start, h in zip(table[1][a:b].tolist(), table[3][a:b].tolist(), strict=True)]
        if rows:
            key, doc, start, line = zip(*rows, strict=True)
            key = np.array(key, np.int64)
            bucket = _bucket(_mixed(key.view(np.uint64) + np.uint64(1)).view(np.int64), buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(key), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(line, pa.binary())],
                names=[f.split()[0] for f in _LINES.split(", ")],
            )

    return work


def _packed_lines(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per bucket: its number of lines and their bytes, and compressed key, document, place, length and text."""
    table = pa.Table.from_batches(held)
    bucket, key, doc, start = (table.column(i).to_numpy().astype(np.int64) for i in range(4))
    texts = table.column(4).to_pylist()
    numbers = np.stack([key, doc, start, np.array([len(t) for t in texts], np.int64)])
    order = np.argsort(bucket, kind="stable")
    found, heads = np.unique(bucket[order], return_index=True)
    codec = pa.Codec("zstd", compression_level=1)
    rows = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        mine = order[a:b]
        whole = numbers[:, mine].tobytes() + b"".join(texts[i] for i in mine.tolist())
        rows.append(np.array([b - a, len(whole)], np.int64).tobytes() + codec.compress(whole, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "packed"])


def _line_packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= _PACK_BYTES:
            yield _packed_lines(held)
            held, size = [], 0
    if held:
        yield _packed_lines(held)


def _line_sets(packed: bytes, sketch: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(key, document, place) and the token set of every line of a piece."""
    n, size = np.frombuffer(packed[:16], np.int64).tolist()
    whole = pa.Codec("zstd").decompress(packed[16:], decompressed_size=size, asbytes=True)
    *places, lengths = np.frombuffer(whole[: 32 * n], np.int64).reshape(4, n)
    body = np.frombuffer(whole[32 * n :], np.uint8)
    starts, ends, counts = word_bounds(body, np.concatenate([[0], np.cumsum(lengths)]))
    token, line = _tokens(_Hashes(body).of(starts, ends), np.repeat(np.arange(n), counts), sketch)
    return np.stack(places), np.split(token, np.searchsorted(line, np.arange(1, n)))


def later_matches(key: int, sets: list[np.ndarray], similarity: Fraction) -> list[int]:
    """Of lines in order that share token ``key``, the numbers of those with an earlier similar one."""
    top, low = similarity.numerator, similarity.denominator
    n = np.array([len(s) for s in sets])
    behind = np.array([len(s) - 1 - int(np.searchsorted(s, np.uint64(key))) for s in sets])
    gone = []
    if len(sets) <= _FEW:
        held = [frozenset(s.tolist()) for s in sets]
        for j in range(1, len(sets)):
            for i in range(j):
                small, large = sorted((int(n[i]), int(n[j])))
                if small * low < large * top:
                    continue
                need = -(-(small + large) * top // (top + low))
                # the prefixes are in one order: what lies behind the shared token bounds the overlap, if it is the first;
                # if it is not, the pair is compared at the first
                if 1 + min(behind[i], behind[j]) < need:
                    continue
                if len(held[i] & held[j]) >= need:
                    gone.append(j)
                    break
        return gone
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    step = max(64, (1 << 23) // max(1, len(words)))
    bound = np.concatenate([[0], np.cumsum(n)])

    def block(a: int) -> np.ndarray:
        made = np.zeros((min(step, len(sets) - a), len(words)), np.float32)
        inside = slice(bound[a], bound[a + len(made)])
        made[owner[inside] - a, place[inside]] = 1
        return made

    found = np.zeros(len(sets), bool)
    for b in range(0, len(sets), step):
        later = block(b)
        for a in range(0, b + 1, step):  # two blocks at a time are held
            earlier = later if a == b else block(a)
            shared = later @ earlier.T
            total = n[b : b + len(later)][:, None] + n[a : a + len(earlier)][None, :]
            hit = shared * (top + low) >= total * top
            hit &= np.arange(a, a + len(earlier))[None, :] < np.arange(b, b + len(later))[:, None]
            found[b : b + len(later)] |= hit.any(axis=1)
    return np.flatnonzero(found).tolist()


def _verifier(sketch: np.ndarray, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, tokens = [], []
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                place, sets = _line_sets(packed, sketch)
                places.append(place)
                tokens += sets
        if not tokens:
            return
        key, doc, start = np.concatenate(places, axis=1)
        order = np.lexsort((start, doc, key))
        k, d, s = key[order], doc[order], start[order]
        # a repeated row sends its lines again; a line is not similar to itself
        order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])])]
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        gone = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            mine = order[a:b]
            if b - a > 1:
                sets = [tokens[i] for i in mine.tolist()]
                gone += [int(mine[j]) for j in later_matches(int(np.int64(key[mine[0]]).view(np.uint64)), sets, similarity)]
        at = np.array(gone, np.int64)
        if len(at):
            pairs = np.unique(np.stack([doc[at], start[at].astype(np.int64)]), axis=1)
            zero = np.zeros(pairs.shape[1], np.int64)
            yield _marked(pairs[0], pairs[1].astype(np.int32), zero.astype(np.int32), zero, zero.astype(bool))

    return run


def _remover(texts: Iterator[tuple[int, bytes]], table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = []
    for doc, text in texts:
        a, b = np.searchsorted(table[0], [doc, doc + 1])
        lines = text.split(b"\n")
        gone = set(table[1][a:b].tolist())
        kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
        removed = sum(i < len(lines) for i in gone)
        rows.append((doc, len(lines), removed, hashlib.sha256(kept).hexdigest(), kept))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept"]
    )


def remove_similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, kept), one row per input row.

    A line (between line feeds) goes if an earlier one, of a smaller doc_id or before in its document, has a word set
    of Jaccard similarity ``similarity`` or more; lines are judged on the input.  Words end at space and 0x09-0x0D.
    Lines without words stay.  Null is the empty text, one line.  Rows that repeat doc_id and text count as one document;
    different texts of one doc_id are documents in order of their checksum, and rows without one come last.

    Words are ordered by a frequency sketch of fixed size, so any order is the same in every task; equal sets
    collapse first; a line's prefix tokens meet the other lines', and a line is sent only where it and another
    share their first token and length, position and token counters leave the pair over.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    narrow, keys = with_document_key(narrow)
    counted = narrow.mapInArrow(_counter, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in counted:
        sketch[row["slot"]] = row["n"]
    sketch = np.argsort(np.argsort(sketch, kind="stable"), kind="stable").astype(np.uint16)
    met = narrow.mapInArrow(_scanner(sketch, buckets, similarity), _MET).repartitionById(buckets, F.col("bucket"))
    settled = write_table(met.mapInArrow(_settler(similarity), _MARKED), "lines")
    release(spark)
    wanted = _with_documents(narrow, settled.where("h is not null"), _fetcher(buckets), _MET, buckets, _line_packer)
    similar = write_table(wanted.repartitionById(buckets, F.col("bucket")).mapInArrow(_verifier(sketch, similarity), _MARKED), "similar")
    release(spark)
    marks = settled.where("h is null").unionByName(similar)
    shape = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept binary"
    return with_ids(_with_documents(narrow, marks, _remover, shape, buckets), keys)
