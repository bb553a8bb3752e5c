"""Removal of long repeats with run-length indexes (run-compressed Burrows-Wheeler transforms).

1. Every window of ``WINDOW`` bytes has a least gram hash.  Runs of windows with the same one form segments; equal
   windows share the hash, so the hash decides where windows meet.
2. Where a hash meets once, its windows are unique.  Later copies of an equal segment repeat the first in full.
3. First copies of different segments with one hash go to an index: their run-compressed transform is built, with the match
   length sampled at run heads; all segments stream through it from their ends, which gives each window's row and match length, and
   windows in one stretch of long matches are equal.  All but the earliest are marked.
4. Marked windows return to their documents, where their bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import partitions, slices, texts_of, with_document_key, with_ids
from evidence_spark.sources.tables import write_table

WINDOW = 100
GRAM = 24
#: Windows per segment; a segment and its end mark stay within 7 * 2**5 symbols.
_MOST = 124
#: Different segments of one hash beyond which its windows are dealt out one by one.
HOT = 2048
#: Text of one index, and of one run of documents.
INDEX_BYTES = 1 << 20
_RUN_BYTES = 3 << 20
_B = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x * _MIX


class _Hashes:
    """Hashes of any substrings of ``body`` from running sums."""

    def __init__(self, body: np.ndarray):
        up, self.down = _power(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE[body] * up[: len(body)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum over every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def segments(body: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document row, start in body, windows, gram hash, content hash) of all segments of the run."""
    none = np.zeros(0, np.int64)
    if len(body) < window:
        return none, none, none, none, none
    hashes = _Hashes(body)
    n = len(body) - gram + 1
    grams = _mixed((hashes.sums[gram:] - hashes.sums[:n]) * hashes.down[:n])
    width = window - gram + 1
    least = _sliding(grams, width, np.minimum)
    valid = np.zeros(len(least), bool)
    edge = np.zeros(len(least) + 1, np.int64)
    lengths = np.diff(offsets)
    long = lengths >= window
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - window + 1, -1)
    valid = np.cumsum(edge)[:-1] > 0
    change = np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1]]) & valid
    first = np.zeros(len(least) + 1, bool)
    first[np.minimum(offsets[:-1], len(least))] = True
    change |= first[:-1] & valid
    heads = np.flatnonzero(change)
    if not len(heads):
        return none, none, none, none, none
    row = np.searchsorted(offsets, heads, side="right") - 1
    last = offsets[row + 1] - window + 1
    n_of = np.minimum(np.append(heads[1:], len(least)), last) - heads
    parts = -(-n_of // _MOST)
    which = np.repeat(np.arange(len(heads)), parts)
    order = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = heads[which] + order * _MOST
    count = np.minimum(_MOST, n_of[which] - order * _MOST)
    content = hashes.of(start, start + count + window - 1)
    # grams that are the least of some window; two equal ones in a segment mean that it may repeat itself
    beyond = np.zeros(width - 1, np.uint64)
    marks = np.flatnonzero(grams == _sliding(np.concatenate([beyond, least, beyond]), width, np.maximum))
    low, high = np.searchsorted(marks, start), np.searchsorted(marks, start + count + width - 1)
    many = np.flatnonzero(high - low > 1)
    each = (high - low)[many]
    owner = np.repeat(many, each)
    at = marks[low[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))]
    equal = np.bincount(owner, grams[at] == least[start[owner]], minlength=len(start)) > 1
    content = (content & ~np.uint64(255)) | (equal.astype(np.uint64) << np.uint64(7)) | count.astype(np.uint64)
    return row[which], start, count, least[heads[which]].view(np.int64), content.view(np.int64)


_PACKED = "bucket int, h array<long>, c array<long>, doc array<long>, start array<int>"


def _pack(bucket: np.ndarray, n: int, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    """One row per bucket with the lists of its entries."""
    order = np.argsort(bucket, kind="stable")
    found, heads = np.unique(bucket[order], return_index=True)
    bounds = pa.array(np.append(heads, len(bucket)).astype(np.int32))
    arrays = [pa.ListArray.from_arrays(bounds, pa.array(v[order], t)) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *arrays], names=["bucket", *columns])


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _first_places(doc: np.ndarray, start: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with equal names: the numbers of those at the first place, one each, and of those at later places."""
    order = np.lexsort((start, doc, *names))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    first = order[new]
    lead = first[np.cumsum(new) - 1]
    return first, order[(doc[order] != doc[lead]) | (start[order] != start[lead])]


def _scanner(window: int, gram: int, buckets: int):
    """Segments by hash, equal ones of a run once; the later ones are copies whatever other runs hold, and are dealt by document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _RUN_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                body, offsets = texts_of(part.column(1))
                row, start, _, h, c = segments(body, offsets, window, gram)
                if len(row):
                    doc, start = ids[row].astype(np.int64), (start - offsets[row]).astype(np.int32)
                    first, later = _first_places(doc, start, c, h)
                    at = np.concatenate([first, later])
                    settled = np.arange(len(at)) >= len(first)
                    bucket = np.where(settled, _doc_bucket(doc[at], buckets), _bucket(_mixed(h[at].view(np.uint64)).view(np.int64), buckets))
                    yield _pack(
                        bucket,
                        buckets,
                        {
                            "h": (h[at], pa.int64()), "c": (c[at], pa.int64()), "doc": (doc[at], pa.int64()),
                            "start": (start[at], pa.int32()), "settled": (settled, pa.bool_()),
                        },
                    )

    return run


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


_MARKED = "doc long, start int, n int, h long, hot boolean"


def _marked(doc, start, n, h, hot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(hot, pa.bool_())],
        names=["doc", "start", "n", "h", "hot"],
    )


def _copies(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Marks that need no comparison."""
    return _marked(doc, start, n, pa.nulls(len(doc), pa.int64()), np.zeros(len(doc), bool))


def _settle(h: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray, hot: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Entries of a bucket: later copies (repeated in full), and first copies that others of their hash must be compared with."""
    order = np.lexsort((start, doc, c, h))
    h, c, doc, start = h[order], c[order], doc[order], start[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    same = ~new_c & np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
    later = ~new_c & ~same
    n = (c & 127).astype(np.int32)
    kinds = np.add.reduceat(new_c, np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
    wanted = new_c & ((kinds > 1) | ((c & 128) > 0))  # a segment that may repeat itself needs the index, even alone
    copies = _marked(doc[later], start[later], n[later], np.zeros(int(later.sum()), np.int64), np.zeros(int(later.sum()), bool))
    return copies, _marked(doc[wanted], start[wanted], n[wanted], h[wanted], kinds[wanted] > hot)


def _settler(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            h, c, doc, start, settled = (_lists(batch, x) for x in ("h", "c", "doc", "start", "settled"))
            settled = settled.astype(bool)
            if settled.any():
                yield _copies(doc[settled], start[settled], (c[settled] & 127).astype(np.int32))
            held.append((h[~settled], c[~settled], doc[~settled], start[~settled]))
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        if columns and len(columns[0]):
            copies, wanted = _settle(*columns, hot)
            yield _copies(*(copies.column(i).to_numpy() for i in range(3)))
            yield wanted

    return run


_UNION = "kind int, bucket int, doc long, start int, n int, h long, hot boolean, packed binary"


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(_mixed(ids.astype(np.int64).view(np.uint64)).view(np.int64), buckets)


def _doc_packer(buckets: int):
    """Documents, compressed together per bucket and run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in slices(batch, "text", _RUN_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                body, offsets = texts_of(part.column(1))
                raw = body.tobytes()
                bucket = _doc_bucket(ids, buckets)
                rows, names = [], []
                for b in np.unique(bucket):
                    mine = np.flatnonzero(bucket == b)
                    lengths = np.diff(offsets)[mine]
                    content = b"".join(raw[offsets[i] : offsets[i + 1]] for i in mine)
                    head = np.array([len(mine)], np.int64).tobytes() + ids[mine].tobytes() + lengths.astype(np.int64).tobytes()
                    whole = head + content
                    rows.append(np.array([len(whole)], np.int64).tobytes() + codec.compress(whole, asbytes=True))
                    names.append(int(b))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "packed"])

    return run


def _unpack(packed: bytes) -> Iterator[tuple[int, bytes]]:
    size = int(np.frombuffer(packed[:8], np.int64)[0])
    whole = pa.Codec("zstd").decompress(packed[8:], decompressed_size=size, asbytes=True)
    n = int(np.frombuffer(whole[:8], np.int64)[0])
    ids, lengths = np.frombuffer(whole[8 : 8 + 16 * n], np.int64).reshape(2, n)
    at = 8 + 16 * n
    for doc, length in zip(ids.tolist(), lengths.tolist(), strict=True):
        yield doc, whole[at : at + length]
        at += length


def _with_documents(docs: DataFrame, marks: DataFrame, work, schema: str, buckets: int, finish=iter) -> DataFrame:
    """Bring marks to their documents: both are dealt by document, marks first, and worked on partition by partition.

    ``finish`` takes all that ``work`` gives in a partition, in the same Python worker."""
    packed = docs.mapInArrow(_doc_packer(buckets), "bucket int, packed binary")
    none = lambda t: F.lit(None).cast(t)
    right = packed.select(
        F.lit(1).alias("kind"), "bucket", none("long").alias("doc"), none("int").alias("start"), none("int").alias("n"),
        none("long").alias("h"), none("boolean").alias("hot"), "packed",
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int32)), pa.array(_doc_bucket(ids, buckets).astype(np.int32)), *batch.columns, pa.nulls(len(ids), pa.binary())],
                names=[f.split()[0] for f in _UNION.split(", ")],
            )

    left = marks.select("doc", "start", "n", "h", "hot").mapInArrow(deal, _UNION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = [], None
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(kind, 1))
            if cut:
                part = batch.slice(0, cut)
                held.append((
                    part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False),
                    part.column(4).to_numpy(zero_copy_only=False), part.column(5).fill_null(0).to_numpy(zero_copy_only=False),
                    part.column(6).to_numpy(zero_copy_only=False).astype(bool),
                ))
            if cut < len(batch):
                if table is None:
                    table = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 5
                    order = np.argsort(table[0], kind="stable")
                    table, held = [x[order] for x in table], []
                for packed in batch.column(7).slice(cut).to_pylist():
                    yield from work(_unpack(packed), table)

    return (
        left.unionByName(right).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(lambda batches: finish(run(batches)), schema)
    )


_FETCHED = "bucket int, key long, doc long, start int, seg binary, h array<long>, c array<long>, docs array<long>, starts array<int>"


def _fetcher(window: int, buckets: int):
    """Texts of wanted segments; of hot hashes, hashes of the single windows."""
    def work(texts: Iterator[tuple[int, bytes]], table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, single = [], []
        for doc, text in texts:
            a, b = np.searchsorted(table[0], [doc, doc + 1])
            if a == b:
                continue
            for start, n, h in zip(*(table[i][a:b][~table[4][a:b]].tolist() for i in (1, 2, 3)), strict=True):
                rows.append((h, doc, start, text[start : start + n + window - 1]))
            hot = table[4][a:b]
            if hot.any():
                hashes = _Hashes(np.frombuffer(text, np.uint8))
                starts, counts = table[1][a:b][hot], table[2][a:b][hot].astype(np.int64)
                at = np.repeat(starts, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
                key = hashes.of(at, at + window)
                second = _mixed(hashes.of(at, at + window // 2) + np.uint64(3) * hashes.of(at + window // 2, at + window))
                content = ((second & ~np.uint64(255)) | np.uint64(1)).view(np.int64)
                single.append((key.view(np.int64), content, np.full(len(at), doc), at.astype(np.int32)))
        if rows:
            h, doc, start, seg = zip(*rows, strict=True)
            keys = np.array(h, np.int64)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_bucket(_mixed(keys.view(np.uint64) + np.uint64(1)).view(np.int64), buckets).astype(np.int32)),
                    pa.array(keys), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(seg, pa.binary()),
                    *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(3)), pa.nulls(n, pa.list_(pa.int32())),
                ],
                names=[f.split()[0] for f in _FETCHED.split(", ")],
            )
        if single:
            key, c, doc, start = (np.concatenate(x) for x in zip(*single, strict=True))
            packed = _pack(
                _bucket(key, buckets), buckets,
                {"h": (key, pa.int64()), "c": (c, pa.int64()), "docs": (doc, pa.int64()), "starts": (start, pa.int32())},
            )
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [packed.column(0), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *packed.columns[1:]],
                names=[f.split()[0] for f in _FETCHED.split(", ")],
            )

    return work


class RunLengthIndex:
    """Run-compressed transform of texts, each closed by its own end mark, with match lengths sampled at run heads."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths + 1) - 1
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        symbols = joined.astype(np.int64) + 1
        symbols[ends] = 0
        size = len(symbols)
        order, rank = self._sorted(symbols)
        before = symbols[order - 1]  # the row of the whole text sees the last end mark
        before[order == 0] = 0
        # an end mark is its own symbol: runs of marks are not compressed
        mark = before == 0
        head = np.concatenate([[True], (before[1:] != before[:-1]) | mark[1:] | mark[:-1]])
        self.heads = np.flatnonzero(head)
        self.symbol = before[self.heads]
        counts = np.bincount(symbols, minlength=257)
        first = np.cumsum(counts) - counts
        lengths_of_runs = np.diff(np.append(self.heads, size))
        by_symbol = np.argsort(self.symbol, kind="stable")
        base = np.zeros(len(self.heads), np.int64)
        sums = np.cumsum(lengths_of_runs[by_symbol]) - lengths_of_runs[by_symbol]
        starts = np.searchsorted(self.symbol[by_symbol], np.arange(257))
        origin = sums[np.minimum(starts, len(sums) - 1)]
        base[by_symbol] = first[self.symbol[by_symbol]] + sums - origin[self.symbol[by_symbol]]
        self.base = base  # where a run's first row goes
        self.size, self.texts = size, len(texts)
        # sampled: for each run head, how far the row it leads to agrees with the row above
        here = order[self.heads] - 1
        row = rank[here]
        above = order[np.maximum(row - 1, 0)]
        self.sample = self._agreement(symbols, here, above)
        self.sample[row == 0] = 0

    @staticmethod
    def _sorted(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling, from seven symbols on; an end mark makes a suffix unique."""
        size = len(symbols)
        key = np.zeros(size, np.int64)
        alive = np.ones(size, bool)
        padded = np.concatenate([symbols, np.zeros(8, np.int64)])
        for k in range(7):
            now = padded[k : k + size]
            key = (key << 9) | np.where(alive, now, 0)
            alive &= now != 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | ~alive[order][1:] | ~alive[order][:-1]])
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(new) - 1
        span = 7
        while not new.all():
            shifted = np.zeros(size, np.int64)
            shifted[:-span] = rank[span:] if span < size else 0
            key = rank * size + shifted
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
            rank[order] = np.cumsum(new) - 1
            span *= 2
        return order, rank

    @staticmethod
    def _agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of suffixes, not beyond an end mark."""
        found = np.zeros(len(a), np.int64)
        alive = np.arange(len(a))
        while len(alive):
            x, y = a[alive] + found[alive], b[alive] + found[alive]
            inside = (x < len(symbols)) & (y < len(symbols))
            alive, x, y = alive[inside], x[inside], y[inside]
            alive = alive[(symbols[x] == symbols[y]) & (symbols[x] != 0)]
            found[alive] += 1
        return found

    def stream(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All texts at once from their ends: after step k, (text, row, match length with the row above) of the suffixes of
        k symbols, of the texts that have them."""
        text = np.arange(self.texts)
        row = np.arange(self.texts)  # the end marks' suffixes are the first rows, in text order
        match = np.zeros(self.texts, np.int64)
        for _ in range(steps):
            run = np.searchsorted(self.heads, row, side="right") - 1
            at_head = row == self.heads[run]
            inside = self.symbol[run] != 0
            match = np.where(at_head, self.sample[run], match + 1)
            row = self.base[run] + row - self.heads[run]
            text, row, match = text[inside], row[inside], match[inside]
            if not len(text):
                return
            yield text, row, match


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows of ``texts`` that occur earlier, texts being parts of documents."""
    index = RunLengthIndex(texts)
    longest = max(map(len, texts))
    lengths = np.array([len(t) for t in texts])
    own, rows = [], []
    short = np.ones(index.size, bool)
    for k, (text, row, match) in enumerate(index.stream(longest), start=1):
        short[row] = match < window
        if k >= window:
            own.append((text, lengths[text] - k))
            rows.append(row)
    group = np.cumsum(short)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate([t for t, _ in own])
    at = start[text] + np.concatenate([s for _, s in own])
    d, g = doc[text], group[np.concatenate(rows)]
    order = np.lexsort((at, d, g))
    d, at, g = d[order], at[order], g[order]
    later = np.concatenate([[False], (g[1:] == g[:-1])])
    # of windows that two segments share, the same place is not a repeat of itself
    place = np.concatenate([[False], later[1:] & (d[1:] == d[:-1]) & (at[1:] == at[:-1])])
    keep = later & ~place
    lead = np.flatnonzero(~later)[np.cumsum(~later) - 1]
    keep &= ~((d == d[lead]) & (at == at[lead]))
    return d[keep], at[keep]


def _indexer(window: int, index_bytes: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, starts, texts, single = [], [], [], [], []
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for part in (batch.filter(pa.array(known)),):
                keys.append(part.column(1).to_numpy(zero_copy_only=False))
                docs.append(part.column(2).to_numpy(zero_copy_only=False))
                starts.append(part.column(3).to_numpy(zero_copy_only=False))
                texts += part.column(4).to_pylist()
            rest = batch.filter(pa.array(~known))
            if len(rest):
                single.append(tuple(_lists(rest, x) for x in ("h", "c", "docs", "starts")))
        if single:
            copies, _ = _settle(*(np.concatenate(x) for x in zip(*single, strict=True)), hot)
            yield copies
        if not texts:
            return
        key, doc, start = np.concatenate(keys), np.concatenate(docs).astype(np.int64), np.concatenate(starts).astype(np.int64)
        order = np.lexsort((start, doc, key))
        sizes = np.array([len(t) + 1 for t in texts])[order]
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        bounds, begin, held = [], 0, 0
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            size = int(sizes[a:b].sum())
            if held and held + size > index_bytes:
                bounds.append((begin, a))
                begin, held = a, 0
            held += size
        bounds.append((begin, len(order)))
        for a, b in bounds:
            mine = order[a:b]
            d, at = repeated_windows([texts[i] for i in mine.tolist()], doc[mine], start[mine], window)
            by = np.lexsort((at, d))
            d, at = d[by], at[by]
            if len(d):
                head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)]))
                tail = np.append(head[1:], len(d)) - 1
                n = at[tail] - at[head] + 1
                zero = np.zeros(len(head), np.int64)
                yield _marked(d[head], at[head].astype(np.int32), n.astype(np.int32), zero, zero.astype(bool))

    return run


def _remover(window: int):
    def work(texts: Iterator[tuple[int, bytes]], table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in texts:
            a, b = np.searchsorted(table[0], [doc, doc + 1])
            cover = np.zeros(len(text) + 1, np.int64)
            starts = table[1][a:b].astype(np.int64)
            fits = starts < len(text)
            np.add.at(cover, starts[fits], 1)
            np.add.at(cover, np.minimum(starts[fits] + table[2][a:b][fits] + window - 1, len(text)), -1)
            gone = np.cumsum(cover)[:-1] > 0
            spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(text) else 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            rows.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return work


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per input row.

    A byte goes if a string of ``window`` bytes over it also starts earlier, in a smaller doc_id or before in the same
    document; strings are judged on the input.  Null is the empty text.  Rows that repeat both doc_id and text count as one document
    (none removes the other); different texts of one doc_id are documents in order of their checksum, and rows without one
    come last.  ``kept`` are the remaining bytes.
    A hash with more than ``hot`` different segments has its windows dealt out by their own hashes.
    """
    buckets = partitions(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    narrow, keys = with_document_key(narrow)
    found = narrow.mapInArrow(_scanner(window, gram, buckets), _PACKED + ", settled array<boolean>").repartitionById(buckets, F.col("bucket"))
    settled = write_table(found.mapInArrow(_settler(hot), _MARKED), "segments")
    fetched = _with_documents(narrow, settled.where("h is not null"), _fetcher(window, buckets), _FETCHED, buckets)
    indexed = fetched.repartitionById(buckets, F.col("bucket")).mapInArrow(_indexer(window, index_bytes, hot), _MARKED)
    marks = settled.where("h is null").unionByName(indexed)
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_ids(_with_documents(narrow, marks, _remover(window), shape, buckets), keys)
