"""SimHash near-duplicates: fingerprints, linked through vantage-point shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import IS_SPACE, components, slices, texts_of, word_bounds
from evidence_spark.sources.tables import write_table

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Fingerprints of its own that a shard may hold before it is split.
SHARD_SIZE = 8192
#: Texts are hashed in runs of about so many bytes, and bits summed over so many shingles.
RUN_BYTES = 1 << 20
RUN_SHINGLES = 1 << 15
_LEAF = 768


def fingerprints_of(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit fingerprint of every text; no word gives zero."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    upper = (joined >= 65) & (joined <= 90)
    body = joined + upper.astype(np.uint8) * 32
    space = IS_SPACE[body]
    kept = ~space | np.concatenate([[False], ~space[:-1]])  # a word and the first blank behind it
    squeezed = np.where(space, 32, body)[kept].astype(np.uint8)
    starts, ends, _ = word_bounds(squeezed, np.array([0, len(squeezed)]))
    original = word_bounds(body, offsets)[2]
    raw = squeezed.tobytes()
    counts = np.where(original >= words, original - words + 1, np.minimum(original, 1))
    first_word = np.concatenate([[0], np.cumsum(original)[:-1]])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    owner = np.repeat(np.arange(len(texts)), counts)
    at = first_word[owner] + (np.arange(total) - bounds[owner])
    last = np.minimum(at + words, first_word[owner] + original[owner]) - 1
    sums = np.zeros((len(texts), 64), dtype=np.int64)
    for low in range(0, total, RUN_SHINGLES):
        high = min(total, low + RUN_SHINGLES)
        cuts = map(slice, starts[at[low:high]].tolist(), ends[last[low:high]].tolist())
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(raw.__getitem__, cuts), repeat(seed)), dtype=np.uint64, count=high - low
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[low:high]
        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        sums[mine[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    ones = (2 * sums > counts[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                body, offsets = texts_of(part.column(1))
                raw = body.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = fingerprints_of(texts, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprinter(words), "doc_id long, fp long")


def shards(points: DataFrame, max_distance: int = MAX_DISTANCE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Vantage-point shards of distinct points (fp, rep): rows (node, fp, rep, own).

    Every point is owned by one shard.  A shard with too many is split at the median distance from its
    vantage point (a pseudorandom fingerprint of its own number).  Where two linked points can lie on either side, the
    inner one visits the outer shard; a visitor follows every branch that the triangle bound leaves open.
    """
    state = write_table(
        points.select(F.lit(1).cast("long").alias("node"), "fp", "rep", F.lit(True).alias("own")), "vantage0"
    )
    finished = []
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64("node", F.lit(7)))).cast("int")
    for level in range(1, 63):
        measured = state.withColumn("d", distance)
        nodes = write_table(
            measured.groupBy("node").agg(
                F.count_if("own").alias("n_own"),
                F.count("*").alias("n_all"),
                F.percentile_approx(F.when(F.col("own"), F.col("d")), 0.5).alias("r"),
                F.min(F.when(F.col("own"), F.col("d"))).alias("low"),
                F.max(F.when(F.col("own"), F.col("d"))).alias("high"),
            ),
            "nodes",
        )
        large = (F.col("n_own") > shard_size) | ((F.col("n_all") > 8 * shard_size) & (F.col("n_own") > _LEAF))
        nodes = nodes.where("n_own > 0").select(
            "node",
            large.alias("split"),
            F.when(F.col("r") == F.col("high"), F.greatest("low", F.col("r") - 1)).otherwise(F.col("r")).alias("r"),
        )
        known = measured.join(nodes, "node")
        finished.append(known.where("not split").select("node", "fp", "rep", "own"))
        if nodes.where("split").isEmpty():
            break
        inner, outer = F.col("d") <= F.col("r"), F.col("d") > F.col("r")
        visits_outer = (F.col("d") + max_distance > F.col("r")) & (F.col("own") & inner | ~F.col("own"))
        visits_inner = (F.col("d") - max_distance <= F.col("r")) & ~F.col("own")
        places = F.array_compact(
            F.array(
                F.when(F.col("own") & inner, F.struct((2 * F.col("node")).alias("node"), F.lit(True).alias("own"))),
                F.when(F.col("own") & outer, F.struct((2 * F.col("node") + 1).alias("node"), F.lit(True).alias("own"))),
                F.when(visits_inner, F.struct((2 * F.col("node")).alias("node"), F.lit(False).alias("own"))),
                F.when(visits_outer, F.struct((2 * F.col("node") + 1).alias("node"), F.lit(False).alias("own"))),
            )
        )
        state = write_table(
            known.where("split").select(F.explode(places).alias("p"), "fp", "rep").select("p.node", "fp", "rep", "p.own"),
            f"vantage{level}",
        )
    else:
        raise RuntimeError("points were left unsplit; raise shard_size")
    result = finished[0]
    for more in finished[1:]:
        result = result.union(more)
    return result


class _Groups:
    """Union-find on 0..n-1, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def _close(points: np.ndarray, own: np.ndarray, seen: np.ndarray, groups: _Groups, limit: int, rng: np.random.Generator) -> None:
    """Join every own point with every point of ``own`` and ``seen`` within ``limit`` bits."""
    if not len(own):
        return
    far = None
    if len(own) > _LEAF:
        vantage = points[own[rng.integers(len(own))]]
        far = np.bitwise_count(points[own] ^ vantage).astype(np.int64)
        r = int(np.median(far))
        if far.max() <= r:
            r = int(far.min()) if far.min() < r else r - 1
        if not (far <= r).any() or (far <= r).all():
            far = None
    if far is None:
        every = np.concatenate([own, seen])
        step = max(1, (1 << 21) // len(every))
        for low in range(0, len(own), step):
            mine = own[low : low + step]
            rest = every[low:]
            i, j = np.nonzero(np.bitwise_count(points[mine][:, None] ^ points[rest][None, :]) <= limit)
            groups.join(mine[i], rest[j])
        return
    inner, outer = own[far <= r], own[far > r]
    edge = own[(far <= r) & (far + limit > r)]
    other = np.bitwise_count(points[seen] ^ vantage).astype(np.int64)
    _close(points, inner, seen[other - limit <= r], groups, limit, rng)
    _close(points, outer, np.concatenate([edge, seen[other + limit > r]]), groups, limit, rng)


def _linker(limit: int):
    def link(table: pa.Table) -> pa.Table:
        """One shard: its points' local groups as edges (a, b) to the first point of the group."""
        points = table.column("fp").to_numpy().view(np.uint64)
        rep = table.column("rep").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(rep, kind="stable")
        points, rep, own = points[order], rep[order], own[order]
        groups = _Groups(len(points))
        _close(points, np.flatnonzero(own), np.flatnonzero(~own), groups, limit, np.random.default_rng(len(points)))
        linked = groups.label != np.arange(len(points))
        return pa.table({"a": rep[linked], "b": rep[groups.label[linked]]})

    return link


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Texts: A-Z lower-cased, words split at space and 0x09-0x0D, ``words``-word shingles with repeats.  A text
    of fewer words is one shingle; one without words (null and empty too) has fingerprint zero.  Rows
    whose fingerprints differ in at most ``max_distance`` bits are linked, equal ones collapse first; the
    component id is the smallest doc_id reachable, null if no row of the component has one.  A repeated doc_id keeps one row per input row.
    """
    rows = write_table(fingerprints(docs, doc_id, text, words), "fingerprints")
    points = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "points")
    # a fingerprint stands for its rows, which may all be without an id
    dealt = shards(points.select("fp", F.col("fp").alias("rep")), max_distance, shard_size)
    edges = dealt.groupBy("node").applyInArrow(_linker(max_distance), "a long, b long")
    found = components(edges)
    grouped = write_table(
        points.join(found, points["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("group")), "grouped"
    )
    least = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    named = write_table(grouped.join(least, "group").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
