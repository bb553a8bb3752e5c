"""Mixing sources to target weights: blocks, multinomial shards, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import partitions, prefix_sums, slices, texts_of, word_bounds
from evidence_spark.sources.tables import write_table

#: Weights by code-point order of the sources, repeated; the mix's share of all words; most passes over a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
#: A mix names its sources one by one; more than these are refused.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    """A source's place in the mix: words it has, words it should give, and words it gives exactly."""

    name: str | None
    size: int
    target: float
    words: int


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Split ``share`` of all words by weight; what a source cannot take beyond ``most`` times its size is dealt
    out anew by weight until nobody is above."""
    result = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                result[i] = left * weights[i] / whole
            break
        for i in full:
            result[i] = float(most * sizes[i])
        left -= sum(result[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return result


class Permutation:
    """A keyed pseudorandom permutation of 0..n-1: four Feistel rounds over the next even power of two,
    repeated until the value lies inside (cycle walking)."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % (1 << 64)) for r in range(4)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return (x >> np.uint64(29)) & np.uint64((1 << self.half) - 1)

    def _round_trip(self, x: np.ndarray, back: bool) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & low
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def __call__(self, index: np.ndarray, back: bool = False) -> np.ndarray:
        x = np.asarray(index, dtype=np.uint64)
        out = self._round_trip(x, back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._round_trip(out[outside], back)
        return out.astype(np.int64)

    def inverse(self, value: int) -> int:
        return int(self(np.array([value]), back=True)[0])


def _slots_of(source: Source, block: int) -> tuple[int, int]:
    """Slots a source fills, and the words its last one takes."""
    if not source.words:
        return 0, 0
    blocks = -(-source.size // block)
    passes, rest = divmod(source.words, source.size)
    if not rest:
        return passes * blocks, block
    tail = source.size - (blocks - 1) * block
    at = Permutation(blocks, _key(source, passes)).inverse(blocks - 1)
    if rest <= at * block:
        count = -(-rest // block)
        return passes * blocks + count, rest - (count - 1) * block
    behind = rest - at * block - tail
    if behind <= 0:
        return passes * blocks + at + 1, rest - at * block
    count = -(-behind // block)
    return passes * blocks + at + 1 + count, behind - (count - 1) * block


def _key(source: Source, epoch: int) -> int:
    name = b"\0" if source.name is None else b"\1" + source.name.encode()
    return xxhash.xxh64_intdigest(name, epoch)


def _draw(rng: np.random.Generator, counts: np.ndarray, wanted: int) -> np.ndarray:
    if counts.sum() < 10**9:
        return rng.multivariate_hypergeometric(counts, wanted, method="marginals")
    exact = counts * (wanted / counts.sum())  # beyond that the spread is below a hundred-thousandth
    drawn = np.floor(exact).astype(np.int64)
    short = int(wanted - drawn.sum())
    drawn[np.argsort(drawn - exact, kind="stable")[:short]] += 1
    return drawn


def shard_counts(totals: np.ndarray, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: slots of earlier shards, and slots of this one.

    The draws are multinomial with the sources' totals fixed.  A binary tree over the shards is walked from the root
    with a seed per branch, so a shard's draw needs no other shard and reruns agree.
    """
    every = int(totals.sum())
    low, high = 0, max(1, -(-every // slots))
    before, held = np.zeros_like(totals), totals.copy()
    while high - low > 1:
        middle = (low + high) // 2
        left = _draw(np.random.default_rng([seed, low, high]), held, (middle - low) * slots)
        if shard < middle:
            held, high = left, middle
        else:
            before, held, low = before + left, held - left, middle
    return before, held


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            counts = word_bounds(*texts_of(part.column(part.schema.get_field_index("text"))))[2]
            kept = [c for c in part.schema.names if c != "text"]
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*kept, "size"])


@dataclass(frozen=True)
class Mix:
    """``docs``: (doc_id, row if named, source, src, size, start) per row; ``slots``: (shard, slot, src, epoch, block, words);
    ``sources`` in order.  ``pieces()`` has the words of documents that the slots take."""

    docs: DataFrame
    slots: DataFrame
    sources: list[Source]
    block: int

    def pieces(self) -> DataFrame:
        """(src, start, epoch, from_word, to_word, n): word ranges of the document at ``start`` of its source."""
        b = self.block
        cut = self.docs.where("size > 0").select(
            "src", "start", "size",
            F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"),
        )
        taken = self.slots.groupBy("src", "epoch", "block", "words").agg(F.count("*").alias("n"))
        first = F.greatest(F.col("start"), F.col("block") * b)
        last = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
        return (
            cut.join(taken.hint("merge"), ["src", "block"])  # the slots' size is not known to the planner
            .select(
                "src", "start", "epoch", (first - F.col("start")).alias("from_word"), (last - F.col("start")).alias("to_word"), "n"
            )
            .where("to_word > from_word")
        )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 9,
    row: str | None = None,
) -> Mix:
    """Mix the sources' words by weight.

    A source's documents in doc_id order form a run of words, cut into blocks (the last may be short).  Every
    output shard draws how many slots each source gets; a source's slots count on over the shards, and slot k of pass e
    shows block ``permutation(source, e)(k)``.  The last slot of a source may take a part of its block, so that a source gives its
    target rounded to words.  No block is shown more often than ``most`` times.

    Null or blank texts have size 0 and nothing is taken from them; null is a source of its own, the last.  Rows that
    share a doc_id are taken one behind the other, by size and the text's checksum, those without one at the end; ``row`` names a column that tells rows
    apart and orders them then.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    rows = [] if row is None else [F.col(row).cast("long").alias("row")]
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), *rows, F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"),
    )
    counted = f"doc_id long, {'row long, ' * len(rows)}source string, mark long, size long"
    sizes = write_table(narrow.mapInArrow(_word_counter, counted), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    wanted = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    sources = [
        Source(r["source"], r["size"], t, min(round(t), most * r["size"])) for r, t in zip(found, wanted, strict=True)
    ]
    order = spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "_name string, src int")
    numbered = sizes.join(F.broadcast(order), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    placed = write_table(prefix_sums(numbered, "src", ["doc_id", *["row"] * len(rows), "size", "mark"], "size", "start"), "placed")
    ends = [_slots_of(s, block_words) for s in sources]
    totals = np.array([n for n, _ in ends], dtype=np.int64)
    shards = -(-int(totals.sum()) // shard_slots)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                before, counts = shard_counts(totals, shard_slots, int(shard), seed)
                rng = np.random.default_rng([seed, 1, int(shard)])
                deal = rng.permutation(np.repeat(np.arange(len(sources)), counts))
                epoch, block, words = (np.zeros(len(deal), np.int64) for _ in range(3))
                for i in np.flatnonzero(counts):
                    mine = np.flatnonzero(deal == i)
                    blocks = -(-sources[i].size // block_words)
                    k = before[i] + np.arange(len(mine))
                    passes = k // blocks
                    for e in np.unique(passes):
                        at = mine[passes == e]
                        epoch[at] = e
                        block[at] = Permutation(blocks, _key(sources[i], int(e)))(k[passes == e] - e * blocks)
                    words[mine] = np.where(k == totals[i] - 1, ends[i][1], block_words)
                yield pd.DataFrame(
                    {"shard": shard, "slot": np.arange(len(deal)), "src": deal.astype(np.int32), "epoch": epoch, "block": block, "words": words}
                )

    slots = spark.range(0, max(shards, 0), 1, max(1, min(shards, 4 * partitions(spark)))).mapInPandas(
        fill, "shard long, slot long, src int, epoch long, block long, words long"
    )
    return Mix(placed, slots, sources, block_words)


def taken(mixed: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row."""
    spark = mixed.docs.sparkSession
    gives = mixed.pieces().groupBy("src", "start").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("n")).alias("got"))
    known = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(mixed.sources)], "src int, source_size long, target double")
    docs = mixed.docs.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    return (
        docs.join(gives.withColumnRenamed("start", "key").hint("merge"), ["src", "key"], "left")
        .join(F.broadcast(known), "src")
        .select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, mixed: Mix, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text that the mix takes, one row per document and pass.

    Where a pass takes every word the text is left as it is; otherwise the taken runs of words follow one another, joined by
    a space.  A document that no slot shows is not in the mix.  ``doc_id`` must tell rows apart, or be the column that was
    the mix's ``row``.
    """
    key = "row" if "row" in mixed.docs.columns else "doc_id"
    runs = (
        mixed.pieces()
        .groupBy("src", "start", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_runs"))  # at most its blocks
        .join(mixed.docs.where("size > 0"), ["src", "start"])
        .select(F.col(key).alias("_doc"), "_runs", (F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["to_word"] - r["from_word"]) == F.col("size")).alias("_whole"))
    )
    shown = docs.join(runs, docs[doc_id].cast("long") == runs["_doc"]).drop("_doc")
    kept = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            whole = batch.column(batch.schema.get_field_index("_whole")).to_pylist()
            runs_of = batch.column(batch.schema.get_field_index("_runs"))
            out = []
            for i, (words, all_of_it) in enumerate(zip(texts, whole, strict=True)):
                if not all_of_it:
                    raw = words.encode()
                    starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    parts = [raw[starts[r["from_word"]] : ends[r["to_word"] - 1]] for r in runs_of[i].as_py()]
                    words = b" ".join(parts).decode()
                out.append(words)
            columns = [batch.column(batch.schema.get_field_index(c)) if c != text else pa.array(out, pa.string()) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return shown.mapInArrow(cut, docs.schema)
