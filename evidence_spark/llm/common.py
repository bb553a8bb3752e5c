"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidence_spark.sources.tables import write_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number of its own for every row, written, so that all uses see the same numbers."""
    return write_table(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def with_document_key(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) for the rows (doc_id, text), and (key, doc_id) where the key is not the doc_id itself.

    Rows that repeat doc_id and text share a key.  Keys follow doc_id, null last; texts that share a doc_id (or have none)
    get keys of their own, in order of their checksum.  Only then are rows numbered: ids that tell texts apart are the keys.
    """
    hashed = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    if hashed.where("doc_id is null or low <> high").isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "text"), None
    marked = docs.withColumn("_sha", F.sha2("text", 256))
    keys = write_table(global_rank(marked.select("doc_id", "_sha").distinct(), ["doc_id", "_sha"], "key"), "keys")
    named = keys.select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_name"), "key")
    same = marked["doc_id"].eqNullSafe(named["_id"]) & (marked["_sha"] == named["_name"])
    return write_table(marked.join(named, same).select("key", "text"), "keyed"), keys.select("key", "doc_id")


def with_ids(result: DataFrame, keys: DataFrame | None) -> DataFrame:
    """``result`` with its keys, in the column doc_id, turned back into ids."""
    if keys is None:
        return result
    columns = result.columns
    return result.withColumnRenamed("doc_id", "key").join(keys, "key").select(*columns)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose result is written.

    Spark deletes them when the driver has collected the plan as garbage, which a driver with memory to spare does
    rarely; until then every step's files lie on the disks.  Nothing depends on it: results are the same without.
    A step's plan is still held for a moment after its end, until the last of its events is handled.
    """
    for pause in (0.5, 1.0):
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = wide.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of ``text`` (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = texts_of(column)
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(batch))
        yield batch.slice(start, end - start)
        start = end


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``body`` (words never cross texts), and the word count of every text."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    word = ~IS_SPACE[body]
    first = np.zeros(len(body) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first[len(body)] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in ``order``, without one task that sees them all.

    A range-partitioned sort numbers the rows of a partition; only the partitions' row
    counts are summed in one place.  ``order`` should tell rows apart; ties stay in one partition.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = write_table(
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33)
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``group``; a hot group spreads over partitions."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in (group, *order)]
    schema = df.select("*", F.lit(0).cast("long").alias("_part"), F.lit(0).cast("long").alias("_inside")).schema

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(batch.schema.get_field_index(group))
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = codes.dictionary_encode()
            marks = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
            sums = np.cumsum(values) - values
            base = np.repeat(sums[heads], np.diff(np.append(heads, len(marks))))
            inside = sums - base
            first = codes[0].as_py()
            if first == last:
                inside[: heads[1] if len(heads) > 1 else len(marks)] += total
            last, total = codes[len(codes) - 1].as_py(), int(inside[-1] + values[-1])
            at = batch.schema.get_field_index("_at")
            part = batch.column(at).to_numpy(zero_copy_only=False) >> 33
            names = [n for n in batch.schema.names if n != "_at"]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(part), pa.array(inside)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_part", "_inside"])

    placed = write_table(
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .mapInArrow(running, schema),
        "prefix",
    )
    along = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(F.col(group), F.col("_part"))
        .agg(F.sum(value).alias("_n"))
        .select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    )
    joined = placed.join(offsets, placed[group].eqNullSafe(F.col("_g")) & (placed["_part"] == F.col("_p")))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_g", "_p", "_before")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, component) per node that has an
    edge to another one; the component is its smallest node.

    Large-star and small-star rounds rewrite the edges until each hangs from its smallest node.
    Minima are aggregated before they are shuffled and written before they are joined, so that a hub's
    edges can be split over tasks.  Self-loops and repeated edges do not matter.
    """
    def starred(e: DataFrame, both: bool) -> DataFrame:
        seen = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if both else e
        least = write_table(seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "minima")
        joined = seen.join(least, "a")
        if both:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return write_table(moved.where("a != b").distinct(), "stars")

    def mark(e: DataFrame):
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return row[0], row[1]

    now = write_table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges"
    )
    state = mark(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = starred(starred(now, True), False)
        after = mark(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle; raise rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)
