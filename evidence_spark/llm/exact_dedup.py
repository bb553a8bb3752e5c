"""Grace hash deduplication of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import partitions
from evidence_spark.sources.tables import write_table

#: Bytes of distinct content that one bucket's table may hold.
TABLE_BYTES = 64 << 20
#: Levels of partitioning before the job gives up.
MAX_LEVELS = 24


class ContentTable:
    """Open addressing over complete contents: linear probing, doubled when 60 % full."""

    def __init__(self, limit: int | None = None):
        self.limit, self.used = limit, 0
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def _place(self, hashed: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = (hashed ^ (hashed >> 32)) & mask
        while (held := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[held] == hashed and self.contents[held] == content:
                return held
            at = (at + 1) & mask
        return -1 - at

    def find_or_add(self, hashed: int, content: bytes) -> tuple[int, bool]:
        """Number of the content and whether it is new; (-1, False) if it is new and the table is full."""
        held = self._place(hashed, content)
        if held >= 0:
            return held, False
        if self.limit is not None and self.used and self.used + len(content) > self.limit:
            return -1, False
        self.slots[-1 - held] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.used += len(content) + 64
        if len(self.contents) * 10 > len(self.slots) * 6:
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for number, known in enumerate(self.hashes):
                self.slots[-1 - self._place(known, None)] = number
        return len(self.contents) - 1, True


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the copies inside a batch become one record with the list of their ids."""
    for batch in batches:
        table, ids, hashes = ContentTable(), [], []
        for doc, hashed, content in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
        ):
            number, new = table.find_or_add(hashed, content)
            if new:
                ids.append([doc])
                hashes.append(hashed)
            else:
                ids[number].append(doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.list_(pa.int64())), pa.array(hashes, pa.int64()), pa.array(table.contents, pa.binary())],
            names=["ids", "h", "content"],
        )


def _resolver(limit: int, level: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: a content in the table gets its class at once; once the table is full, contents that
        are not in it are spilled, all their records alike, to the next level."""
        table, digests = ContentTable(limit), []
        first = (level << 56) | (TaskContext.get().partitionId() << 32)  # classes are named apart from ids, which may be null
        for batch in batches:
            out: list[tuple] = []
            for ids, hashed, content in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                number, new = table.find_or_add(hashed, content)
                if number < 0:
                    out.append((ids, hashed, content, None, None))
                    continue
                if new:
                    digests.append(hashlib.sha256(content).hexdigest())
                out.append((ids, hashed, None, first + number, digests[number]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["ids", "h", "content", "class_id", "sha256"],
            )

    return resolve


def group_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, buckets: int | None = None
) -> DataFrame:
    """Equal texts with their staying row: (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Copies inside an Arrow batch are collapsed before the shuffle, so a text that a third of all rows
    hold is one record per batch.  A Spark partition is a bucket of the current level; the shuffle files
    are its spill.  Contents beyond the table's bound go to a written table and are partitioned
    anew by other hash digits, level by level, until nothing is spilled.

    Null is the empty text.  Texts are compared byte by byte.  The largest doc_id of a group stays; rows that
    repeat both doc_id and text stay or go together.  ``kept`` of a row without a doc_id is null, and ``keep_id`` too where
    no row of the group has one.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    count = buckets or partitions(spark)
    records = (
        docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        .select("id", F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("content"))
        .mapInArrow(_collapsed, "ids array<long>, h long, content binary")
    )
    done = []
    for level in range(MAX_LEVELS):
        dealt = records.repartition(count, F.xxhash64("h", F.lit(level)))
        settled = write_table(
            dealt.mapInArrow(
                _resolver(table_bytes, level), "ids array<long>, h long, content binary, class_id long, sha256 string"
            ),
            f"grace{level}",
        )
        done.append(settled.where("class_id is not null").select("class_id", "h", "ids", "sha256"))
        records = settled.where("class_id is null").select("ids", "h", "content")
        if records.isEmpty():
            break
    else:
        raise RuntimeError("buckets do not fit; raise table_bytes or buckets")
    classes = done[0]
    for more in done[1:]:
        classes = classes.union(more)
    sizes = classes.groupBy("class_id", "h").agg(
        F.max(F.array_max("ids")).alias("keep_id"), F.sum(F.size("ids")).cast("long").alias("group_size")
    )
    return (
        classes.join(sizes, ["class_id", "h"])
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", F.col("sha256").alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    )
