"""Hilbert-curve ordering of documents by metadata, cut into shards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.llm.common import global_rank
from evidence_spark.sources.tables import broadcast_checked, write_table

SHARDS = 16
#: Bits per dimension: 2**BITS steps along each axis.
BITS = 6


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n rows, d columns, values below 2**bits).

    From the highest bit down, the point is reflected or has axes exchanged so that each sub-cube is
    walked in the orientation that joins its neighbours; a Gray decode of the interleaved bits gives the index.
    """
    x = axes.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    index = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[:, i] >> bit) & 1)
    return index


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings of a column replaced by their rank among its distinct ones; null stays null."""
    ranked = global_rank(rows.where(F.col(name).isNotNull()).select(name).distinct(), [name], "_rank")
    return rows.join(broadcast_checked(ranked), name, "left").drop(name).withColumnRenamed("_rank", name)


def hilbert_order(docs: DataFrame, dimensions: Sequence[Column], keep: Sequence[Column], bits: int = BITS) -> DataFrame:
    """The kept columns with ``hilbert``; every dimension is a number cut at its quantiles, null lowest.

    Quantiles are approximate aggregates of all rows (2**bits - 1 cut points a dimension, whatever the input).
    """
    names = [f"_d{i}" for i in range(len(dimensions))]
    rows = write_table(docs.select(*keep, *(d.cast("long").alias(n) for d, n in zip(dimensions, names, strict=True))), "dimensions")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*(F.percentile_approx(n, steps, 10_000).alias(n) for n in names)).first()
    bounds = [np.unique(np.array(cuts[n] or [], dtype=np.int64)) for n in names]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = np.zeros((len(batch), len(names)), np.int64)
            for i, name in enumerate(names):
                column = batch.column(batch.schema.get_field_index(name))
                known = ~column.is_null().to_numpy(zero_copy_only=False)
                values = column.fill_null(0).to_numpy(zero_copy_only=False)
                axes[:, i] = np.where(known, np.searchsorted(bounds[i], values, side="right"), 0)
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(hilbert_index(axes, bits))],
                names=[*kept, "hilbert"],
            )

    schema = rows.drop(*names).withColumn("hilbert", F.lit(0).cast("long")).schema
    return rows.mapInArrow(placed, schema)


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    Dimensions: language and source by rank among their distinct strings, size and doc_id.  The curve's order (ties by doc_id, then checksum) is cut into
    runs whose row counts differ by one at most: law ``rows``.  ``slot`` counts along the curve.  Size is the UTF-8
    bytes of the text plus one; null has none, and the checksum of the empty text.
    """
    content = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + 1
    keep = [
        F.col(doc_id).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(F.coalesce(content, F.lit("")), "UTF-8")).alias("text_crc32"),
    ]
    kept = ["doc_id", "size", "text_crc32"]
    narrow = docs.select(*keep, F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"))
    numbered = _numbered(_numbered(narrow, "_lang"), "_source")
    dimensions = [F.col("_lang"), F.col("_source"), F.col("size"), F.col("doc_id")]
    ordered = global_rank(hilbert_order(numbered, dimensions, [F.col(c) for c in kept], bits), ["hilbert", "doc_id", "text_crc32"], "rank")
    ordered = write_table(ordered, "hilbert")
    rows = max(1, ordered.count())
    place = F.expr(f"cast(rank * {shards} div {rows} as int)")
    first = F.expr(f"(shard * cast({rows} as bigint) + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("shard", place)
        .withColumn("slot", F.col("rank") - first)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
        )
    )
