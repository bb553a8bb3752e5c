"""Gap-free numbering that never sorts a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_within(df: DataFrame, group: list[str], order: str, out: str, block: int = 10_000) -> DataFrame:
    """Number rows 1..n per group by a unique, non-negative integer column.

    The order column is cut into blocks.  Only the block counts are summed along
    a group; the rows themselves are ranked inside a block, so a group that holds
    most of the table is spread over as many tasks as it has blocks.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    along = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, "_block")
        .count()
        .select(*group, "_block", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_block"])
        .withColumn(out, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_block", "_rank", "_offset")
    )
