"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence_spark.sources.tables import write_table


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), both longs; a component is named by its smallest node.

    A round hangs every node's larger neighbours on the smallest node it sees, first over all neighbours and then over
    the smaller ones, so that paths halve: the rounds grow with the logarithm of the longest path.  Minima are combined before they are
    shuffled and no neighbourhood is collected.
    """
    def hung(links: DataFrame, view: DataFrame, larger: bool) -> DataFrame:
        least = view.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        seen = view.join(write_table(least, "least"), "a")
        if larger:
            moved = seen.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = seen.select(F.col("b").alias("a"), F.col("low").alias("b")).union(seen.select("a", F.col("low").alias("b")))
        return write_table(moved.where("a <> b").distinct(), "links")

    now = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    held = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == held:
            break
        held = mark
        now = hung(now, now.union(now.select(F.col("b"), F.col("a"))), True)
        now = hung(now, now, False)
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    whole = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(whole.select("node"), "node", "left_anti")
    return whole.union(alone.select("node", F.col("node").alias("component")))
