"""Interaction of removal filters: counts per outcome pattern as a 2x2x2x2x2 tensor, contracted for every order and step.

Spark finds every document's outcomes and counts documents per part and pattern, at most 32 numbers a part for each count.
A part's counts are then one tensor with an axis per filter (pass, fail).  Every figure of the report is a contraction of that
tensor with one selector per axis: (1, 0) for pass, (0, 1) for fail, (1, 1) for all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The filters in the order of their axes, the least words, and what separates words.
FILTERS = "ABCDE"
LEAST_WORDS = 200
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_COUNTS = ("documents", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see a document alone, by name."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 3,
        "D": text.rlike(SYMBOLS),
    }


def outcomes(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, code, documents, good, toxic): documents per outcome pattern; bit 4 of ``code`` is filter A, bit 0 filter E.

    Equal texts meet by their SHA-256.  Copies are counted before they meet: per text, part and labels there is one row with the
    documents and the smallest doc_id, so a text that a third of all rows share is no hot group.
    """
    held = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    alone = held.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), *(c.cast("int").alias(k) for k, c in failures(F.col("text")).items()))
    coded = alone.select("id", "part", "sha", sum((F.col(k) * (1 << (4 - i)) for i, k in enumerate("ABCD")), F.lit(0)).alias("code"))
    known = labels.groupBy(F.col(doc_id).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    never = F.lit(False)
    labelled = coded.join(known, "id", "left").withColumns({"good": F.coalesce("good", never), "toxic": F.coalesce("toxic", never)})

    kind = ["sha", "part", "code", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    # no smaller doc_id has the text: the rows of the smallest doc_id, and rows without one
    least = F.min("first.id").over(Window.partitionBy("sha"))
    split = by_text.withColumn("passed", F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("fails"), F.col("passed").alias("n")), F.struct(F.lit(1).alias("fails"), (F.col("n") - F.col("passed")).alias("n"))))
    rows = split.select("part", "code", "good", "toxic", sides.alias("side"))
    return rows.groupBy("part", (F.col("code") + F.col("side.fails")).alias("code")).agg(
        F.sum("side.n").alias("documents"),
        F.sum(F.when(F.col("good"), F.col("side.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("side.n")).otherwise(0)).alias("toxic"),
    )


class Plan:
    """The selectors of all orders and steps: per figure, one row of selectors per (order, step) and axis."""

    def __init__(self, filters: str = FILTERS):
        size = len(filters)
        orders = list(permutations(range(size)))
        self.order = ["".join(filters[i] for i in o) for o in orders for _ in range(size)]
        self.step = [k + 1 for _ in orders for k in range(size)]
        self.filter = np.array([o[k] for o in orders for k in range(size)])
        figures = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
        for o in orders:
            for k, now in enumerate(o):
                before = set(o[:k])
                figures["kept"].append([_PASS if a in before or a == now else _ALL for a in range(size)])
                figures["removed"].append([_FAIL if a == now else _PASS if a in before else _ALL for a in range(size)])
                figures["failing"].append([_FAIL if a == now else _ALL for a in range(size)])
                figures["unique_fails"].append([_FAIL if a == now else _PASS for a in range(size)])
        self.selectors = {name: np.array(rows, np.int64) for name, rows in figures.items()}
        axes = "abcdefgh"[:size]
        self.spec = f"z{axes}," + ",".join(f"r{a}" for a in axes) + "->zr"

    def contract(self, tensor: np.ndarray, figure: str) -> np.ndarray:
        """One number per count (first axis of ``tensor``), order and step."""
        chosen = self.selectors[figure]
        return np.einsum(self.spec, tensor, *(chosen[:, a] for a in range(chosen.shape[1])), optimize=True)

    def report(self, tensor: np.ndarray) -> dict[str, np.ndarray]:
        kept, removed, failing, unique = (self.contract(tensor, f) for f in ("kept", "removed", "failing", "unique_fails"))
        shapley = np.zeros(self.filter.max() + 1, np.int64)
        np.add.at(shapley, self.filter, removed[0])
        return {
            "kept": kept[0], "removed": removed[0], "redundant": failing[0] - removed[0], "unique_fails": unique[0],
            "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[self.filter],
        }


_REPORT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row per part,
    order of the filters and step, zeros included.

    Null text is empty; a null ``part`` is the empty string.  A row without doc_id has no smaller one, and makes no other row a copy;
    rows that repeat a doc_id are documents of their own and not copies of each other.  A document is good (toxic) if any of its label
    rows says so.  An empty table gives no rows.
    """
    counted = outcomes(docs, labels, doc_id, text, part)
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("code", *_COUNTS)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan()
        rows = len(plan.order)
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.zeros((len(_COUNTS), 32), np.int64)
                for cell in held:
                    flat[:, cell["code"]] = [cell[c] for c in _COUNTS]
                figures = plan.report(flat.reshape(len(_COUNTS), 2, 2, 2, 2, 2))
                arrays = [pa.array([name] * rows, pa.string()), pa.array(plan.order), pa.array(plan.step, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *(pa.array(figures[f], pa.int64()) for f in _REPORT)], names=["part", "filter_order", "step", *_REPORT]
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in _REPORT)
    return cells.mapInArrow(run, schema)
