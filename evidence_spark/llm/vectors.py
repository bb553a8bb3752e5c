"""Near-duplicate vectors through an inverted multi-index: two codebooks, a grid of cells, multi-sequence visits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_spark.llm.common import components
from evidence_spark.llm.simhash import _Groups
from evidence_spark.sources.tables import write_table

THRESHOLD = 0.98
#: Rows that the codebooks are fitted on, and rounds of fitting.
SAMPLE_ROWS = 4096
FIT_ROUNDS = 12
#: Wanted vectors per cell and label; codewords per half at most.
CELL_ROWS = 60
MAX_WORDS = 128
#: Members of a cell that one task compares; larger cells are tiled.
TILE = 1024


def _codebook(rows: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Plain k-means; words that lose all rows keep their place."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:words]].copy()
    for _ in range(FIT_ROUNDS):
        near = ((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)).argmin(1)
        for k in np.unique(near):
            centres[k] = rows[near == k].mean(axis=0)
    return np.unique(centres, axis=0)


def _margins(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest word of each row, and each row's distance to the borders that keep it from the other words' cells."""
    square = np.maximum(0, (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1))
    near = square.argmin(1)
    apart = np.sqrt(np.maximum(1e-18, ((centres[:, None] - centres[None]) ** 2).sum(2)))
    gap = (square - square[np.arange(len(rows)), near][:, None]) / (2 * apart[near])
    gap[np.arange(len(rows)), near] = 0.0
    return near, np.maximum(0, gap)


def visits(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray]]:
    """Multi-sequence traversal: per row the cells (i * words + j) in order of joint margin, up to ``reach``.

    A vector within ``reach`` lies in a cell whose joint margin is no larger, so the recall of the visits is one.
    """
    width = second.shape[1]
    one, two = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    limit = (reach + 1e-9) ** 2
    for row in range(len(first)):
        a, b = first[row, one[row]] ** 2, second[row, two[row]] ** 2
        ends = np.searchsorted(b, limit - a, side="right")
        ends = ends[: int(np.searchsorted(a, limit, side="right"))]
        i = np.repeat(np.arange(len(ends)), ends)
        j = np.arange(len(i)) - np.repeat(np.cumsum(ends) - ends, ends)
        order = np.argsort(a[i] + b[j], kind="stable")
        yield row, one[row][i[order]] * width + two[row][j[order]]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), size)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by its largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _prober(left: np.ndarray, right: np.ndarray, size: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = size // 2
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                rows = _matrix(batch.column(3), size)
                unit = _unit(rows)
                near1, gap1 = _margins(unit[:, :half], left)
                near2, gap2 = _margins(unit[:, half:], right)
                own = near1 * len(right) + near2
                found = [cells for _, cells in visits(gap1, gap2, reach)]
                source = np.concatenate([np.arange(len(batch)), np.repeat(np.arange(len(batch)), [len(c) for c in found])])
                cells = np.concatenate([own, *found])
                member = np.arange(len(source)) < len(batch)
                taken = batch.take(pa.array(source))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cells, pa.int64()), pa.array(member)], names=[*batch.schema.names, "cell", "member"]
                )

    return run


def _comparer(size: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One tile: links of every visitor with the tile's members, and the tile's groups as edges to their first id."""
        batch = table.combine_chunks()
        rows = _matrix(batch.column("vec").combine_chunks(), size)
        unit = _unit(rows)
        rep = batch.column("rep").to_numpy()
        copies = batch.column("copies").to_numpy()
        member = batch.column("member").to_numpy(zero_copy_only=False).astype(bool)
        mine, seen = np.flatnonzero(member), np.flatnonzero(~member)
        ids, place = np.unique(rep, return_inverse=True)
        groups, links = _Groups(len(ids)), np.zeros(len(seen), np.int64)
        for low in range(0, len(seen), 2048):
            part = seen[low : low + 2048]
            near = (unit[part] @ unit[mine].T >= threshold) & (rep[part][:, None] != rep[mine][None, :])
            links[low : low + 2048] = near @ copies[mine]
            i, j = np.nonzero(near)
            groups.join(place[part[i]], place[mine[j]])
        some = links > 0
        return pa.table({"a": rep[seen][some], "b": ids[groups.label[place[seen[some]]]], "links": links[some]})

    return run


def _links(classes: DataFrame, size: int, rows: float, threshold: float) -> DataFrame:
    """(a, b, links) of the classes, all of length ``size``, with ``rows`` of them a label on average."""
    sample = np.array([r["vec"] for r in classes.select("vec", "k1").orderBy(F.xxhash64("k1"), "k1").limit(SAMPLE_ROWS).select("vec").collect()])
    sample = _unit(sample)
    words = int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, MAX_WORDS))
    half = size // 2
    left, right = _codebook(sample[:, :half], words, 1), _codebook(sample[:, half:], words, 2)
    reach = (2 - 2 * threshold) ** 0.5
    probes = write_table(
        classes.select("rep", "copies", "label", "vec").mapInArrow(
            _prober(left, right, size, reach), "rep long, copies long, label string, vec array<double>, cell long, member boolean"
        ),
        "probes",
    )
    cells = (
        probes.groupBy("label", "cell")
        .agg(F.count_if("member").alias("n"), F.count_if(~F.col("member")).alias("p"))
        .where("n > 0")
        .select("label", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("mine"), F.ceil(F.col("p") / (8 * TILE)).cast("int").alias("seen"))
    )
    known = probes.join(cells, ["label", "cell"])
    across = F.when(F.col("member"), F.col("seen")).otherwise(F.col("mine"))
    along = F.when(F.col("member"), F.pmod(F.xxhash64("rep"), "mine")).otherwise(F.pmod(F.xxhash64("rep"), "seen")).cast("int")
    tiled = known.select("*", along.alias("x"), F.explode(F.sequence(F.lit(0), across - 1)).alias("y")).select(
        "rep", "copies", "label", "vec", "cell", "member",
        F.when(F.col("member"), F.col("x")).otherwise(F.col("y")).alias("tile_a"),
        F.when(F.col("member"), F.col("y")).otherwise(F.col("x")).alias("tile_b"),
    )
    return write_table(
        tiled.groupBy("label", "cell", "tile_a", "tile_b").applyInArrow(_comparer(size, threshold), "a long, b long, links long"), "links"
    )


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors of one label are linked if their cosine reaches ``threshold``.  Equal vectors collapse to a class first.
    The codebooks of a length are fitted on at most ``SAMPLE_ROWS`` classes; every class is indexed.  Null labels, and vectors that are
    null, empty, zero, or hold null or non-finite components, link with nothing.  Only vectors of one length are compared;
    every length has codebooks and an index of its own.
    Rows that repeat a vec_id are different vectors of one id.  The component of vectors without an id only has none, and keeps them.
    """
    spark = vectors.sparkSession
    raw = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )
    number = F.lit(float("inf"))
    sound = F.coalesce(
        F.col("label").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < number), F.lit(False)))
        & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    rows = write_table(
        raw.withColumn("sound", sound).withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.xxhash64("vec", "label")), "vectors"
    )
    # a class is numbered: all its vectors may be without an id
    classes = write_table(
        rows.where("sound").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")
        ).withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    length = F.size("vec")
    shapes = classes.groupBy(length.alias("size")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).orderBy("size").collect()
    if not shapes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.union, (_links(classes.where(length == r["size"]), r["size"], r["n"] / r["labels"], threshold) for r in shapes))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    joined = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    grouped = write_table(
        classes.select("k1", "k2", "rep", "id", "copies").join(counts, "rep", "left").join(joined, "rep", "left").select(
            "k1", "k2", "id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("group")
        ),
        "grouped",
    )
    named = write_table(grouped.join(grouped.groupBy("group").agg(F.min("id").alias("c")), "group").select("k1", "k2", "n", "c"), "named")
    known = rows.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("sound"), F.col("c")).otherwise(F.col("vec_id"))
    return known.select(
        "vec_id",
        F.when(F.col("sound"), F.col("n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
