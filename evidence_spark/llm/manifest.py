"""Merkle manifest of a dataset by a nested-struct rollup.

A leaf's rank among its language is written in digits of base ``FAN``.  Inside a block of ``FAN ** LEVELS`` leaves the digits
are grouped away one after the other, the last first: a group's rows become the child structs of one node, whose digest covers
theirs.  A block is one row of bounded size.  Blocks are the leaves of the next tier, until every group has one block; the group's
digests are then the leaves of one more such tree.

Proofs come back the same way.  A tier's nodes are transformed to children with their siblings and exploded, level by level;
what a block inherits from the tier above meets it in a group of two rows.  There is no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.llm.common import global_rank, prefix_sums
from evidence_spark.sources.tables import write_table

#: Children of a node, and levels inside one block: 4,096 leaves, about a megabyte.
FAN = 8
LEVELS = 4
_BITS = FAN.bit_length() - 1
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows give one input; a null is a dash."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row, with ``text`` in place of the column of that name."""
    return digest(F.concat(*(field(text if text is not None and f == "text" else F.col(f)) for f in fields)))


@dataclass
class Tree:
    """The tiers of a forest, the lowest first: rows (grp, block, node), and per group (grp, top) the digest of its tree."""

    tiers: list[DataFrame]
    tops: DataFrame


def _names(level: int) -> list[str]:
    return [f"d{i}" for i in reversed(range(level, LEVELS))]


def _tier(items: DataFrame) -> DataFrame:
    """(grp, block, node) from (grp, rank, node): digits grouped away inside blocks, one exchange for all levels."""
    now = items.select(
        "grp",
        F.shiftright("rank", _BITS * LEVELS).alias("block"),
        *(F.shiftright("rank", _BITS * i).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{i}") for i in range(LEVELS)),
        "node",
    ).repartition("grp", "block")
    for level in range(LEVELS):
        kids = F.sort_array(F.collect_list(F.struct(f"d{level}", F.col("node.hash").alias("hash"), F.col("node.solo").alias("solo"), "node")))
        grouped = now.groupBy("grp", "block", *_names(level + 1)).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        inner = F.transform("kids", lambda k: k["node"])
        # a group that has only this one child needs no further level: its tree ends at the child
        now = grouped.select("grp", "block", *_names(level + 1), digest(joined).alias("hash"), F.col("kids")[0]["solo"].alias("only"), inner.alias("kids"))
        solo = F.when(F.size("kids") == 1, F.col("only")).otherwise(F.col("hash"))
        now = now.select("grp", "block", *_names(level + 1), F.struct("hash", solo.alias("solo"), "kids").alias("node"))
    return now


def grow(items: DataFrame, name: str) -> Tree:
    """Trees of the groups of ``items`` (grp, rank, node), node being a struct that begins with ``hash`` and ``solo``."""
    tiers, now = [], items
    while True:
        tier = write_table(_tier(now), name)
        tiers.append(tier)
        if tier.where("block > 0").isEmpty():
            return Tree(tiers, tier.select("grp", F.col("node.solo").alias("top")))
        now = tier.select("grp", F.col("block").alias("rank"), F.struct("node.hash", "node.solo").alias("node"))


_STEPS = "array<struct<left:string,right:string>>"


def _opened(rows: DataFrame, held: list[str]) -> DataFrame:
    """Rows (held, steps, sole, node) of a node's children, ``LEVELS`` times; ``rank`` counts along."""
    for _ in range(LEVELS):
        hashes = F.transform("node.kids", lambda k: k["hash"])
        many = F.size("node.kids") > 1
        rows = rows.withColumn("hashes", hashes).withColumn("still", F.col("sole") & ~many)
        kids = F.transform("node.kids", lambda k, i: F.struct(i.cast("long").alias("digit"), k.alias("node")))
        rows = rows.select(*held, "steps", "still", "hashes", "rank", F.explode(kids).alias("kid"))
        step = F.struct(
            F.array_join(F.slice("hashes", F.lit(1), F.col("kid.digit").cast("int")), "").alias("left"),
            F.array_join(F.slice("hashes", F.col("kid.digit").cast("int") + 2, F.lit(FAN)), "").alias("right"),
        )
        rows = rows.select(
            *held,
            F.when(F.col("still"), F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps"))).alias("steps"),
            F.col("still").alias("sole"),
            (F.col("rank") * FAN + F.col("kid.digit")).alias("rank"),
            F.col("kid.node").alias("node"),
        )
    return rows


def proofs(tree: Tree, above: DataFrame, held: list[str]) -> DataFrame:
    """(grp, rank, held, steps, node) of all leaves; ``above`` has (grp, held, steps) of every group.

    ``steps`` are the siblings left and right of the path, from the leaf up.
    """
    carried = above.select("grp", F.lit(0).cast("long").alias("block"), F.struct(*held, "steps", F.lit(True).alias("sole")).alias("above"))
    for number, tier in enumerate(reversed(tree.tiers)):
        node = tier.schema["node"].dataType
        both = tier.select("grp", "block", "node", F.lit(None).cast(carried.schema["above"].dataType).alias("above")).unionByName(
            carried.select("grp", "block", F.lit(None).cast(node).alias("node"), "above")
        )
        met = both.groupBy("grp", "block").agg(F.first("node", ignorenulls=True).alias("node"), F.first("above", ignorenulls=True).alias("above"))
        opened = _opened(met.select("grp", *(f"above.{h}" for h in held), "above.steps", "above.sole", F.col("block").alias("rank"), "node"), ["grp", *held])
        if number + 1 == len(tree.tiers):
            return opened
        carried = opened.select("grp", F.col("rank").alias("block"), F.struct(*held, "steps", "sole").alias("above"))
    raise ValueError("a tree has a tier")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda held, s: digest(F.concat(s["left"], held, s["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of ``docs``.

    Where ``tampered`` holds, the leaf of the check is that of the row with ``changed`` in place of its text; by default the
    text's A-Z are lower-cased where 3 divides the checksum of the doc_id.  Every other column of a leaf's row is covered by its digest; further
    columns are not.  Rows without doc_id come last in their language and are not tampered with; rows that repeat a doc_id follow each
    other by their leaf.  Equal rows are leaves of their own.  An empty table gives no rows.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    if changed is None:
        changed = F.translate("text", _UPPER, _LOWER)
    leaves = write_table(
        docs.select("doc_id", F.col("lang").alias("grp"), leaf_of().alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), leaf_of(changed)).alias("other")),
        "leaves",
    )
    ranked = prefix_sums(leaves.withColumn("one", F.lit(1).cast("long")), "grp", ["doc_id", "leaf"], "one", "rank")
    node = F.struct(F.col("leaf").alias("hash"), F.col("leaf").alias("solo"), "doc_id", "other")
    parts = grow(ranked.select("grp", "rank", node.alias("node")), "parts")

    tops = parts.tops.withColumn("named", F.col("grp").isNotNull())
    ordered = global_rank(tops, ["named", "grp"], "rank")
    top = F.struct(F.col("top").alias("hash"), F.col("top").alias("solo"), F.col("grp").alias("part"))
    whole = grow(ordered.select(F.lit(0).alias("grp"), "rank", top.alias("node")), "roots")
    start = whole.tops.select("grp", F.col("top").alias("root"), F.array().cast(_STEPS).alias("steps"))
    of_part = proofs(whole, start, ["root"]).select(F.col("node.part").alias("grp"), F.col("node.hash").alias("subroot"), "root", "steps")

    found = proofs(parts, of_part, ["subroot", "root"])
    given = found.select(
        F.col("node.doc_id").alias("doc_id"),
        F.col("node.hash").alias("leaf"),
        "subroot",
        "root",
        digest(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
        folded(F.coalesce("node.other", "node.hash"), F.col("steps")).alias("folded_root"),
    )
    return given.withColumn("verified", F.col("folded_root") == F.col("root"))
