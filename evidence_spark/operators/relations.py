"""Relationship types, competing passages and keyword proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_spark.functions.text import bind, compute, contains_any, first_index, strip, window_around, words
from evidence_spark.sources.tables import broadcast_checked

UNSPECIFIED = "UNSPECIFIED"
SNIPPET_WIDTH = 80
PROXIMITY_WIDTH = 80

# Relationship types in order of priority, each with its keywords in order.
RELATIONSHIPS = (
    ("SUPPLIES", ("מספק", "מספקת", "מספקים", "אספקת דם", "supplies", "supplying")),
    ("INNERVATES", ("מעצבב", "מעצבבת", "עצבוב", "innervates", "innervating")),
    (
        "CONNECTS",
        ("מחבר", "מחברת", "מחברים", "מקשר", "connects", "connect ", "connecting", "connection between"),
    ),
    (
        "CONTAINS",
        ("כולל", "כוללת", "כוללים", "מכיל", "מכילה", "מורכב מ", "מורכבת מ", "contains", "consists of", "composed of"),
    ),
    ("PROJECTS_TO", ("מקרין", "מקרינה", "פרויקציה", "projects to", "projecting to")),
    ("LOCATED_IN", ("ממוקם", "ממוקמת", "נמצא ב", "נמצאת ב", "located in", "found in")),
    (
        "DEVELOPS_INTO",
        ("מתפתח מ", "מתפתחת מ", "מתפתח ל", "מתפתחת ל", "develops from", "develops into", "developing from"),
    ),
    (
        "RECEIVES_INPUT_FROM",
        ("מקבל קלט מ", "מקבלת קלט מ", "מקבל מידע מ", "מקבלת מידע מ", "receives input from"),
    ),
    ("DRAINS_INTO", ("מתנקז", "מתנקזת", "מנקז", "מנקזת", "drains into", "draining into")),
    ("SURROUNDS", ("מקיף", "מקיפה", "עוטף", "עוטפת", "surrounds", "surrounding")),
)


def classify(lowered: Column, lexicon=None) -> Column:
    """The first relationship type with a keyword in an already lower-cased text."""
    choice = None
    for name, keywords in lexicon or RELATIONSHIPS:
        hit = contains_any(lowered, [k.lower() for k in keywords])
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return choice.otherwise(UNSPECIFIED)


def keyword_snippet(text: Column, relationship: Column, lexicon=None) -> Column:
    """Text around the first keyword (in lexicon order) of the relationship; null if none occurs.

    Positions come from the lower-cased text and are applied to the original.
    """
    lowered = F.lower(text)

    def around(keyword: str) -> Column:
        width = F.lit(len(keyword))
        return bind(
            first_index(lowered, F.lit(keyword.lower())),
            lambda at: F.when(at >= 0, strip(window_around(text, at, width, SNIPPET_WIDTH))),
        )

    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, keywords in lexicon or RELATIONSHIPS:
        choice = choice.when(relationship == name, F.coalesce(*[around(k) for k in keywords]))
    return choice


def discover_competitors(targets: DataFrame, evidence: DataFrame, lexicon=None) -> DataFrame:
    """Other chunks of the target's scope with its relationship, in rank order.

    ``targets`` has scope, target_id, relationship and own_chunks.  The pairs are
    bounded by the evidence per scope, and only targets with a relationship join.
    """
    asked = targets.where(F.col("relationship") != UNSPECIFIED).select(
        "scope", "target_id", "relationship", "own_chunks"
    )
    pairs = asked.join(evidence.select("scope", "rank", "chunk_id", "text"), "scope").where(
        ~F.array_contains("own_chunks", F.col("chunk_id"))
    )
    return (
        compute(pairs, "snippet", keyword_snippet(F.col("text"), F.col("relationship"), lexicon))
        .where(F.col("snippet").isNotNull())
        .select("scope", "target_id", "rank", "chunk_id", "relationship", "snippet")
    )


def proximity_hits(concepts: DataFrame, evidence: DataFrame, lexicon=None) -> DataFrame:
    """Every keyword occurrence with a longer word of the concept close by.

    The keyword windows are cut once per chunk and only then met with the concepts
    of the scope.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("relationship"), F.lit(k.lower()).alias("keyword"))
            for name, keywords in (lexicon or RELATIONSHIPS)
            for k in keywords
        ]
    )
    lowered = F.lower("text")
    keyed = (
        evidence.select("scope", "chunk_id", "text", lowered.alias("lowered"), F.explode(entries).alias("e"))
        .where(F.col("lowered").contains(F.col("e.keyword")))
        .withColumn("size", F.length("e.keyword"))
    )
    places = F.filter(
        F.sequence(F.lit(1), F.length("lowered")),
        lambda i: F.substring("lowered", i, F.col("size")) == F.col("e.keyword"),
    )
    windows = keyed.select("scope", "chunk_id", "text", "size", "e.relationship", F.explode(places).alias("i")).select(
        "scope",
        "chunk_id",
        "relationship",
        F.col("i").alias("position"),
        window_around("text", F.col("i") - 1, F.col("size"), PROXIMITY_WIDTH).alias("window"),
    )
    long_words = F.filter(words(F.lower("concept")), lambda w: F.length(w) >= 4)
    named = concepts.select("scope", "concept", long_words.alias("long_words")).where(F.size("long_words") > 0)
    near = F.exists("long_words", lambda w: F.lower("window").contains(w))
    return (
        windows.join(named, "scope")
        .where(near)
        .select(
            "scope",
            "concept",
            "chunk_id",
            "relationship",
            "position",
            strip(F.translate("window", "\n", " ")).alias("snippet"),
        )
    )


def mention_counts(concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """In how many chunks of its scope a concept is mentioned."""
    return (
        concepts.select("scope", "concept")
        .join(evidence.select("scope", "chunk_id", "text"), "scope")
        .where(F.col("text").contains(F.col("concept")))
        .groupBy("scope", "concept")
        .agg(F.count_distinct("chunk_id").alias("mentions"))
    )


def literal_facts(evidence: DataFrame, needles: list[str]) -> DataFrame:
    """Which of the needles occur anywhere in a scope's evidence."""
    table = F.array(
        *[F.struct(F.lit(n).alias("needle"), F.col("text").contains(n).alias("hit")) for n in needles]
    )
    return (
        evidence.select("scope", F.explode(table).alias("n"))
        .groupBy("scope", "n.needle")
        .agg(F.bool_or("n.hit").alias("present"))
    )


def with_default_strategy(targets: DataFrame, strategies: DataFrame | None) -> DataFrame:
    """Add ``strategy``: the approved one for exactly this category and topic, else DEFAULT."""
    if strategies is None:
        return targets.withColumn("strategy", F.lit("DEFAULT"))
    approved = strategies.select("category", "topic", F.col("strategy")).distinct()
    return targets.join(broadcast_checked(approved), ["category", "topic"], "left").withColumn(
        "strategy", F.coalesce("strategy", F.lit("DEFAULT"))
    )
