"""Analysis of recorded attempts: question shapes, strategies and candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence_spark.functions.text import Text, bind, col, contains_any, first_index, words

# Phrases that give a question its shape.
MEMBERSHIP_MARKERS = ("חלק מ", "מהווה חלק", "שייך ל", "שייכת ל", "נמצא בתוך", "נמצאת בתוך")
COPULAS = ("הוא ", "היא ")
SHAPE_NAMING_CUES = ("הנקרא", "הנקראת", "מוכר גם כ", "ידוע גם כ", "הידוע כ")
SHAPE_PROPERTY_MARKERS = (
    "תפקיד",
    "מקור",
    "משפיע",
    "ממוקם",
    "משויך",
    "מאפשר",
    "מדכא",
    "מפעיל",
    "תורם",
    "אחראי",
)
STRATEGY_PROPERTY_MARKERS = (
    "תפקיד",
    "מקור",
    "משפיע",
    "ממוקם",
    "משויך",
    "מאפשר",
    "חלק מ",
    "המכיל",
    "נחשב ל",
)
STRATEGY_NAMING_CUES = ("הנקרא", "הנקראת", "מוכר גם כ", "ידוע גם כ")
NAMING_REACH = 40
COPULA_REACH = 30

# Weights and thresholds of the candidate score.
IDENTITY_CAP, IDENTITY_WEIGHT = 3, 2
REJECTED_CAP = 4
CONTRAST, CONTRAST_BONUS = 0.4, 2
ENOUGH_ATTEMPTS = 4
NO_IDENTITY_PENALTY = 2
TIER_A, TIER_A_IDENTITY, TIER_B = 6, 2, 3
MIN_INVENTORY = 10
SAMPLE_SIZE = 8


def target_words(target: Text) -> Column:
    """The longer words of a target, lower-cased."""
    return F.filter(words(F.lower(col(target))), lambda w: F.length(w) >= 4)


def _names(text: Column, target: Text) -> Column:
    lowered = F.lower(text)
    return F.exists(target_words(target), lambda w: lowered.contains(w))


def question_shape(
    question: Text,
    target: Text,
    membership=MEMBERSHIP_MARKERS,
    copulas=COPULAS,
    naming=SHAPE_NAMING_CUES,
    properties=SHAPE_PROPERTY_MARKERS,
) -> Column:
    """IDENTITY, CLASSIFICATION_MEMBERSHIP, PROPERTY or OTHER_UNKNOWN."""
    question = col(question)
    member = contains_any(question, membership)
    identity = _names(question, target) & contains_any(question, (*copulas, *naming)) & ~member
    return (
        F.when(identity, "IDENTITY")
        .when(member, "CLASSIFICATION_MEMBERSHIP")
        .when(contains_any(question, properties), "PROPERTY")
        .otherwise("OTHER_UNKNOWN")
    )


def strategy(
    question: Text,
    target: Text,
    naming=STRATEGY_NAMING_CUES,
    copulas=COPULAS,
    properties=STRATEGY_PROPERTY_MARKERS,
) -> Column:
    """IDENTITY, PROPERTY or OTHER/UNCLEAR, looking for the target close to a phrase.

    Of a naming cue only the first place counts, of a copula every one.
    """
    question = col(question)
    marked = contains_any(question, properties)

    def after_cue(cue: str) -> Column:
        return bind(
            first_index(question, F.lit(cue)),
            lambda at: (at >= 0) & _names(F.substring(question, at + 1, F.lit(NAMING_REACH)), target),
        )

    def after_copula(copula: str) -> Column:
        # Splitting leaves what follows each occurrence; the text is cut there again for its full reach.
        parts = F.split(question, rf"\Q{copula}\E", -1)
        rests = F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda _p, i: F.substring(
                F.array_join(F.slice(parts, i + 2, F.size(parts)), copula), 1, COPULA_REACH
            ),
        )
        return F.exists(rests, lambda rest: _names(rest, target))

    named, linked = F.lit(False), F.lit(False)
    for cue in naming:
        named = named | after_cue(cue)
    for copula in copulas:
        linked = linked | after_copula(copula)
    return (
        F.when(named | (linked & ~marked), "IDENTITY").when(marked, "PROPERTY").otherwise("OTHER/UNCLEAR")
    )


def strategy_counts(attempts: DataFrame) -> DataFrame:
    """Attempts per target group, strategy and acceptance."""
    return attempts.groupBy("target_group", "strategy", "accepted").agg(F.count("*").alias("attempts"))


def attempts_saved(attempts: DataFrame) -> DataFrame:
    """Attempts made before the first IDENTITY attempt, per round that had one, and in total.

    Places inside a round are counted against the round's first identity attempt;
    no round is sorted.
    """
    first = attempts.groupBy("source", "round").agg(
        F.min(F.when(F.col("strategy") == "IDENTITY", F.col("attempt_number"))).alias("_first")
    )
    earlier = attempts.join(first.where(F.col("_first").isNotNull()), ["source", "round"])
    return earlier.agg(
        F.count_distinct("source", "round").alias("rounds"),
        F.count_if(F.col("attempt_number") < F.col("_first")).alias("attempts_saved"),
    )


def tag_order(attempts: DataFrame) -> DataFrame:
    """When an accepted identity question came: at once, after failures, or unknown."""
    relevant = (F.col("shape") == "IDENTITY") & F.col("accepted")
    return attempts.withColumn(
        "retrospective_order",
        F.when(~relevant, None)
        .when(F.col("attempt_number").isNull(), "UNKNOWN")
        .when(F.col("attempt_number") == 1, "FIRST_ATTEMPT")
        .otherwise("AFTER_PRIOR_FAILURE"),
    )


def rounded_rate(part: Column, whole: Column) -> Column:
    """Three digits, half to even; null over nothing."""
    return F.bround(part / F.nullif(whole, F.lit(0)), 3)


def by_target(attempts: DataFrame) -> DataFrame:
    """Per category and target: attempts, acceptance and rates by question shape."""
    shape = F.coalesce("shape", F.lit("OTHER_UNKNOWN"))
    shapes = {
        "property": "PROPERTY",
        "identity": "IDENTITY",
        "classification_membership": "CLASSIFICATION_MEMBERSHIP",
        "other_unknown": "OTHER_UNKNOWN",
    }
    orders = {
        "first_attempt_identity_count": "FIRST_ATTEMPT",
        "post_failure_identity_count": "AFTER_PRIOR_FAILURE",
        "unknown_order_identity_count": "UNKNOWN",
    }
    counts = attempts.groupBy("category", "target").agg(
        F.count("*").alias("total_attempts"),
        F.count_if("accepted").alias("total_accepted"),
        F.count_if("has_detail").alias("detailed_attempts"),
        F.count_if(~F.col("has_detail")).alias("round_level_only"),
        *[F.count_if(shape == s).alias(f"{n}_attempts") for n, s in shapes.items()],
        *[F.count_if((shape == s) & F.col("accepted")).alias(f"{n}_accepted") for n, s in shapes.items()],
        *[F.count_if(F.col("retrospective_order") == o).alias(n) for n, o in orders.items()],
        F.sort_array(F.collect_set("source")).alias("sources"),
    )
    return counts.select(
        "*",
        rounded_rate(F.col("total_accepted"), F.col("total_attempts")).alias("overall_rate"),
        rounded_rate(F.col("property_accepted"), F.col("property_attempts")).alias("property_rate"),
        rounded_rate(F.col("identity_accepted"), F.col("identity_attempts")).alias("identity_rate"),
    )


def rank_candidates(targets: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Score and tier of every target that is not approved yet, best first."""
    if approved is not None:
        targets = targets.join(approved.select("category", "target").distinct(), ["category", "target"], "left_anti")
    c = F.col
    bonus = lambda test, points: F.when(test, points).otherwise(0)
    score = (
        F.least(c("identity_accepted"), F.lit(IDENTITY_CAP)) * IDENTITY_WEIGHT
        + F.least(c("property_attempts") - c("property_accepted"), F.lit(REJECTED_CAP))
        + bonus(c("identity_rate") - c("property_rate") >= CONTRAST, CONTRAST_BONUS)
        + bonus(c("total_attempts") >= ENOUGH_ATTEMPTS, 1)
        + bonus(c("first_attempt_identity_count") >= 1, 1)
        - bonus(c("identity_accepted") == 0, NO_IDENTITY_PENALTY)
    )
    scored = targets.withColumn("candidate_score", score)
    strong = (
        (c("candidate_score") >= TIER_A)
        & (c("identity_accepted") >= TIER_A_IDENTITY)
        & (c("total_attempts") >= ENOUGH_ATTEMPTS)
    )
    return scored.withColumn(
        "status",
        F.when(c("total_attempts") == 0, "INSUFFICIENT_DATA")
        .when(strong, "TIER_A_EXPERIMENT_CANDIDATE")
        .when(c("candidate_score") >= TIER_B, "TIER_B_MONITOR")
        .otherwise("TIER_C_NOT_SUPPORTED"),
    ).orderBy(F.desc("candidate_score"), F.desc("identity_accepted"), "category", "target")


def inventory_feasibility(
    scopes: DataFrame, evidence: DataFrame, refined: DataFrame, pilot=(), prose=()
) -> DataFrame:
    """Per scope: chunks found, concepts left, the first few of them, and what that allows."""
    order = Window.partitionBy("scope").orderBy("rank", "line_no")
    sample = (
        refined.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= SAMPLE_SIZE)
        .groupBy("scope")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "concept"))).getField("concept").alias("sample"))
    )
    chunks = evidence.groupBy("scope").agg(F.count("*").alias("chunks"))
    sizes = refined.groupBy("scope").agg(F.count("*").alias("concepts"))
    rows = (
        scopes.select("scope")
        .join(chunks, "scope", "left")
        .join(sizes, "scope", "left")
        .join(sample, "scope", "left")
        .na.fill(0, ["chunks", "concepts"])
    )
    thin = (F.col("concepts") < MIN_INVENTORY) | F.col("scope").isin(*prose)
    return rows.select(
        "scope",
        "chunks",
        "concepts",
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
        F.when(F.col("scope").isin(*pilot), "ALREADY_PILOT_CATEGORY")
        .when(thin, "SOURCE_STRUCTURE_INSUFFICIENT")
        .otherwise("SAFE_GENERALIZATION_POSSIBLE")
        .alias("status"),
    )


def compare_conditions(rounds: DataFrame) -> DataFrame:
    """Rounds, acceptance, attempts and alignment per experimental condition."""
    return rounds.groupBy("condition").agg(
        F.count("*").alias("rounds"),
        F.count_if("accepted").alias("accepted"),
        F.sum("attempts").alias("attempts"),
        F.count_if("aligned").alias("aligned"),
    )


def call_counts(calls: DataFrame) -> DataFrame:
    """Model calls per profile."""
    return calls.groupBy("profile").agg(F.count("*").alias("calls"))


def retry_summary(events: DataFrame) -> DataFrame:
    """Retried operations per validator: how many, how many attempts, how often recovered."""
    return events.groupBy("validator").agg(
        F.count("*").alias("operations"),
        F.sum("attempts_made").alias("attempts_made"),
        F.avg(F.col("recovered").cast("int")).alias("recovered_rate"),
    )
