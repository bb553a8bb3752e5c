"""Registered queries over concepts, their context, targets and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.functions.concepts import CONCEPT_LINE
from evidence_spark.functions.text import LINE_END, WHITESPACE_CLASS, normalize
from evidence_spark.operators import analysis, anchoring, concepts, identity, relations, targets
from evidence_spark.plans import tables as t
from evidence_spark.plans.corpus import CHUNKS, SEARCH, strip_sql
from evidence_spark.sources.tables import write_table

# Cue phrases and a lexicon that occur in the invented texts of the test tables.
NAMING, SOURCE, ENUMERATION = ["reou"], ["ertion"], ["onth"]
LEXICON = (
    ("SUPPLIES", ("license", "dans ")),
    ("CONTAINS", ("elle", "hand")),
    ("CONNECTS", ("der ",)),
    ("LOCATED_IN", ("thble",)),
)
PART_LEXICON = (("TOOL", ("widget", "gear")), ("JEWEL", ("ring",)), ("COLOUR", ("red", "blue")))
NEEDLES = ["license", "thble", "zzz"]
SCRIPT = "a-z"

_LINE = CONCEPT_LINE.replace(r"\A", "^").replace(r"\z", "$")


def _named(x: str) -> str:
    return (
        f"(regexp_matches({x}, '{_LINE}') AND length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) >= 2 "
        f"AND regexp_matches({x}, '[A-Z]') AND len(regexp_extract_all({x}, '[A-Za-z]+')) BETWEEN 1 AND 6)"
    )


def _norm(x: str) -> str:
    return f"lower(regexp_replace({strip_sql(x)}, '[{WHITESPACE_CLASS}]+', ' ', 'g'))"


def _before(width: int) -> str:
    """Text in front of the concept's first occurrence."""
    at = "(instr(text, concept) - 1)"
    return f"substring(text, greatest({at} - {width}, 0) + 1, {at} - greatest({at} - {width}, 0))"


def _any(x: str, cues) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


def _classify(x: str, lexicon) -> str:
    whens = " ".join(f"WHEN {_any(x, keywords)} THEN '{name}'" for name, keywords in lexicon)
    return f"CASE {whens} ELSE 'UNSPECIFIED' END"


CORPUS = f"""{CHUNKS}, ev_t AS (
  SELECT source_type || ':' || source_file AS scope, page * 1000000 + ordinal AS rank, chunk_id, text FROM chunk_t)"""
FOUND = f"{SEARCH}, ev_t AS (SELECT query_id AS scope, rank, chunk_id, text FROM evidence_t)"

_INVENTORY = f"""
line_t AS (
  SELECT *, list_transform(raw, lambda x: {strip_sql('x')}) AS bare FROM (
    SELECT *, CASE WHEN text = '' THEN []
      ELSE regexp_split_to_array(regexp_replace(text, '(?:{LINE_END})$', ''), '{LINE_END}') END AS raw
    FROM ev_t)),
found_t AS (
  SELECT * FROM (
    SELECT scope, rank, chunk_id, text, raw, bare, unnest(generate_series(0, len(bare) - 1)) AS line_no,
           unnest(bare) AS concept FROM line_t) WHERE {_named('concept')}),
inv_t AS (
  SELECT *, {strip_sql('''substring(text, greatest(instr(text, concept) - 121, 0) + 1,
      least(length(text), instr(text, concept) - 1 + length(concept) + 120) - greatest(instr(text, concept) - 121, 0))''')}
    AS factual_focus,
    'a line of its own in title form, ' || len(regexp_extract_all(concept, '[A-Za-z]+')) || ' word' ||
      CASE WHEN len(regexp_extract_all(concept, '[A-Za-z]+')) = 1 THEN '' ELSE 's' END ||
      ' long' AS extraction_reason
  FROM (SELECT *, {_norm('concept')} AS norm FROM found_t)
  QUALIFY row_number() OVER (PARTITION BY scope, norm ORDER BY rank, line_no) = 1)
"""

_REFINED = f"""
mend_t AS (
  SELECT * EXCLUDE (concept), concept AS original,
    CASE WHEN NOT regexp_matches(concept, '^[a-z]') THEN concept
         WHEN up AND NOT down THEN bare[spot - 1] || concept WHEN down AND NOT up THEN bare[spot + 1] || concept END AS concept
  FROM (
    SELECT *, coalesce(spot > 1 AND regexp_matches(bare[spot - 1], '^\\p{{Lu}}$'), false) AS up,
      coalesce(regexp_matches(bare[spot + 1], '^\\p{{Lu}}$'), false) AS down
    FROM (SELECT *, list_position(bare, concept) AS spot FROM inv_t)
    WHERE NOT {_any(_before(60), NAMING)})),
turn_t AS (
  SELECT *, list_position(bare, concept) AS place,
    list_transform(bare, lambda x: regexp_matches(x, '{_LINE}') AND regexp_matches(x, '^[a-z]')) AS loose,
    row_number() OVER (PARTITION BY scope, chunk_id ORDER BY line_no) AS turn
  FROM mend_t WHERE concept IS NOT NULL),
repair_t AS (
  SELECT scope, chunk_id, 0::BIGINT AS turn, []::BIGINT[] AS spent, []::BIGINT[] AS above, []::BIGINT[] AS below
  FROM turn_t WHERE turn = 1
  UNION ALL
  SELECT scope, chunk_id, turn, list_concat(spent, list_concat(up, down)), up, down FROM (
    SELECT n.scope, n.chunk_id, n.turn, r.spent,
      CASE WHEN place > 0 THEN list_filter(generate_series(greatest(place - 5, 1), place - 1), lambda i:
        len(list_filter(generate_series(i, place - 1), lambda j: NOT loose[j] OR list_contains(r.spent, j))) = 0)
        ELSE [] END AS up,
      CASE WHEN place > 0 THEN list_filter(generate_series(place + 1, least(place + 5, len(bare))), lambda i:
        len(list_filter(generate_series(place + 1, i), lambda j: NOT loose[j] OR list_contains(r.spent, j))) = 0)
        ELSE [] END AS down
    FROM repair_t r JOIN turn_t n ON n.scope = r.scope AND n.chunk_id = r.chunk_id AND n.turn = r.turn + 1)),
named_t AS (
  SELECT * EXCLUDE (concept), coalesce(fixed, concept) AS concept,
    CASE WHEN fixed IS NULL THEN [] ELSE list_sort(list_concat([place], list_concat(above, below))) END AS source_lines
  FROM (
    SELECT t.*, above, below, CASE WHEN len(above) + len(below) > 0 THEN {strip_sql('''rtrim(
      t.concept || array_to_string(list_transform(list_concat(list_reverse(above), below), lambda i: bare[i]), ''),
      '.')''')} END AS fixed
    FROM turn_t t JOIN repair_t r ON r.scope = t.scope AND r.chunk_id = t.chunk_id AND r.turn = t.turn)
  WHERE fixed IS NULL OR (NOT (len(above) > 0 AND len(below) > 0) AND fixed <> ''
    AND len(string_split(fixed, '(')) = len(string_split(fixed, ')')))),
refined_t AS (
  SELECT * REPLACE ({_norm('concept')} AS norm) FROM named_t
  QUALIFY row_number() OVER (PARTITION BY scope, {_norm('concept')} ORDER BY rank, line_no) = 1)
"""


def _walk(step: int, start: str, taken: int, looked: int) -> str:
    k = f"{start} + {step} * k"
    blank = "bare[{}] = ''"
    stop = (
        f"coalesce(list_min(list_filter(generate_series(1, {looked}), lambda k: {k} BETWEEN 1 AND len(bare) AND "
        f"{k} IS DISTINCT FROM used AND ({_named(f'bare[{k}]')} OR ({blank.format(k)} AND k > 1 AND "
        f"{start} + {step} * (k - 1) IS DISTINCT FROM used AND bare[{start} + {step} * (k - 1)] = '')))), {looked} + 1)"
    )
    return (
        f"(list_filter(generate_series(1, {stop} - 1), lambda k: {k} BETWEEN 1 AND len(bare) AND "
        f"{k} IS DISTINCT FROM used AND bare[{k}] <> '' ))[1:{taken}]"
    )


def _anchor(taken: int, looked: int) -> str:
    above = f"list_transform(list_reverse({_walk(-1, 'lo', taken, looked)}), lambda k: raw[lo - k])"
    below = f"list_transform({_walk(1, 'hi', taken, looked)}, lambda k: raw[hi + k])"
    joined = f"array_to_string(list_concat(list_concat({above}, [concept]), {below}), chr(10))"
    return f"CASE WHEN lo IS NULL THEN concept ELSE {strip_sql(joined)} END"


_PLACED = """
place_t AS (
  SELECT *, CASE WHEN len(source_lines) > 0 THEN list_min(source_lines) ELSE nullif(own, 0) END AS lo,
    CASE WHEN len(source_lines) > 0 THEN list_max(source_lines) ELSE nullif(own, 0) END AS hi,
    CASE WHEN len(source_lines) > 0 OR drops = 0 THEN NULL
         WHEN own > 1 AND bare[own - 1] = substring(concept, 1, drops) THEN own - 1
         WHEN bare[own + 1] = substring(concept, 1, drops) THEN own + 1 END AS used
  FROM (
    SELECT *, CASE WHEN p0 > 0 THEN p0 WHEN p1 > 0 THEN p1 ELSE p2 END AS own,
      CASE WHEN p0 > 0 THEN 0 WHEN p1 > 0 THEN 1 ELSE 2 END AS drops
    FROM (
      SELECT *, coalesce(list_position(bare, concept), 0) AS p0,
        CASE WHEN length(concept) > 1 THEN coalesce(list_position(bare, substring(concept, 2)), 0) ELSE 0 END AS p1,
        CASE WHEN length(concept) > 2 THEN coalesce(list_position(bare, substring(concept, 3)), 0) ELSE 0 END AS p2
      FROM refined_t)))
"""


def _split(focus: str) -> tuple[str, str]:
    """Context before and after the last line of ``focus`` that equals the concept."""
    parts = f"string_split({focus}, chr(10))"
    back = f"coalesce(list_position(list_reverse({parts}), concept), 0)"
    before = (
        f"CASE WHEN {back} = 0 THEN {focus} ELSE array_to_string({parts}[1:len({parts}) - {back}], chr(10)) END"
    )
    after = f"CASE WHEN {back} = 0 THEN '' ELSE array_to_string({parts}[len({parts}) - {back} + 2:], chr(10)) END"
    return before, after


_BEFORE, _AFTER = _split("focus")
_UNPUNCTUATED = "regexp_replace(concept, '[().,]', ' ', 'g')"
_FORMS = f"list_distinct([{_norm('concept')}, {_norm(_UNPUNCTUATED)}])"
_TARGETS = f"""
known_t AS (SELECT DISTINCT scope, {_norm('concept')} AS form FROM inv_t),
tested_t AS (SELECT scope, form FROM known_t WHERE form IN (SELECT form FROM known_t GROUP BY form HAVING count(*) > 1)),
open_t AS (
  SELECT * FROM place_t p WHERE NOT EXISTS (
    SELECT 1 FROM tested_t s WHERE s.scope = p.scope AND list_contains({_FORMS.replace('concept', 'p.concept')}, s.form))),
focus_t AS (
  SELECT *, CASE WHEN {_norm('narrow')} <> {_norm('concept')} THEN narrow ELSE broad END AS focus
  FROM (SELECT *, {_anchor(3, 12)} AS narrow, {_anchor(6, 24)} AS broad FROM open_t)),
target_t AS (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank, line_no) AS target_id,
    instr(text, concept) > 0 AND {_any(_before(25), SOURCE)} AS source_role
  FROM (SELECT *, {_BEFORE} AS ahead, {_AFTER} AS behind FROM focus_t WHERE {_norm('focus')} <> {_norm('concept')})
  WHERE NOT ({_any('ahead', ENUMERATION)} AND length(regexp_replace(behind, '[^\\p{{L}}]', '', 'g')) < 2))
"""
_ENTITY = f"""CASE WHEN source_role AND list_position(bare, concept) > 1 THEN
  list_filter(list_reverse(bare[greatest(list_position(bare, concept) - 6, 1):list_position(bare, concept) - 1]),
    lambda x: {_named('x')})[1] END"""


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: write_table(concepts.extract_concepts(t.corpus_evidence(spark, sf)), "inventory")
    return t.once(spark, sf, "inventory", build)


def _tested(spark: SparkSession, sf: str) -> DataFrame:
    """What several files name counts as asked already in each of them."""
    named = _inventory(spark, sf).select("scope", F.col("concept").alias("answer"), normalize("concept").alias("form"))
    several = named.groupBy("form").agg(F.min("scope").alias("a"), F.max("scope").alias("b")).where("a < b").select("form")
    return named.join(several, "form", "left_semi").select("scope", "answer").distinct()


def _refined(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: write_table(concepts.refine_concepts(t.corpus_evidence(spark, sf), NAMING), "refined")
    return t.once(spark, sf, "refined", build)


def _query_refined(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: write_table(concepts.refine_concepts(t.query_evidence(spark, sf), NAMING), "query_refined")
    return t.once(spark, sf, "query refined", build)


def query_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of every benchmark query, with their relationship."""

    def build() -> DataFrame:
        planned = targets.plan_targets(
            _query_refined(spark, sf),
            t.query_evidence(spark, sf),
            enumeration_cues=ENUMERATION,
            source_cues=SOURCE,
        )
        return write_table(targets.with_relationship(planned, LEXICON), "targets")

    return t.once(spark, sf, "query targets", build)


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    placed = targets.with_chunk_lines(_refined(spark, sf), t.corpus_evidence(spark, sf))
    concept, at = F.col("concept"), F.col("source_lines")
    return placed.select(
        "scope",
        "concept",
        anchoring.anchor(concept, at, anchoring.NARROW).alias("narrow"),
        anchoring.anchor(concept, at, anchoring.BROAD).alias("broad"),
    )


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    placed = targets.with_chunk_lines(_refined(spark, sf), t.corpus_evidence(spark, sf))
    return identity.concept_forms(placed, ascii_only=True, script=SCRIPT)


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    evidence = t.corpus_evidence(spark, sf)
    return targets.plan_targets(
        _refined(spark, sf),
        evidence,
        _tested(spark, sf),
        count=25,
        enumeration_cues=ENUMERATION,
        source_cues=SOURCE,
    ).withColumn("own_chunks", F.array_join("own_chunks", ","))


def part_questions(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "part").select(
        F.col("p_brand").alias("category"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("answer"),
    )


def _feasibility(spark: SparkSession, sf: str) -> DataFrame:
    scopes = t.queries(spark, sf).select(F.col("query_id").alias("scope"))
    return analysis.inventory_feasibility(scopes, t.query_evidence(spark, sf), _query_refined(spark, sf), pilot=[0])


QUERIES = {
    "concept_inventory": _inventory,
    "refined_concepts": lambda s, f: _refined(s, f).select(
        "scope", "rank", "line_no", "chunk_id", "concept", F.transform("source_lines", lambda i: i + 1).alias("lines")
    ),
    "anchored_contexts": _anchored,
    "concept_forms": _forms,
    "planned_targets": _planned,
    "covered_values": lambda s, f: identity.covered_values(part_questions(s, f), PART_LEXICON),
    "category_coverage": lambda s, f: identity.category_coverage(part_questions(s, f), PART_LEXICON),
    "relationship_counts": lambda s, f: t.chunk_table(s, f)
    .groupBy("source_type", relations.classify(F.lower("text"), LEXICON).alias("relationship"))
    .agg(F.count("*").alias("chunks")),
    "query_targets": lambda s, f: query_targets(s, f).select("scope", "target_id", "topic", "factual_focus", "relationship"),
    "competing_passages": lambda s, f: relations.discover_competitors(
        query_targets(s, f), t.query_evidence(s, f), LEXICON
    ),
    "keyword_proximity": lambda s, f: relations.proximity_hits(_query_refined(s, f), t.query_evidence(s, f), LEXICON),
    "mention_counts": lambda s, f: relations.mention_counts(_query_refined(s, f), t.query_evidence(s, f)),
    "literal_facts": lambda s, f: relations.literal_facts(t.query_evidence(s, f), NEEDLES),
    "signal_panel": lambda s, f: targets.signal_panel(
        _query_refined(s, f), t.query_evidence(s, f), ENUMERATION, LEXICON
    ),
    "inventory_feasibility": _feasibility,
}

_COMPETITOR = "CASE " + " ".join(
    f"WHEN relationship = '{name}' THEN coalesce("
    + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for k in keywords)
    + ")"
    for name, keywords in LEXICON
) + " END"
_SNIPPET = strip_sql(
    "substring(text, greatest(spot - 80, 0) + 1, least(length(text), spot + length(keyword) + 80) - greatest(spot - 80, 0))"
)
_PAIRS = ", ".join(f"{{'r': '{name}', 'k': '{k}'}}" for name, keywords in LEXICON for k in keywords)
_QUERY_TARGETS = _TARGETS.replace("HAVING count(*) > 1", "HAVING false")

ORACLES = {
    "concept_inventory": f"""WITH RECURSIVE {CORPUS}, {_INVENTORY}
      SELECT scope, rank, line_no, chunk_id, concept, norm, factual_focus, extraction_reason FROM inv_t""",
    "refined_concepts": f"""WITH RECURSIVE {CORPUS}, {_INVENTORY}, {_REFINED}
      SELECT scope, rank, line_no, chunk_id, concept, source_lines AS lines FROM refined_t""",
    "anchored_contexts": f"""WITH RECURSIVE {CORPUS}, {_INVENTORY}, {_REFINED}, {_PLACED}
      SELECT scope, concept, {_anchor(3, 12)} AS narrow, {_anchor(6, 24)} AS broad FROM place_t""",
    "concept_forms": f"""WITH RECURSIVE {CORPUS}, {_INVENTORY}, {_REFINED},
      bracket_t AS (SELECT scope, concept, {_FORMS} AS forms, bare, list_transform(bare, lambda x:
        {strip_sql("regexp_extract(x, '[(]([^()]*)[)]', 1)")}) AS inner_texts FROM refined_t),
      pair_t AS (SELECT scope, concept, forms, list_filter(list_transform(generate_series(1, len(bare)), lambda i:
        CASE WHEN contains(bare[i], concept) THEN list_filter(
          [inner_texts[i], CASE WHEN i > 1 THEN inner_texts[i - 1] END, inner_texts[i + 1]],
          lambda x: regexp_matches(x, '^(?:[{SCRIPT}][{SCRIPT}{WHITESPACE_CLASS}]*[{SCRIPT}]|[{SCRIPT}])$'))[1] END),
        lambda x: x IS NOT NULL)[1] AS paired FROM bracket_t)
      SELECT scope, concept, unnest(forms) AS form, 'normalized' AS kind FROM pair_t
      UNION ALL SELECT scope, concept, {_norm('paired')}, 'paired' FROM pair_t WHERE paired IS NOT NULL""",
    "planned_targets": f"""WITH RECURSIVE {CORPUS}, {_INVENTORY}, {_REFINED}, {_PLACED}, {_TARGETS}
      SELECT scope, concept AS topic, focus AS factual_focus, chunk_id AS own_chunks, true AS named_entity, source_role,
        {_ENTITY} AS source_entity, {_any('ahead', ENUMERATION)} AS enumeration_member, target_id
      FROM target_t WHERE target_id <= 25""",
    "covered_values": f"""WITH q AS (SELECT p_brand AS category, p_partkey AS ord,
        unnest(['concept', 'relationship']) AS kind,
        unnest([p_type, nullif({_classify("lower(p_name || ' ' || p_type)", PART_LEXICON)}, 'UNSPECIFIED')]) AS value
        FROM part)
      SELECT category, kind, value, min(ord) AS ord FROM q WHERE value IS NOT NULL GROUP BY ALL""",
    "category_coverage": f"""WITH q AS (SELECT p_brand AS category, p_partkey AS ord, p_type AS answer,
        {_classify("lower(p_name || ' ' || p_type)", PART_LEXICON)} AS relationship FROM part),
      c AS (SELECT category, list(answer ORDER BY ord) AS tested_concepts
        FROM (SELECT category, answer, min(ord) AS ord FROM q GROUP BY ALL) GROUP BY category),
      r AS (SELECT category, list(relationship ORDER BY ord) AS tested_relationship_types
        FROM (SELECT category, relationship, min(ord) AS ord FROM q WHERE relationship <> 'UNSPECIFIED' GROUP BY ALL)
        GROUP BY category)
      SELECT category, tested_concepts, coalesce(tested_relationship_types, []) AS tested_relationship_types
      FROM c LEFT JOIN r USING (category)""",
    "relationship_counts": f"""WITH RECURSIVE {CHUNKS}
      SELECT source_type, {_classify('lower(text)', LEXICON)} AS relationship, count(*) AS chunks FROM chunk_t GROUP BY ALL""",
    "query_targets": f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED}, {_PLACED}, {_QUERY_TARGETS}
      SELECT scope, target_id, concept AS topic, focus AS factual_focus,
        {_classify('lower(focus)', LEXICON)} AS relationship FROM target_t""",
    "competing_passages": f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED}, {_PLACED}, {_QUERY_TARGETS},
      hit_k AS (SELECT g.scope, target_id, e.rank, e.chunk_id, e.text, relationship, {_COMPETITOR.replace('text', 'e.text')} AS keyword
        FROM (SELECT *, {_classify('lower(focus)', LEXICON)} AS relationship FROM target_t) g
        JOIN ev_t e ON e.scope = g.scope AND e.chunk_id <> g.chunk_id)
      SELECT scope, target_id, rank, chunk_id, relationship, {_SNIPPET} AS snippet
      FROM (SELECT *, instr(lower(text), keyword) - 1 AS spot FROM hit_k WHERE keyword IS NOT NULL)""",
    "keyword_proximity": f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED},
      place_k AS (SELECT scope, chunk_id, text, p.r AS relationship, length(p.k) AS size,
          unnest(list_filter(generate_series(1, length(text)), lambda i: substring(lower(text), i, length(p.k)) = p.k)) AS position
        FROM (SELECT *, unnest([{_PAIRS}]) AS p FROM ev_t) WHERE contains(lower(text), p.k)),
      window_k AS (SELECT *, substring(text, greatest(position - 81, 0) + 1,
          least(length(text), position - 1 + size + 80) - greatest(position - 81, 0)) AS win FROM place_k)
      SELECT w.scope, concept, w.chunk_id, relationship, position, {strip_sql('replace(win, chr(10), chr(32))')} AS snippet
      FROM window_k w JOIN refined_t c ON c.scope = w.scope
      WHERE len(list_filter(regexp_split_to_array(lower(concept), '[{WHITESPACE_CLASS}]+'),
        lambda x: length(x) >= 4 AND contains(lower(win), x))) > 0""",
    "mention_counts": f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED}
      SELECT c.scope, concept, count(DISTINCT e.chunk_id) AS mentions
      FROM refined_t c JOIN ev_t e ON e.scope = c.scope AND contains(e.text, concept) GROUP BY ALL""",
    "literal_facts": f"""WITH RECURSIVE {FOUND}
      SELECT scope, needle, bool_or(contains(text, needle)) AS present
      FROM (SELECT *, unnest({NEEDLES}) AS needle FROM ev_t) GROUP BY ALL""",
    "inventory_feasibility": f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED},
      size_t AS (SELECT scope, count(*) AS concepts, list(concept ORDER BY rank, line_no)[1:8] AS sample
        FROM refined_t GROUP BY scope)
      SELECT item_id AS scope, coalesce(chunks, 0) AS chunks, coalesce(concepts, 0) AS concepts,
        coalesce(sample, []) AS sample,
        CASE WHEN item_id = 0 THEN 'ALREADY_PILOT_CATEGORY'
          WHEN coalesce(concepts, 0) < 10 THEN 'SOURCE_STRUCTURE_INSUFFICIENT'
          ELSE 'SAFE_GENERALIZATION_POSSIBLE' END AS status
      FROM benchmark b LEFT JOIN (SELECT scope, count(*) AS chunks FROM ev_t GROUP BY scope) e ON e.scope = b.item_id
      LEFT JOIN size_t s ON s.scope = b.item_id""",
}
_SIGNALS = ", ".join(
    f"""{name}, {_norm(name)} <> {_norm('concept')} AS {name}_sufficient,
    NOT ({_any(_split(name)[0], ENUMERATION)} AND length(regexp_replace({_split(name)[1]}, '[^\\p{{L}}]', '', 'g')) < 2)
      AS {name}_distinct,
    {_any(_split(name)[0], ENUMERATION)} AS {name}_enumeration,
    {_classify(f'lower({name})', LEXICON)} AS {name}_relationship,
    {_classify(f'lower({name})', LEXICON)} <> 'UNSPECIFIED' AS {name}_related"""
    for name in ("narrow", "broad")
)
ORACLES["signal_panel"] = f"""WITH RECURSIVE {FOUND}, {_INVENTORY}, {_REFINED}, {_PLACED}
  SELECT scope, concept, {_SIGNALS}
  FROM (SELECT *, {_anchor(3, 12)} AS narrow, {_anchor(6, 24)} AS broad FROM place_t)"""
