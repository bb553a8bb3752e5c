"""Registered queries over pages, chunks, the index and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_spark.functions.text import WHITESPACE_CHARS, WHITESPACE_CLASS
from evidence_spark.operators import chunking, retrieval, retrieval_eval
from evidence_spark.plans import tables as t
from evidence_spark.sources.pages import page_report
from evidence_spark.sources.tables import write_table

_PAGES = """
page_t AS (
  SELECT CASE WHEN lang = 'en' THEN 'PRIMARY' ELSE 'SECONDARY' END AS source_type,
         source || '.txt' AS source_file,
         row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id) AS page, text
  FROM documents)
"""


def strip_sql(expression: str) -> str:
    return f"trim({expression}, '{WHITESPACE_CHARS}')"


def _end_sql(at: str) -> str:
    """Where a span starting at ``at`` ends, with greedy matches instead of a backward search."""
    low, limit = f"greatest({at} + 1, {at} + 1800 - 450)", f"({at} + 1800)"
    tail = f"substring(text, {low} + 1, {limit} - {low})"
    found = ", ".join(
        f"nullif(length(regexp_extract({tail}, '(?s)^.*[{kind}]')), 0)" for kind in (r"\n", ".?!", WHITESPACE_CLASS)
    )
    return f"CASE WHEN {limit} >= n THEN n ELSE {low} + coalesce({found}, {limit} - {low}) END"


CHUNKS = f"""
{_PAGES},
span AS (
  SELECT *, 1 AS ordinal, 0 AS a, {_end_sql('0')} AS b
  FROM (SELECT *, length(text) AS n FROM page_t WHERE {strip_sql('text')} <> '')
  UNION ALL
  SELECT source_type, source_file, page, text, n, ordinal + 1, nxt, {_end_sql('nxt')}
  FROM (SELECT *, CASE WHEN b - 300 > a THEN b - 300 ELSE b END AS nxt FROM span WHERE b < n)),
chunk_t AS (
  SELECT source_type, source_file, page, ordinal, {strip_sql('substring(text, a + 1, b - a)')} AS text,
         format('{{}}:{{}}:{{:04d}}:{{:04d}}', source_type, source_file, page, ordinal) AS chunk_id
  FROM span WHERE {strip_sql('substring(text, a + 1, b - a)')} <> '')
"""


def _grams_sql(table: str, key: str, text: str) -> str:
    lowered = f"lower(replace({text}, 'İ', 'i̇'))"
    return f"""
      SELECT {key}, gram, count(*) AS tf FROM (
        SELECT {key}, substring(w, i, n) AS gram FROM (
          SELECT {key}, w, n, unnest(generate_series(1, greatest(length(w) - n + 1, 1))) AS i FROM (
            SELECT {key}, w, unnest([3, 4, 5]) AS n FROM (
              SELECT {key}, ' ' || unnest(regexp_split_to_array({strip_sql(lowered)}, '[{WHITESPACE_CLASS}]+')) || ' ' AS w
              FROM {table}))
          WHERE n = 3 OR n <= length(w)))
      GROUP BY ALL"""


INDEX = f"""
{CHUNKS},
primary_t AS (SELECT * FROM chunk_t WHERE source_type = 'PRIMARY'),
tf_t AS ({_grams_sql('primary_t', 'chunk_id', 'text')}),
vocab_t AS (
  SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM primary_t)) / (1 + count(*))) + 1 AS idf
  FROM tf_t GROUP BY gram),
weight_t AS (
  SELECT chunk_id, gram, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY chunk_id)) AS w
  FROM tf_t JOIN vocab_t USING (gram))
"""

SEARCH = f"""
{INDEX},
query_tf AS ({_grams_sql('benchmark', 'item_id', 'text')}),
query_t AS (
  SELECT item_id AS query_id, gram, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY item_id)) AS qw
  FROM query_tf JOIN vocab_t USING (gram)),
score_t AS (
  SELECT query_id, chunk_id, round(least(1.0, sum(qw * w)), 9) AS score
  FROM query_t JOIN weight_t USING (gram) GROUP BY ALL HAVING sum(qw * w) > 1e-9),
evidence_t AS (
  SELECT * FROM (
    SELECT query_id, score, c.*, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, source_file, page, ordinal) AS rank
    FROM score_t JOIN primary_t c USING (chunk_id)) WHERE rank <= 8)
"""

TRUTH = """
term_t AS (SELECT item_id AS query_id, text AS term FROM benchmark),
truth_t AS (SELECT query_id, chunk_id FROM term_t, primary_t WHERE contains(text, term))
"""

_HITS = """
hit_t AS (
  SELECT query_id, expected_chunks, coalesce(retrieved, []) AS retrieved,
         coalesce(first_hit <= 3, false) AS hit_at_3, coalesce(first_hit <= 5, false) AS hit_at_5,
         coalesce(first_hit <= 8, false) AS hit_at_8
  FROM (SELECT query_id, count(*) AS expected_chunks FROM truth_t GROUP BY query_id)
  LEFT JOIN (
    SELECT query_id, list(chunk_id ORDER BY rank) AS retrieved,
           min(CASE WHEN (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM truth_t) THEN rank END) AS first_hit
    FROM evidence_t GROUP BY query_id) USING (query_id))
"""


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda: write_table(
        retrieval_eval.literal_truth(t.index(spark, sf), _terms(spark, sf)), "truth"
    )
    return t.once(spark, sf, "truth", build)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_eval.evaluate(_truth(spark, sf), t.evidence(spark, sf))


def _posting_sums(spark: SparkSession, sf: str) -> DataFrame:
    """What the postings of a chunk add up to.  They are summed where they are counted: the postings, about a hundred times the text, do not travel to the chunk ids."""
    index = t.index(spark, sf)
    sums = index.postings.select(
        "chunk_no",
        F.size("grams").alias("grams"),
        F.round(F.array_max("weights"), 6).alias("top_weight"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), 6).alias("weight_sum"),
    )
    return sums.join(index.chunks.select("chunk_no", "chunk_id"), "chunk_no").select("chunk_id", "grams", "top_weight", "weight_sum")


def _category_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text is a category; it is asked for by itself, by its alias and by a name nobody knows."""
    items = t.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), "text")
    canonical = items.select(F.col("text").alias("category")).distinct()
    aliases = items.select(F.concat(F.lit("item "), "name").alias("alias"), F.col("text").alias("target"))
    names = F.array("text", F.concat(F.lit("item "), "name"), F.concat(F.lit("lost "), "name"))
    asked = items.select(F.explode(names).alias("category"))
    return retrieval.retrieve_for_categories(t.index(spark, sf), asked, canonical, aliases).select(
        "category", "canonical", "status", "rank", F.round("score", 6).alias("score"), "chunk_id"
    )


QUERIES = {
    "page_contract": lambda s, f: page_report(t.pages(s, f)),
    "evidence_chunks": lambda s, f: t.chunks(s, f),
    "corpus_statistics": lambda s, f: chunking.corpus_statistics(t.chunk_table(s, f)).withColumn(
        "avg_length", F.round("avg_length", 6)
    ),
    "chunks_per_source": lambda s, f: chunking.chunks_per_source(t.chunk_table(s, f)),
    "repeated_chunk_texts": lambda s, f: chunking.duplicate_chunk_ids(
        t.chunk_table(s, f).select(F.sha2("text", 256).alias("chunk_id"))
    ),
    "foreign_source_types": lambda s, f: chunking.foreign_source_types(t.chunk_table(s, f), "PRIMARY"),
    "chunks_of_one_page": lambda s, f: chunking.chunks_for_source(t.chunk_table(s, f), "src3.txt", 2),
    "gram_vocabulary": lambda s, f: t.index(s, f).vocab.select("gram", "df", F.round("idf", 6).alias("idf")),
    "index_statistics": lambda s, f: retrieval.index_statistics(t.index(s, f)),
    "posting_weights": _posting_sums,
    "top_evidence": lambda s, f: t.evidence(s, f).select(
        "query_id", "rank", F.round("score", 6).alias("score"), "chunk_id"
    ),
    "category_evidence": _category_evidence,
    "literal_truth": lambda s, f: _truth(s, f).select("query_id", "chunk_id"),
    "ungrounded_queries": lambda s, f: retrieval_eval.ungrounded(_terms(s, f), _truth(s, f)),
    "retrieval_hits": _results,
    "recall_at_k": lambda s, f: retrieval_eval.recall(_results(s, f)).select(
        "queries", *[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in retrieval_eval.CUTOFFS]
    ),
    "retrieval_misses": lambda s, f: retrieval_eval.misses(_results(s, f)).select("query_id", "expected_chunks"),
}

ORACLES = {
    "page_contract": f"""WITH {_PAGES}
      SELECT source_type, source_file, min(page) AS first_page, max(page) AS last_page, count(*) AS pages,
        count(DISTINCT page) AS distinct_pages, count(*) FILTER ({strip_sql('text')} <> '') AS filled_pages,
        min(page) = 1 AND max(page) = count(*) AND count(DISTINCT page) = count(*) AS contiguous,
        min(page) = 1 AND max(page) = count(*) AND count(DISTINCT page) = count(*)
          AND count(*) FILTER ({strip_sql('text')} <> '') > 0 AS usable
      FROM page_t GROUP BY ALL""",
    "evidence_chunks": f"""WITH RECURSIVE {CHUNKS}
      SELECT source_type, source_file, page, ordinal, chunk_id, text FROM chunk_t""",
    "corpus_statistics": f"""WITH RECURSIVE {CHUNKS}
      SELECT source_type, count(*) AS total_chunks, min(length(text)) AS min_length, max(length(text)) AS max_length,
        round(avg(length(text)), 6) AS avg_length, count(DISTINCT source_file) AS source_files
      FROM chunk_t GROUP BY ALL""",
    "chunks_per_source": f"""WITH RECURSIVE {CHUNKS}
      SELECT source_type, source_file, count(*) AS chunk_count, count(DISTINCT page) AS pages_with_chunks
      FROM chunk_t GROUP BY ALL""",
    "repeated_chunk_texts": f"""WITH RECURSIVE {CHUNKS}
      SELECT sha256(text) AS chunk_id, count(*) AS occurrences FROM chunk_t GROUP BY ALL HAVING count(*) > 1""",
    "foreign_source_types": f"""WITH RECURSIVE {CHUNKS}
      SELECT DISTINCT source_type FROM chunk_t WHERE source_type <> 'PRIMARY'""",
    "chunks_of_one_page": f"""WITH RECURSIVE {CHUNKS}
      SELECT source_type, source_file, page, ordinal, chunk_id, text FROM chunk_t
      WHERE source_file = 'src3.txt' AND page = 2""",
    "gram_vocabulary": f"WITH RECURSIVE {INDEX} SELECT gram, df, round(idf, 6) AS idf FROM vocab_t",
    "index_statistics": f"""WITH RECURSIVE {INDEX}
      SELECT (SELECT count(*) FROM vocab_t) AS feature_count, (SELECT count(*) FROM primary_t) AS indexed_chunks""",
    "posting_weights": f"""WITH RECURSIVE {INDEX}
      SELECT chunk_id, count(*) AS grams, round(max(w), 6) AS top_weight, round(sum(w), 6) AS weight_sum
      FROM weight_t GROUP BY chunk_id""",
    "top_evidence": f"""WITH RECURSIVE {SEARCH}
      SELECT query_id, rank, round(score, 6) AS score, chunk_id FROM evidence_t""",
    "category_evidence": f"""WITH RECURSIVE {SEARCH},
      name_t AS (
        SELECT text AS category, text AS canonical, item_id FROM benchmark
        UNION ALL SELECT 'item ' || item_id, text, item_id FROM benchmark
        UNION ALL SELECT 'lost ' || item_id, NULL, NULL FROM benchmark)
      SELECT DISTINCT category, canonical,
        CASE WHEN canonical IS NULL THEN 'UNKNOWN' WHEN rank IS NULL THEN 'NO_EVIDENCE' ELSE 'OK' END AS status,
        rank, round(score, 6) AS score, chunk_id
      FROM name_t LEFT JOIN evidence_t ON query_id = item_id""",
    "literal_truth": f"WITH RECURSIVE {INDEX}, {TRUTH} SELECT query_id, chunk_id FROM truth_t",
    "ungrounded_queries": f"""WITH RECURSIVE {INDEX}, {TRUTH}
      SELECT query_id, term FROM term_t WHERE query_id NOT IN (SELECT query_id FROM truth_t)""",
    "retrieval_hits": f"WITH RECURSIVE {SEARCH}, {TRUTH}, {_HITS} SELECT * FROM hit_t",
    "recall_at_k": f"""WITH RECURSIVE {SEARCH}, {TRUTH}, {_HITS}
      SELECT count(*) AS queries, round(coalesce(avg(hit_at_3::INT), 0), 6) AS recall_at_3,
        round(coalesce(avg(hit_at_5::INT), 0), 6) AS recall_at_5, round(coalesce(avg(hit_at_8::INT), 0), 6) AS recall_at_8
      FROM hit_t""",
    "retrieval_misses": f"""WITH RECURSIVE {SEARCH}, {TRUTH}, {_HITS}
      SELECT query_id, expected_chunks FROM hit_t WHERE NOT hit_at_8""",
}
