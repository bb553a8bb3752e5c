"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR names the input tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from evidence_spark.operators import chunking, retrieval, retrieval_eval
from evidence_spark.plans import tables as t
from evidence_spark.plans.registry import QUERIES
from evidence_spark.sources.tables import write_table

# Registered queries timed as they are, after the index and the evidence exist.
TIMED = [
    "corpus_statistics",
    "concept_inventory",
    "refined_concepts",
    "anchored_contexts",
    "planned_targets",
    "query_targets",
    "competing_passages",
    "generation_prompts",
    "attempts_until_acceptance",
    "question_audit",
    "category_rollup",
    "attempts_by_target",
    "duplicate_candidates",
    "ingested_questions",
    "ingested_grounding",
    "assembled_attempts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="evidence-bench-"),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("evidence-bench")
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()

    seconds: dict[str, float] = {}

    def timed(name: str, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    chunks = timed("chunk_job", lambda: write_table(t.chunks(spark, folder), "bench_chunks"))
    primary = chunks.where("source_type = 'PRIMARY'")
    index = timed("index_build", lambda: retrieval.build_index(primary, "PRIMARY"))
    queries = t.queries(spark, folder)
    n_queries = queries.count()
    evidence = timed("batch_top8", lambda: write_table(retrieval.search(index, queries), "bench_evidence"))
    terms = queries.select("query_id", F.col("query").alias("term"))
    truth = timed("literal_truth", lambda: write_table(retrieval_eval.literal_truth(index, terms), "bench_truth"))
    recall = timed("recall", lambda: retrieval_eval.recall(retrieval_eval.evaluate(truth, evidence)).first())

    key = (spark.sparkContext.applicationId, folder)
    t._shared.update({(*key, "index PRIMARY"): index, (*key, "evidence"): evidence, (*key, "chunks"): chunks})
    for name in TIMED:
        timed(name, lambda: run(QUERIES[name](spark, folder)))

    sizes = chunking.corpus_statistics(chunks).agg(F.sum("total_chunks")).first()[0]
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "details": {
                    "chunks": sizes,
                    "indexed_chunks": index.chunks.count(),
                    "vocabulary": index.vocab.count(),
                    "search_queries": n_queries,
                    "ms_per_query": round(1000 * seconds["batch_top8"] / max(n_queries, 1), 2),
                    "recall": {k: round(recall[f"recall_at_{k}"], 4) for k in retrieval_eval.CUTOFFS},
                    "cpus": cpus,
                    "spark": settings,
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
