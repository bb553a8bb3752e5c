"""The pipeline's stages on a small table: columns, what goes and what stays."""

import random

import corpus_pipeline
from evidence_spark.sources.tables import write_table


def test_stages(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "du", "lo", "mi") for b in ("ra", "to", "ne", "su")]
    made = [(i, " ".join(rng.choice(words) for _ in range(60)), "xx", f"src{i % 2}", 0) for i in range(40)]
    made += [(100, made[0][1], "xx", "src0", 0), (101, None, "xx", None, 0), (102, "123 456", "xx", "src1", 0), made[1]]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = write_table(stage(spark, docs, ""), name)
        assert now.columns == docs.columns
        docs, ids[name] = now, {r["doc_id"] for r in now.collect()}
    assert ids["language_id"] == {*range(40), 100}
    assert ids["exact_dedup"] == {*range(1, 40), 100}
    assert ids["simhash_near_dedup"] == ids["exact_dedup"]
    assert ids["source_mixing"] <= ids["exact_dedup"]
    words_in = sum(len(r["text"].split()) for r in docs.collect())
    assert abs(words_in - 1.5 * 40 * 60) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {"sequence_id", "offset", "ids_crc32"} <= set(packed.columns) and packed.count() >= docs.count()
