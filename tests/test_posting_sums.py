"""Postings are summed where they are counted; they do not travel."""

from evidence_spark.operators import retrieval
from evidence_spark.operators.chunking import chunk_pages
from evidence_spark.plans import corpus


def test_postings_are_summed_before_they_meet_the_ids(spark, monkeypatch):
    pages = spark.createDataFrame([("PRIMARY", "f", 1, "red river"), ("PRIMARY", "f", 2, "blue")], "source_type string, source_file string, page int, text string")
    index = retrieval.build_index(chunk_pages(pages), "PRIMARY", tasks=2)
    monkeypatch.setattr(corpus.t, "index", lambda *_: index)
    sums = corpus._posting_sums(spark, "")
    above, below = sums._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "aggregate(" not in above and "aggregate(" in below
    told = {r.chunk_id: r.grams for r in sums.collect()}
    assert sorted(told.values()) == sorted(len(r.grams) for r in index.postings.collect())
