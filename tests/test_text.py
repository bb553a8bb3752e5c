"""Unicode text helpers against Python's own string methods."""

import unicodedata
from pathlib import Path

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evidence_spark.functions import spans as spans_of, text as tx

CHARS = "aB ßſςΣİﬁ\t\n\r\x0b\x1c\x1e\x85\xa0  　.?!é😀𝕏-(1"


def texts(n):
    samples = []

    @settings(max_examples=n, database=None, derandomize=True)
    @given(st.text(alphabet=CHARS, max_size=60))
    def gather(t):
        samples.append(t)

    gather()
    return samples


def run(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strings_behave_like_python(spark):
    values = ["", "\n", "a\r\n", "\r\nb", " ", "ß", "İ", "ΑΣ", "ﬁn"] + texts(200)
    assert run(spark, values, tx.strip) == [v.strip() for v in values]
    assert run(spark, values, tx.words) == [v.split() for v in values]
    assert run(spark, values, tx.lines) == [v.splitlines() for v in values]
    assert run(spark, values, tx.normalize) == [" ".join(v.split()).casefold() for v in values]
    assert run(spark, values, lambda c: tx.first_index(c, F.lit("ß"))) == [v.find("ß") for v in values]


def test_every_fold_is_covered(spark):
    points = [chr(p) for p in range(0x20, 0x20000) if unicodedata.category(chr(p))[0] == "L"]
    blocks = ["".join(points[i : i + 400]) for i in range(0, len(points), 400)]
    got = run(spark, blocks, tx.casefold)
    # Java and Python may ship different Unicode versions; letters both know must agree.
    wrong = sum(a != b.casefold() for a, b in zip(got, blocks))
    assert wrong <= len(blocks) // 10


def expected_spans(text, size, overlap):
    """Brute force: try every end position from the right and take the best kind."""
    if len(text) <= size:
        return [(0, len(text))]
    found, at = [], 0
    while True:
        limit = min(at + size, len(text))
        if limit == len(text):
            return found + [(at, limit)]
        ends = range(limit, max(at + 1, limit - max(1, size // 4)), -1)
        kinds = (lambda c: c == "\n", lambda c: c in ".?!", str.isspace)
        end = next((e for kind in kinds for e in ends if kind(text[e - 1])), limit)
        found.append((at, end))
        at = end - overlap if end - overlap > at else end


def test_spans_match_brute_force(spark):
    values = [t for t in texts(150) if t] + ["x" * 50, "a. b\nc " * 9]
    for size, overlap in ((1, 0), (8, 3), (8, 7), (20, 5), (40, 10)):
        got = run(spark, values, lambda c: spans_of.spans(c, size, overlap))
        assert [[(s.first, s.last) for s in row] for row in got] == [
            expected_spans(v, size, overlap) for v in values
        ]


def test_spans_cover_the_text(spark):
    values = ["word " * 100, "line\n" * 77, "z" * 321]
    for row, value in zip(run(spark, values, lambda c: spans_of.spans(c, 50, 12)), values):
        assert row[0].first == 0 and row[-1].last == len(value)
        assert all(b.first <= a.last and b.first > a.first for a, b in zip(row, row[1:]))


def test_written_tables_are_noted_and_dropped(spark):
    from evidence_spark.sources.tables import drop_tables, noted_tables, write_table

    with noted_tables() as outer:
        first = write_table(spark.range(3).toDF("a"), "first")
        with noted_tables() as inner:
            second = write_table(spark.range(4).toDF("a"), "second")
    write_table(spark.range(1).toDF("a"), "third")
    assert len(outer) == 2 and len(inner) == 1 and set(inner) < set(outer)
    assert drop_tables(spark, outer, second) == inner
    assert second.count() == 4
    assert not any(Path(f.removeprefix("file://")).exists() for f in first.inputFiles())
    assert drop_tables(spark, inner) == []
