"""Judging responses: fields read from the text are those of the parsed value, methods are small enough to be compiled, tasks are many and even."""

import json

from pyspark.sql import functions as F

from evidence_spark.functions import checks, text
from evidence_spark.operators import responses
from evidence_spark.plans import exchange


def tables(spark, folder):
    spark.sql(
        "SELECT id DIV 3 AS l_orderkey, id % 5 AS l_partkey, id AS l_suppkey, int(id % 3) AS l_linenumber, double(id) AS l_quantity, "
        "3000D AS l_extendedprice, 0.01D AS l_discount, 0.02D AS l_tax, 'N' AS l_returnflag FROM range(30)"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, '1-URGENT' AS o_orderpriority FROM range(10)").write.parquet(f"{folder}/orders.parquet")
    spark.sql(
        "SELECT id AS p_partkey, concat('red bolt ', id) AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, int(id) AS p_size FROM range(5)"
    ).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def largest_method(spark, df):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_methods_are_compiled_and_tasks_even(spark, tmp_path):
    folder = tables(spark, tmp_path)
    key = ["position", "attempt_number"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # methods are made when a stage starts otherwise
    sizes = [largest_method(spark, df) for df in (exchange._ingested(spark, folder).select(*key, "failure_type"), exchange._verdicts(spark, folder))]
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert 0 < min(sizes) and max(sizes) < 8000  # Java compiles no method of more bytes
    cores = spark.sparkContext.defaultParallelism
    assert exchange._calls(spark, folder).rdd.getNumPartitions() == max(8, exchange.TASKS_PER_CORE * cores)
    done = exchange._assembled(spark, folder)
    assert done.count() == 30 and done.select(*key).distinct().count() == 30


def test_fields_from_the_text_are_those_of_the_value(spark):
    part = {"answer_index": 1, "supported_as_correct": True, "evidence_refs": [1, 2], "reason": 'é "q" \\   \U0001f600'}
    whole = {"grounded": True, "answer_assessments": [part, {**part, "evidence_refs": []}], "reason": "r", "confidence": 0.1}
    odd = [
        whole, {**whole, "confidence": 1}, {**whole, "evidence_text": None}, {**whole, "evidence_text": "t", "confidence": 1e-7},
        {**whole, "answer_assessments": [{**part, "answer_index": 3_000_000_000}, part, None]},
        {**whole, "answer_assessments": [{**part, "evidence_refs": [None, 3_000_000_000, 2]}]},
        {**whole, "reason": 5}, {"reason": "r"}, {}, [whole], {**whole, responses._UNREAD: "x"},
    ]
    raw = [json.dumps(o, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, o in enumerate(odd)]
    raw += ['{"grounded":true} x', '{"grounded":true,"grounded":false}', r'{"reason":"\ud800"}', "", None, "null", '{"grounded":tru']
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    value = F.try_variant_get(F.try_parse_json("raw"), "$", f"struct<{responses.GROUNDING}>").alias("w")
    fields = [F.col(f"r.{c}").alias(c) for c in ("grounded", "answer_assessments", "evidence_text", "reason", "confidence")]
    found = responses.judged(rows.select("i", "raw", value), responses.GROUNDING, {}).select("i", "w", F.struct(*fields).alias("r"))
    for row in found.collect():
        assert (row.w or (None,) * 5) == tuple(row.r), raw[row.i]


def test_four_and_other_numbers_of_elements(spark):
    a, b = "struct<answer_index:int,supported_as_correct:boolean,evidence_refs:array<int>>", F.array(*map(F.lit, "xyz"))
    four = [(2, True, [3, 1]), (1, None, None), (4, True, [2]), (3, False, [])]
    rows = [(four, 2), (four, 4), (four, None), (four, 3), ([(1, False, [])] * 4, None), (four[:2], 2), (four[:2], None), (None, 1)]
    df = spark.createDataFrame(rows, f"a array<{a}>, c int")
    got = [(r.f[0], r.f[1]) for r in df.select(checks.fold_assessments("a", "c", b).alias("f")).collect()]
    assert got == [(True, False), (True, False), (None, None), (False, False), (None, True), (True, True), (None, None), (None, None)]
    refs = [[1, 3], [], [0], [4], [None], [1, None], [None, 4], None]
    df = spark.createDataFrame([(r,) for r in refs], "r array<int>")
    assert [r.x for r in df.select(checks.refs_in_range("r", F.lit(3)).alias("x")).collect()] == [True, True] + [False] * 6
    assert [r.x for r in df.select(checks.refs_in_range("r", F.lit(None).cast("int")).alias("x")).collect()] == [False, True] + [False] * 6
    texts = [" a", "a ", "A  b", "A b", "\tx", "ß  S", "Straße", "", " ", "İx", "a\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize_column("t").alias("n"), text.normalize("t").alias("m"))
    assert all(r.n == r.m for r in df.collect())
