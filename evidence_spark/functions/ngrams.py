"""Character n-grams inside word boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence_spark.functions.text import words


def count_ngrams(df: DataFrame, text: str, keys: list[str], n_min: int, n_max: int) -> DataFrame:
    """How often each n-gram occurs per key: the ``keys`` columns, ``gram`` and ``tf``.

    Words are lower-cased and padded with one blank on both sides.  A padded word
    that is not longer than ``n_min`` gives itself once; no gram is longer than its
    word.  Words are counted first, so a repeated word is taken apart once.  The
    grams come from generators over plain substrings, which stay inside generated
    code.
    """
    if not 1 <= n_min <= n_max:
        raise ValueError(f"bad n-gram range {n_min}..{n_max}")
    found = df.select(*keys, F.explode(words(F.lower(text))).alias("w"))
    padded = (
        found.groupBy(*keys, "w")
        .agg(F.count("*").alias("n"))
        .select(*keys, "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    )
    starts = padded.select(
        *keys,
        "n",
        "w",
        F.explode(F.sequence(F.lit(1), F.greatest(F.length("w") - (n_min - 1), F.lit(1)))).alias("i"),
    )
    grams = [F.substring("w", F.col("i"), F.lit(n_min))] + [
        F.when(F.col("i") + n - 1 <= F.length("w"), F.substring("w", F.col("i"), F.lit(n)))
        for n in range(n_min + 1, n_max + 1)
    ]
    return (
        starts.select(*keys, "n", F.explode(F.array(*grams)).alias("gram"))
        .where(F.col("gram").isNotNull())
        .groupBy(*keys, "gram")
        .agg(F.sum("n").alias("tf"))
    )
