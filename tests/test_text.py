from __future__ import annotations

from pyspark.sql import functions as F

from docfathom.functions import text as X


def test_accented_letters_bound_words_of_negation(spark):
    texts = ["que noñado", "esto no", "énever", "nothing, knot", "NOT_now", "Without", "no9", None, "没有"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.has_negation(F.col("t")))
    assert [r[0] for r in got.collect()] == [True, True, True, False, False, True, False, False, True]
