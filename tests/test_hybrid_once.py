from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.operators import embedding as E
from docfathom.operators import retrieval as R


def _texts() -> list[str]:
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
    plain = [" ".join(word("abcdeXYZ01.+#-") for _ in range(rng.choice([1, 5, 300]))) for _ in range(30)]
    return [*plain, "", " ", "a", "ab", "abc", "\n\t x", "\x00\x7f~a", "naïve Größe 日本語 中 文字 text", "İstanbul 😀😀😀", "中", "aaaaaa", *(" ".join(word("abé中文 ") for _ in range(40)) for _ in range(5))]


@pytest.mark.parametrize("provider", [E.LocalProvider(), E.LocalProvider(16, {"letters": ["a", "b"], "none": ["qqqq"]})])
def test_vectors_are_those_of_the_features_bit_by_bit(provider):
    for text, got in zip(_texts(), provider.embed_documents(_texts()), strict=True):
        v = np.zeros(provider.dimensions)
        for feature, weight in provider.features(text).items():
            place, sign = E._place(feature)
            v[place % provider.dimensions] += sign * weight
        norm = float(np.sqrt((v * v).sum()))
        assert got == ([0.0] * provider.dimensions if norm == 0 else [round(x, 8) for x in (v / norm).tolist()])


class Counting(E.LocalProvider):
    def __init__(self, folder: str):
        super().__init__(16)
        self.folder = folder

    def embed_documents(self, texts):
        for _ in texts:
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return super().embed_documents(texts)


def test_documents_are_embedded_once(spark, tmp_path):
    docs = spark.range(40).select(
        F.concat(F.lit("d"), "id").alias("id"), F.col("id").alias("position"), F.concat(F.lit("title "), "id").alias("title"), F.concat(F.lit("/d/"), "id", F.lit("/")).alias("url"),
        F.array(F.lit("en")).alias("tags"), F.array(F.lit("s")).alias("categories"), F.lit("").alias("section"), F.concat(F.lit("text of number "), F.hex("id")).alias("content"),
    )
    asked = spark.createDataFrame([(1, "text of number 3"), (2, "title 7")], "query_id long, question string")
    query_vectors, vectors = E.embed(asked, "question", E.LocalProvider(16)), E.embed(docs, "content", E.LocalProvider(16))
    own = E.embed(docs.select("id", "position", "content"), "content", Counting(str(tmp_path)))
    got = R.hybrid(docs, asked, own, query_vectors, embedded=True).select("query_id", "id", "rank", "rerank_score", "lexical_coverage").collect()
    assert len(list(tmp_path.iterdir())) == 40
    want = R.hybrid(docs, asked, vectors, query_vectors).select("query_id", "id", "rank", "rerank_score", "lexical_coverage").collect()
    assert got and sorted(got) == sorted(want)


def test_vectors_that_are_not_regular_are_refused(spark):
    class Broken(E.LocalProvider):
        def embed_documents(self, texts):
            return [[float("nan")] * self.dimensions for _ in texts]

    with pytest.raises(Exception, match="INVALID_EMBEDDING"):
        E.embed(spark.createDataFrame([("a",)], "t string"), "t", Broken(4)).collect()
