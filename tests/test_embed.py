"""One pass for dense and sparse embeddings, with any model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import embed
from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators import search


class Lengths:
    """A model that gives the length of a text, and counts how often it was made."""

    def encode(self, texts, return_dense=True, return_sparse=True):
        assert len(texts) <= 2
        return {"dense": np.array([[len(t), 1.0] for t in texts]), "sparse": [{len(t): 0.5} for t in texts]}


class Short(Lengths):
    def encode(self, texts, **options):
        return {k: v[:-1] for k, v in super().encode(texts).items()}


def test_any_model(spark):
    df = spark.createDataFrame([("a", "x"), ("bb", "y"), (None, "z"), ("dddd", "w"), ("e", "v")], "text string, dense string").coalesce(1)
    rows = embed.embedded(df, "text", model=Lengths, dim=2, batch=2).collect()
    assert [(r.text, r.dense, r.sparse) for r in rows] == [(t, [float(len(t or "")), 1.0], {len(t or ""): 0.5}) for t in ("a", "bb", None, "dddd", "e")]
    only = df.select(embed.embedding(F.col("text"), Lengths, 2, sparse=False, batch=2).alias("e")).first().e
    assert only.dense == [1.0, 1.0] and only.sparse is None
    with pytest.raises(ValueError):
        embed.embedding(F.col("text"), dense=False, sparse=False)
    for options in ({"model": Lengths, "dim": 3}, {"model": Short, "dim": 2}):
        with pytest.raises(Exception, match="the model"):
            embed.embedded(df, "text", batch=2, **options).collect()
    assert embed.embedded(df.limit(0), "text", model=Lengths).count() == 0


def test_hash_model_is_the_column_one(spark):
    df = spark.createDataFrame([(1, "Tea tea 42 茶茶 é"), (2, ""), (3, "the same tea")], "id int, text string")
    got = embed.embedded(df.withColumn("own", V.hash_embedding(T.bm25_terms(F.col("text")))), "text").collect()
    assert all(r.dense == pytest.approx(r.own) for r in got) and sorted(got[0].sparse.values()) == [1.0, 2.0, 2.0] and got[1].sparse == {}
    e = embed.embedded(df.withColumn("user_id", F.lit("u")), "text")
    weights = embed.sparse_weights(e.withColumn("memory_id", F.col("id")), ["user_id", "memory_id"])
    asked = embed.sparse_weights(e.where("id = 3").withColumn("query_id", F.col("id")), ["user_id", "query_id"], "qw")
    assert {r.memory_id: r.sparse_score for r in search.sparse_topk(weights, asked).collect()} == {1: 2.0, 3: 3.0}


def test_matrix(spark):
    q = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [3.0, 4.0]), ("r", 3, [1.0, 1.0])], "pool string, query_id int, qdense array<double>")
    d = spark.createDataFrame([("p", "b", [0.0, 2.0]), ("p", "a", [5.0, 0.0]), ("s", "c", [1.0, 1.0])], "pool string, doc_id string, dense array<double>")
    got = {r.query_id: (r.doc_ids, [round(x, 9) for x in r.scores]) for r in embed.score_matrix(q, d, "pool").collect()}
    assert got == {1: (["a", "b"], [1.0, 0.0]), 2: (["a", "b"], [0.6, 0.8])}
    assert {r.query_id: r.scores for r in embed.score_matrix(q, d, "pool", False).collect()}[2] == [15.0, 8.0]


class Wide:
    """Gives 1000 weights a text, and at the id 0 the most memory (MB) that its process has had."""

    def encode(self, texts, **options):
        import resource

        most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return {"dense": None, "sparse": [{0: most} | {i: float(i) for i in range(1, 1000)} for _ in texts]}


def test_answers_are_not_held_as_objects(spark):
    """As Python objects, the answers for one column of 4000 texts take some 350 MB."""
    df = spark.range(0, 4000, 1, 1).select(F.col("id").cast("string").alias("text"))
    memory = df.select(embed.embedding(F.col("text"), Wide, dense=False)["sparse"][0].alias("mb")).agg(F.min("mb"), F.max("mb")).first()
    assert memory[1] - memory[0] < 150
