"""Hybrid retrieval reads vectors that are made from contents once."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators import search
from larkspur.plans.retrieve import retrieve


@pytest.mark.parametrize("use_mmr", [False, True])
def test_vectors_are_made_once(spark, use_mmr):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    rows = [(f"m{i}", f"u{i % 2}", f"tea {i} of kind {i % 7}", "active", 0.5, 0.5) for i in range(60)]
    memories = spark.createDataFrame(rows, "memory_id string, user_id string, memory_content string, status string, importance double, confidence double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    queries = spark.createDataFrame([(1, "u0", "tea of kind 3"), (2, "u1", "kind 5")], "query_id int, user_id string, text string")
    vectors = memories.select("memory_id", V.hash_embedding(T.bm25_terms(seen("memory_content"))).alias("dense"))
    stored = spark.createDataFrame(vectors.collect(), vectors.schema)
    want = {(r.query_id, r.rank): r.memory_id for r in retrieve(memories, stored, queries, "2024-06-01 00:00:00", 5, use_mmr=use_mmr).collect()}
    before = made.value
    got = {(r.query_id, r.rank): r.memory_id for r in retrieve(memories, vectors, queries, "2024-06-01 00:00:00", 5, use_mmr=use_mmr).collect()}
    assert got == want and len(got) == 10
    assert made.value - before == len(rows)


def test_contents_are_read_once_for_their_terms(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    rows = [(f"m{i}", f"u{i % 2}", f"tea {i} of kind {i % 7}", "active", 0.5, 0.5) for i in range(60)]
    memories = spark.createDataFrame(rows, "memory_id string, user_id string, memory_content string, status string, importance double, confidence double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    queries = spark.createDataFrame([(1, "u0", "tea of kind 3"), (2, "u1", "kind 5")], "query_id int, user_id string, text string")
    vectors = memories.select("memory_id", V.hash_embedding(T.bm25_terms(F.col("memory_content"))).alias("dense"))
    found = lambda m: {(r.query_id, r.rank): r.memory_id for r in retrieve(m, vectors, queries, "2024-06-01 00:00:00", 5, use_mmr=False).select("query_id", "memory_id", "rank").collect()}
    want = found(memories)
    assert found(memories.withColumn("memory_content", seen("memory_content"))) == want and len(want) == 10
    assert made.value == len(rows)


def test_shared_counts_give_what_contents_give(spark):
    """Repeated ids with equal and other texts, null and empty texts, users and ids that are null, users who do not ask."""
    rows = [("m1", "a", "tea and milk"), ("m1", "a", "tea and milk"), ("m1", "a", "tea tea"), ("m2", "a", None), ("m3", "a", " ?! "), ("m4", "a", "sugar sugar sugar"), (None, "a", "tea"), ("m5", None, "tea"), ("m6", "b", "tea"), ("m7", "c", "milk 1"), ("m1", "c", "tea")]
    memories = spark.createDataFrame(rows, "memory_id string, user_id string, memory_content string")
    queries = spark.createDataFrame([(1, "a", "tea tea milk"), (2, "c", "MILK"), (3, None, "tea"), (4, "a", None), (5, "d", "tea")], "query_id int, user_id string, text string")
    asked = search.term_frequencies(queries, ["query_id", "user_id"], "text").withColumn("qw", F.col("tf").cast("double")).drop("tf")
    counts = search.asked_counts(memories, asked)
    rows_of = lambda df: sorted(map(str, df.collect()))
    want = rows_of(search.bm25_topk(memories, queries, 20))
    assert rows_of(search.bm25_topk(memories, queries, 20, counts=counts)) == want and len(want) == 3
    weighted = lambda df: df.withColumn("w", F.col("tf").cast("double"))
    want = rows_of(search.sparse_topk(weighted(search.term_frequencies(memories, ["user_id", "memory_id"], "memory_content", asked)), asked, 20))
    assert rows_of(search.sparse_topk(weighted(counts.where(F.col("term") != search.WHOLE)), asked, 20)) == want and len(want) == 3
