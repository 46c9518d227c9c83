"""Rolling BM25 statistics: a stream in several batches ends where one pass over all documents does."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import search
from larkspur.operators.log import Store
from larkspur.streaming import bm25_state


def documents(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    user = F.when(F.col("conv_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("conv_id") % 3))
    return c.select(user.alias("user_id"), F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("text").alias("memory_content"), ts.alias("ts"))


def run(spark, tmp_path, store):
    source = spark.readStream.schema(documents(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = bm25_state.keep(source, store, "counts", f"{tmp_path}/checkpoint", slots=3)
    q.awaitTermination(300)
    assert q.exception() is None


def batch(docs):
    postings, stats = search.bm25_index(docs)
    return {tuple(r) for r in stats.select("user_id", "n_docs", F.round("avgdl", 9), "n_terms", "max_df").collect()}, {tuple(r) for r in postings.select("user_id", "term", "df").distinct().collect()}


def kept(store):
    counts = store.read("counts")
    return {tuple(r) for r in bm25_state.stats(counts).select("user_id", "n_docs", F.round("avgdl", 9), "n_terms", "max_df").collect()}, {tuple(r) for r in bm25_state.document_frequencies(counts).collect()}


def test_stream_ends_as_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    docs = documents(spark).cache()
    early = docs.where("ts < '2024-01-01 00:06:00'")
    early.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    early.limit(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # delivered twice
    store = Store(spark, f"{tmp_path}/store", buckets=2)
    run(spark, tmp_path, store)
    assert kept(store) == batch(early)
    # restarted from the checkpoint, with more documents and an empty one
    blank = docs.limit(1).withColumns({"memory_id": F.lit("blank"), "memory_content": F.lit(" ?! "), "ts": F.lit("2024-01-01 00:07:00").cast("timestamp")})
    docs.where("ts >= '2024-01-01 00:06:00'").unionByName(blank).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, store)
    assert kept(store) == batch(docs)
    assert store.read("counts").where("user_id = 'hot'").select("slot").distinct().count() == 3
    docs.unpersist()


def test_null_repeated_and_empty_documents(spark, tmp_path):
    """Words that repeat count once a document; a user that is null has counts of its own, which no statistics give."""
    pytest.importorskip("google.protobuf")
    rows = [("a", "1", "Tea tea, TEA 12 12 \u8336\u8336"), ("a", "1", "Tea tea, TEA 12 12 \u8336\u8336"), ("a", "2", None), ("a", "3", " ?! "), ("a", "4", "tea x1y"), (None, "5", "tea"), ("a", None, "milk"), ("", "6", "one")]
    docs = spark.createDataFrame(rows, "user_id string, memory_id string, memory_content string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/store", buckets=2)
    run(spark, tmp_path, store)
    counts = store.read("counts")
    assert {tuple(r) for r in bm25_state.stats(counts).collect()} == {("a", 3, 4.0, 7, 2), ("", 1, 1.0, 1, 1)}
    got = {tuple(r) for r in bm25_state.document_frequencies(counts).collect()}
    assert got == {("a", t, n) for t, n in {"tea": 2, "12": 1, "\u8336": 1, "x": 1, "1": 1, "y": 1, "milk": 1}.items()} | {(None, "tea", 1), ("", "one", 1)}


def test_documents_are_exchanged_as_their_distinct_terms(spark, tmp_path):
    """A text of one word, many times over, costs the stream's exchanges no more than the word."""
    pytest.importorskip("google.protobuf")
    text = "tea " * 50_000
    docs = spark.createDataFrame([("a", str(i), text) for i in range(8)], "user_id string, memory_id string, memory_content string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", bm25_state.PROVIDER)
    plans = []
    stream = bm25_state.changes(source, slots=3).writeStream.foreachBatch(lambda batch, _: plans.append((batch._jdf.queryExecution().executedPlan().toString(), batch.collect())))
    stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(300)
    plan, rows = plans[0]
    for part in plan.split("Exchange ")[1:]:
        assert "memory_content" not in part.split("\n")[1], plan
    assert sum(r.n_docs or 0 for r in rows) == 8 and sum(r.length or 0 for r in rows) == 400_000 and sum(r.df or 0 for r in rows) == 8
