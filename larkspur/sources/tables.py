"""Readers: histories from JSON, and the driver's tables seen as this engine's entities.

The derived views are plain projections, so that filters and column pruning reach the
Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import schema

EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Conversation histories as JSON files; records that do not parse are dropped."""
    return spark.read.schema(schema.HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def category_documents(spark: SparkSession, root: str) -> DataFrame:
    """Stored Markdown documents: (user_id, dir, category, markdown), from <root>/<user>/<Type Memory>/<category>.md."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("path", F.input_file_name())
    part = F.split(F.url_decode("path"), "/")
    return rows.select(F.element_at(part, -3).alias("user_id"), F.element_at(part, -2).alias("dir"), F.regexp_replace(F.element_at(part, -1), r"\.md$", "").alias("category"), F.col("value").alias("markdown"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds + F.lit(EPOCH))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories of ten users."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("m"), d).alias("memory_id"),
        F.concat(F.lit("u"), d % 10).alias("user_id"),
        F.col("text").alias("memory_content"),
        F.when(d % 3 == 0, "profile").when(d % 3 == 1, "episodic").otherwise("state").alias("memory_type"),
        F.col("lang").alias("memory_category"),
        F.when(d % 11 == 0, "archived").otherwise("active").alias("status"),
        at(d * 3600).alias("created_at"),
        ((d * 37 % 101) / 100.0).alias("importance"),
        ((d * 53 % 97) / 100.0).alias("confidence"),
        F.array(F.concat(F.lit("t"), F.floor(d / 10)), F.concat(F.lit("t"), F.floor(d / 7))).alias("source_topic_ids"),  # the latter ones dangle
        F.create_map(F.concat(F.lit("t"), F.floor(d / 10)), F.array((d % 5).cast("int"), (d % 3).cast("int"))).alias("source_topic_cites"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark texts as queries of the ten users."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat(F.lit("u"), i % 10).alias("user_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as memories whose user is the label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").alias("user_id"), F.col("embedding").alias("dense"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a topic: messages are numbered within it."""
    c = table(spark, sf_dir, "conversations")
    m = F.struct(F.col("turn").cast("int").alias("index"), F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("topic_messages"))
    cid = F.col("conv_id")
    return rows.select(
        F.concat(F.lit("t"), cid).alias("topic_id"), F.array(F.concat(F.lit("c"), cid % 4), F.concat(F.lit("c"), cid)).alias("source_conversation_ids"), "topic_messages"
    )
