"""Consolidation: clusters of similar memories, merged scores and provenance, archived sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import json as J
from larkspur.functions import text as T
from larkspur.operators.graph import components
from larkspur.operators.rounds import checkpoint
from larkspur.operators.search import similar_links


def clusters(items: DataFrame, buckets: list[str], key: str, vector: str, threshold: float) -> DataFrame:
    """(key, component) for the members of clusters of two or more, within buckets."""
    return components(similar_links(items, buckets, key, vector, threshold)).withColumnRenamed("id", key)


def missing_vectors(memories: DataFrame, vectors: DataFrame, embed) -> DataFrame:
    """Memories with their stored vector, or one made from the content; only missing ones are embedded."""
    have = memories.join(vectors, "memory_id").withColumn("embedded", F.lit(False))
    lack = memories.join(vectors, "memory_id", "left_anti").withColumn("dense", embed(F.col("memory_content"))).withColumn("embedded", F.lit(True))
    return have.unionByName(lack)


def merged_topics(members: DataFrame) -> DataFrame:
    """(cluster, topic_ids) of members (cluster, position, source_topic_ids): union in the order they are first met."""
    rows = members.select("cluster", "position", F.posexplode("source_topic_ids").alias("i", "topic_id"))
    first = rows.groupBy("cluster", "topic_id").agg(F.min(F.struct("position", "i")).alias("at"))
    out = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "topic_id"))).alias("x"))
    return out.select("cluster", F.transform("x", lambda e: e["topic_id"]).alias("topic_ids"))


def merged_cites(members: DataFrame) -> DataFrame:
    """(cluster, cites map) of members (cluster, source_topic_cites): union of the indexes of each topic, sorted."""
    rows = members.select("cluster", F.explode("source_topic_cites").alias("topic_id", "cites")).select("cluster", "topic_id", F.explode("cites").alias("cite"))
    each = rows.groupBy("cluster", "topic_id").agg(F.array_sort(F.collect_set("cite")).alias("cites"))
    return each.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic_id", "cites")))).alias("cites"))


def merged_scores(members: DataFrame, decisions: DataFrame, digits: int = 9) -> DataFrame:
    """The decision's score, where it is neither missing nor 0; else the greatest importance and the mean confidence; clamped."""
    agg = members.groupBy("cluster").agg(F.max("importance").alias("most"), F.avg("confidence").alias("mean"), F.count("*").alias("merged_count"))
    pick = lambda given, own: J.safe_unit(F.coalesce(F.when(F.col(given) != 0, F.col(given)), F.col(own)))
    out = agg.join(decisions, "cluster", "left")
    return out.select("cluster", F.round(pick("llm_importance", "most"), digits).alias("importance"), F.round(pick("llm_confidence", "mean"), digits).alias("confidence"), "merged_count")


def sleep_pass(memories: DataFrame, vectors: DataFrame, decisions: DataFrame, now: str, threshold: float = 0.5, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids to archive, merged memories to add, report) of one sleep pass for all users.

    decisions (component, should_merge, merged_content, memory_type, memory_category, llm_importance, llm_confidence) stand for the model's
    answers; a cluster without one, or with a blank content, is left as it is.  Sources are archived, the merged memory lists them newest first.
    """
    active = missing_vectors(memories.where("status = 'active'"), vectors, embed) if embed else memories.where("status = 'active'").join(vectors, "memory_id")
    grouped = checkpoint(clusters(active, ["user_id", "memory_type", "memory_category"], "memory_id", "dense", threshold))
    good = decisions.where("should_merge AND trim(merged_content) != ''")
    members = memories.join(grouped, "memory_id").join(good.select("component"), "component", "left_semi")
    members = members.withColumn("cluster", F.col("component")).withColumn("position", F.row_number().over(W.partitionBy("component").orderBy(F.desc("created_at"), "memory_id")))
    scores = merged_scores(members, good.select(F.col("component").alias("cluster"), "llm_importance", "llm_confidence"))
    first = members.where("position = 1").select("cluster", "user_id", F.col("memory_type").alias("t"), F.col("memory_category").alias("c"))
    sources = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("position", "memory_id"))).alias("x"))
    merged = (
        first.join(scores, "cluster").join(sources, "cluster").join(merged_topics(members), "cluster", "left").join(merged_cites(members), "cluster", "left")
        .join(good.withColumnRenamed("component", "cluster").drop("llm_importance", "llm_confidence", "should_merge"), "cluster")
        .select(
            T.deterministic_id("mem_", F.col("user_id"), F.col("cluster"), F.lit(now)).alias("memory_id"), "user_id", F.trim("merged_content").alias("memory_content"),
            F.coalesce(T.blank_to_null(F.col("memory_type")), F.col("t")).alias("memory_type"), F.coalesce(T.blank_to_null(F.col("memory_category")), F.col("c")).alias("memory_category"),
            F.lit("active").alias("status"), F.lit(now).cast("timestamp").alias("created_at"), "importance", "confidence", F.col("topic_ids").alias("source_topic_ids"),
            F.col("cites").alias("source_topic_cites"), F.transform("x", lambda e: e["memory_id"]).alias("derived_from_memory_ids"), F.col("merged_count").cast("int").alias("derived_memory_count"),
        )
    )
    report = grouped.agg(F.countDistinct("component").alias("clusters")).join(merged.agg(F.count("*").alias("merged"), F.sum("derived_memory_count").alias("archived")), F.lit(True))
    return members.select("memory_id"), merged, report


def consolidate(memories: DataFrame, vectors: DataFrame, decisions: DataFrame, now: str, threshold: float = 0.5, embed=None) -> tuple[DataFrame, DataFrame]:
    """(memories after one sleep pass, report) for all users."""
    gone, merged, report = sleep_pass(memories, vectors, decisions, now, threshold, embed)
    kept = memories.join(gone.withColumn("_status", F.lit("archived")), "memory_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return kept.unionByName(merged, allowMissingColumns=True), report
