"""One object for extract, update and retrieve over a store of tables; models are injected, everything else is the plans'.

Every change is a delta (see ``operators.log``): no call rewrites a table, and calls of several writers do not undo each other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import schema
from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators import dialogue, merge, store
from larkspur.operators.log import Delta, Store
from larkspur.operators.rounds import checkpoint
from larkspur.plans import extract as X
from larkspur.plans import retrieve as R


# Name: (columns, key, columns that a later upsert does not change).
TABLES = {
    "topics": ("topic_id string, topic_idx int, topic_text string, source_conversation_ids array<string>", "topic_id", ()),
    "memories": (schema.MEMORIES, "memory_id", ("created_at", "user_id")),
    "vectors": ("memory_id string, dense array<double>", "memory_id", ()),
    "documents": ("doc_key string, user_id string, memory_type string, memory_category string, n bigint, markdown string", "doc_key", ()),
}


class Engine:
    """embed: text Column -> vector Column; answer: (kind, topic text) Columns -> answer Column, or a replay table."""

    def __init__(self, spark: SparkSession, root: str, answer=None, embed=None, scorer=None, compress=None):
        self.spark, self.store, self.answer, self.scorer = spark, Store(spark, root), answer, scorer
        self.compress = compress
        self.embed = embed or (lambda text: V.hash_embedding(T.bm25_terms(text)))

        self.store.ensure(**TABLES)

    def memories(self) -> DataFrame:
        return self.store.read("memories")

    def vectors(self) -> DataFrame:
        return self.store.read("vectors")

    def extract(self, histories: DataFrame, now: str, force_kind: bool = True) -> tuple[dict[str, int], DataFrame]:
        """All histories at once; topics, memories and vectors become visible in one commit. Gives row counts and the rejected histories."""
        valid, rejected = dialogue.validate_history(histories, now)
        messages = valid.select("user_id", F.col("conversation_id").alias("conv_id"), "conversation_time", F.posexplode("messages").alias("turn", "m"))
        messages = messages.select("user_id", "conv_id", "conversation_time", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.col("turn").alias("seq"))
        topics, found, _ = X.extract(messages, self.answer, self.compress, force_kind=force_kind, embed=self.embed)
        owner = valid.select(F.col("conversation_id").alias("conv_id"), "user_id", F.try_to_timestamp("conversation_time").alias("created_at"))
        placed = found.join(topics.select("topic_id", "conv_id"), "topic_id").join(owner, "conv_id")
        new = placed.select(
            "memory_id", "user_id", "memory_content", "memory_type", "memory_category", F.lit("active").alias("status"), "created_at", "importance", "confidence",
            F.lit(0).alias("retrieval_count"), F.lit(None).cast("timestamp").alias("last_retrieved_at"), F.array("topic_id").alias("source_topic_ids"),
            F.create_map(F.col("topic_id"), F.col("cites")).alias("source_topic_cites"), F.array().cast("array<string>").alias("derived_from_memory_ids"),
            F.lit(0).alias("derived_memory_count"), F.lit(None).cast("string").alias("metadata"),
        )
        topic_rows = topics.select("topic_id", "topic_idx", "topic_text", F.array("conv_id").alias("source_conversation_ids"))
        new = checkpoint(new)  # written once: the model is not asked again for the vectors
        points = new.select("memory_id", self.embed(F.col("memory_content")).alias("dense"))
        self.store.append(Delta("topics", "upsert", topic_rows), Delta("memories", "upsert", new), Delta("vectors", "upsert", points))
        return {name: self.store.read(name).count() for name in ("topics", "memories", "vectors")}, rejected

    def clusters(self, threshold: float = 0.5) -> DataFrame:
        """The clusters a merge model is asked about: (memory_id, component)."""
        active = self.memories().where("status = 'active'").join(self.vectors(), "memory_id")
        return merge.clusters(active, ["user_id", "memory_type", "memory_category"], "memory_id", "dense", threshold)

    def update(self, decisions: DataFrame, now: str, threshold: float = 0.5) -> DataFrame:
        """A sleep pass over all users, then the category documents; gives the report."""
        memories, vectors = self.memories(), self.vectors()
        gone, merged, report = merge.sleep_pass(memories, vectors, decisions, now, threshold, self.embed)
        gone, merged, report = checkpoint(gone), checkpoint(merged), checkpoint(report)
        added = memories.where("status = 'active'").select("memory_id", "memory_content").join(vectors, "memory_id", "left_anti").unionByName(merged.select("memory_id", "memory_content"))
        whole = memories.limit(0).unionByName(merged, allowMissingColumns=True)
        self.store.append(
            Delta("memories", "patch", gone.withColumn("status", F.lit("archived"))), Delta("memories", "upsert", whole),
            Delta("vectors", "upsert", added.select("memory_id", self.embed(F.col("memory_content")).alias("dense"))),
        )
        docs = store.category_docs(self.memories())
        self.store.append(Delta("documents", "upsert", docs.withColumn("doc_key", F.concat_ws("\u0001", "user_id", "memory_type", "memory_category"))))
        return report

    def retrieve(self, queries: DataFrame, now: str, k: int = 10, bump: bool = True, **options) -> DataFrame:
        """Ranked memories of all queries; with ``bump`` the hits are counted, by a delta of one row a memory."""
        hits = checkpoint(R.retrieve(self.memories(), self.vectors(), queries, now, k, scorer=self.scorer, embed=self.embed, **options))
        if bump:
            seen = hits.select("query_id", "memory_id").distinct()
            self.store.append(Delta("memories", "bump", seen.select("memory_id", F.lit(1).alias("retrieval_count"), F.lit(now).cast("timestamp").alias("last_retrieved_at"))))
        return hits
