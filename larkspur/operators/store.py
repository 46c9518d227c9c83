"""The memory store's operations as joins over whole tables; ``log`` keeps tables between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",), seq: str | None = None) -> DataFrame:
    """Rows of new replace those of old by key; ``keep`` columns stay as they were. Of several new rows the last by seq counts."""
    if seq:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).where("_r = 1").drop("_r", seq)
    was = old.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in keep])
    fresh = new.join(was, key, "left").select(*[F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns])
    return old.join(new.select(key), key, "left_anti").unionByName(fresh)


def set_payload(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The given keys of a payload change, null ones do not."""
    cols = [c for c in changes.columns if c != key]
    joined = old.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns])


def update_status(old: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """S22."""
    hit = ids.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    return old.join(hit, "memory_id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(old.columns)


def bump_retrieval(old: DataFrame, hits: DataFrame, key: str = "memory_id") -> DataFrame:
    """Hits (query_id, memory_id, at): one count a query, however often it names a memory."""
    n = hits.groupBy(key).agg(F.countDistinct("query_id").alias("_n"), F.max("at").alias("_at"))
    out = old.join(n, key, "left").withColumn("retrieval_count", F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    return out.withColumn("last_retrieved_at", F.greatest("last_retrieved_at", "_at")).select(old.columns)


def delete(old: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """S11, S24."""
    return old.join(ids.select(key), key, "left_anti")


def get_by_ids(items: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Unknown ids are silently absent."""
    return items.join(ids.select(key).distinct(), key, "left_semi")


def list_user_memories(memories: DataFrame, limit: int, status: str | None = "active", memory_type: str | None = None, memory_category: str | None = None) -> DataFrame:
    """S21 for all users: the newest ``limit`` of each."""
    for c, v in (("status", status), ("memory_type", memory_type), ("memory_category", memory_category)):
        if v:
            memories = memories.where(F.col(c) == v)
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), "memory_id"))
    return memories.withColumn("position", n).where(F.col("position") <= limit)


def provenance(memories: DataFrame, topics: DataFrame) -> DataFrame:
    """(memory_id, conversation_ids): the distinct conversations behind a memory's topics, as first met; dangling ids drop out."""
    links = memories.select("memory_id", F.posexplode("source_topic_ids").alias("i", "topic_id"))
    found = links.join(topics.select("topic_id", F.posexplode("source_conversation_ids").alias("j", "conversation_id")), "topic_id")
    first = found.groupBy("memory_id", "conversation_id").agg(F.min(F.struct("i", "j")).alias("at"))
    out = first.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("at", "conversation_id"))).alias("x"))
    return out.select("memory_id", F.transform("x", lambda e: e["conversation_id"]).alias("conversation_ids"))


def cited_messages(memories: DataFrame, topics: DataFrame) -> DataFrame:
    """(memory_id, topic_id, position, index, content): cites in their order; missing topics and indexes are passed over."""
    cites = memories.select("memory_id", F.explode("source_topic_cites").alias("topic_id", "cites")).select("memory_id", "topic_id", F.posexplode("cites").alias("position", "index"))
    messages = topics.select("topic_id", F.explode("topic_messages").alias("m")).select("topic_id", "m.index", "m.content")
    return cites.join(messages, ["topic_id", "index"]).select("memory_id", "topic_id", "position", "index", "content")


def missing_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with their distinct evidence in order, or their planned session where there is none."""
    first = evidence.groupBy("fact_id", "dia_id").agg(F.min("position").alias("position"), F.first("session").alias("session"))
    got = first.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("position", "dia_id", "session"))).alias("x"))
    out = facts.join(got, "fact_id", "left")
    return out.select(
        "fact_id",
        F.coalesce(F.array_distinct(F.transform("x", lambda e: e["session"])), F.array("planned_session")).alias("sessions"),
        F.coalesce(F.transform("x", lambda e: e["dia_id"]), F.array().cast("array<string>")).alias("evidence"),
        F.col("x").isNull().alias("missing"),
    )


# The columns that the service's two listings show.
LISTED = ["memory_id", "memory_content", "memory_type", "memory_category", "importance", "confidence", "created_at"]
LISTED_WHOLE = ["status", "source_topic_ids", "derived_from_memory_ids"]


def memory_view(memories: DataFrame, whole: bool = False) -> DataFrame:
    """What a listing shows of memories; whole: with the status and the ids they come from, an empty list where there are none."""
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LISTED_WHOLE[1:] if whole}
    return memories.withColumns(lists).select("user_id", *LISTED, *(LISTED_WHOLE if whole else []))


def counts_by_type(memories: DataFrame) -> DataFrame:
    """(user_id, memory_type, n)."""
    return memories.groupBy("user_id", "memory_type").agg(F.count("*").alias("n"))


def category_docs(memories: DataFrame) -> DataFrame:
    """(user_id, memory_type, memory_category, n, markdown): the document of each category without a model."""
    from larkspur.functions.text import render_section

    order = F.struct((-F.col("importance")).alias("i"), (-F.col("created_at").cast("double")).alias("t"), "memory_id", F.format_string("(%.2f) %s", "importance", "memory_content").alias("b"))
    rows = memories.where("status = 'active'").groupBy("user_id", "memory_type", "memory_category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("x"))
    summary = F.concat("user_id", F.lit(" 在 "), "memory_type", F.lit("/"), "memory_category", F.lit(" 下共有 "), F.col("n").cast("string"), F.lit(" 条活跃记忆。"))
    return rows.select("user_id", "memory_type", "memory_category", "n", render_section(F.col("memory_type"), F.col("memory_category"), summary, F.transform("x", lambda e: e["b"])).alias("markdown"))


def category_payload(memories: DataFrame, most: int = 60) -> DataFrame:
    """The JSON rows of a category's prompt: the ``most`` best by importance and time."""
    n = F.row_number().over(W.partitionBy("user_id", "memory_type", "memory_category").orderBy(F.desc("importance"), F.desc("created_at"), "memory_id"))
    rows = memories.where("status = 'active'").withColumn("n", n).where(F.col("n") <= most)
    item = F.struct("n", F.col("memory_id").alias("id"), "memory_content", "importance", "confidence", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    out = rows.groupBy("user_id", "memory_type", "memory_category").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return out.select("user_id", "memory_type", "memory_category", F.to_json(F.transform("x", lambda e: e.dropFields("n"))).alias("payload"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Totals by model and over all (model null): counts below 0 are 0, a missing total is the sum of its parts."""
    p, c = (F.greatest(F.coalesce(F.col(x), F.lit(0)), F.lit(0)) for x in ("prompt_tokens", "completion_tokens"))
    t = F.greatest(F.coalesce(F.col("total_tokens"), F.lit(0)), F.lit(0))
    rows = usage.select("model", p.alias("p"), c.alias("c"), F.when(t > 0, t).otherwise(p + c).alias("t"))
    return rows.rollup("model").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("t").alias("total_tokens"), F.count("*").alias("n_calls"))


def run_states(log: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest state of each run from a log (run_id, seq, status, at), newest first."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "at"), "seq").alias("x"), F.count("*").alias("n_steps"), F.min("at").alias("started_at"))
    out = last.select("run_id", F.col("x.status").alias("status"), "started_at", F.col("x.at").alias("updated_at"), "n_steps")
    return out.orderBy(F.desc("started_at"), "run_id").limit(limit) if limit else out

