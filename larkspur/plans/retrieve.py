"""Hybrid retrieval for all queries in one plan: three recalls, fusion, weighting, reranking, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators import ranking, search
from larkspur.operators.rounds import checkpoint

WEIGHTS = [1.0, 0.8, 0.7]
#: Fused hits (some 100 bytes each) up to which they are broadcast to the memories they name, whose contents then are not shuffled.
BROADCAST_HITS = 200_000


def retrieve(memories: DataFrame, vectors: DataFrame, queries: DataFrame, now: str, k: int = 10, tau_days: float = 30.0, use_mmr: bool = True, scorer=None, embed=None, memory_type: str | None = None, memory_category: str | None = None) -> DataFrame:
    """(query_id, memory_id, ..., final_score, rank) for queries (query_id, user_id, text).

    Recall is max(5k, 30) a path (BM25 fetches twice that, and is filtered by type and category after its cut); the pool is 3k.  ``scorer`` is
    a cross-encoder as a function of (query, content) columns; without one the pool is ordered by the fallback: dense score, else fused score.
    With MMR the pool is then thinned to k by the vectors; else it is cut.

    The vectors of the wanted memories, which may be made from the contents as they are read, are read once and written to the shared folder, and so are
    the short lists that several steps read. The counts of terms that BM25 and sparse recall share are on the executors' disks until the lists are fused.
    """
    embed = embed or (lambda text: V.hash_embedding(T.bm25_terms(text)))
    recall = max(5 * k, 30)
    active = memories.where("status = 'active'")
    wanted = active
    for c, v in (("memory_type", memory_type), ("memory_category", memory_category)):
        if v:
            wanted = wanted.where(F.col(c) == v)
    asked = checkpoint(queries.select("query_id", "user_id", embed(F.col("text")).alias("qdense")))
    items = checkpoint(wanted.select("user_id", "memory_id").join(vectors.select("memory_id", "dense"), "memory_id"))
    dense = checkpoint(search.dense_topk(items, asked, recall, digits=6).select("query_id", "memory_id", "dense_score", "dense_rank"))
    q_terms = search.term_frequencies(queries, ["query_id", "user_id"], "text").withColumn("qw", F.col("tf").cast("double")).drop("tf")
    counts = search.asked_counts(active, q_terms).persist(StorageLevel.DISK_ONLY)
    try:
        # memories of one id and several lengths have a row a length, whose weights sparse recall adds up
        terms = counts.where(F.col("term") != search.WHOLE) if wanted is active else search.term_frequencies(wanted, ["user_id", "memory_id"], "memory_content", q_terms)
        sparse = search.sparse_topk(terms.withColumn("w", F.col("tf").cast("double")), q_terms, recall)
        bm25 = search.bm25_topk(active, queries, 2 * recall, counts=counts)
        if memory_type or memory_category:
            bm25 = bm25.join(wanted.select("memory_id"), "memory_id", "left_semi")
        lists = [x.select("query_id", F.col("memory_id").alias("key"), F.col(r).alias("rank")) for x, r in ((dense, "dense_rank"), (sparse, "sparse_rank"), (bm25, "bm25_rank"))]
        fused = checkpoint(ranking.rrf(lists, recall, weights=WEIGHTS).withColumnRenamed("key", "memory_id"))
    finally:
        counts.unpersist()
    fused = F.broadcast(fused) if fused.count() <= BROADCAST_HITS else fused
    scored = ranking.final_score(fused.join(active.drop("user_id"), "memory_id"), F.lit(now), tau_days)
    pool = search.top_k(scored, ["query_id"], "final_score", "memory_id", max(3 * k, k), "pool_rank")
    pool = pool.join(dense.select("query_id", "memory_id", "dense_score"), ["query_id", "memory_id"], "left")
    if scorer is not None:
        pool = pool.join(queries.select("query_id", F.col("text").alias("query")), "query_id").withColumn("bge_score", scorer(F.col("query"), F.col("memory_content"))).drop("query")
        pool = search.top_k(pool, ["query_id"], "bge_score", "memory_id", 3 * k, "bge_rank")
    else:
        keyed = pool.withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0))).withColumnsRenamed({"memory_id": "key"}).withColumn("score", F.col("rrf_score"))
        pool = ranking.fallback_rerank(keyed, 3 * k).withColumnRenamed("key", "memory_id")
    if not use_mmr:
        return pool.where(F.col("bge_rank") <= k).withColumn("rank", F.col("bge_rank"))
    pool = checkpoint(pool)
    ready = pool.select("query_id", "memory_id", "bge_rank").join(items.drop("user_id"), "memory_id").join(asked.select("query_id", "qdense"), "query_id")
    picked = ranking.mmr(ready.select("query_id", F.col("memory_id").alias("key"), F.col("bge_rank").alias("position"), "dense", "qdense"), k)
    return pool.join(picked.withColumnRenamed("key", "memory_id"), ["query_id", "memory_id"]).withColumn("rank", F.col("mmr_rank"))


def sql(mem: str, bm25: str, terms: str, pool: int) -> str:
    """The model-free path for the driver's tables, k = 10, up to the reranked pool: a WITH clause that ends in ``ranked``."""
    vec = lambda name, source, key: f"""{name}_t AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS d FROM (SELECT {key}, unnest({terms.format('x')}) AS t FROM ({source}))),
{name}_w AS (SELECT {key}, d, count(*)::DOUBLE AS w FROM {name}_t GROUP BY ALL), {name} AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS u FROM {name}_w)"""  # noqa: E731
    return f"""WITH {mem}, {bm25},
{vec('mv', "SELECT memory_id, memory_content AS x FROM mem WHERE status = 'active'", 'memory_id')}, {vec('qv', 'SELECT item_id AS query_id, text AS x FROM benchmark', 'query_id')},
act AS (SELECT * FROM mem WHERE status = 'active'), qs AS (SELECT item_id AS query_id, 'u' || (item_id % 10) AS user_id FROM benchmark),
pr AS (SELECT query_id, act.memory_id, sum(qv.u * mv.u) AS s FROM qs JOIN act USING (user_id) JOIN qv USING (query_id) JOIN mv ON mv.memory_id = act.memory_id AND mv.d = qv.d GROUP BY query_id, act.memory_id),
de AS (SELECT query_id, act.memory_id, round(coalesce(s, 0), 6) AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 6) DESC, act.memory_id) AS rank
  FROM qs JOIN act USING (user_id) LEFT JOIN pr USING (query_id, memory_id) QUALIFY rank <= 50),
sp AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, round(sum(qtf::DOUBLE * tf), 6) AS s FROM qt JOIN tf USING (user_id, term) GROUP BY ALL) QUALIFY rank <= 50),
bk AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, memory_id) AS rank FROM bm QUALIFY rank <= 100),
ls AS (SELECT query_id, memory_id, rank, 0 AS list, 1.0::DOUBLE AS w FROM de UNION ALL SELECT query_id, memory_id, rank, 1, 0.8::DOUBLE FROM sp UNION ALL SELECT query_id, memory_id, rank, 2, 0.7::DOUBLE FROM bk),
fu AS (SELECT query_id, memory_id, round(sum(w / (60 + rank)), 9) AS rrf_score, min({{'r': rank, 'l': list}}) AS best FROM ls GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best.r, best.l, memory_id) AS n FROM fu QUALIFY n <= 50),
fs AS (SELECT query_id, memory_id, rrf_score, round(rrf_score * exp(-greatest(0, epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) / 86400000000.0 / 30) * (0.6 + 0.4 * importance) * (0.5 + 0.5 * confidence), 9) AS final_score FROM rr JOIN act USING (memory_id)),
po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, memory_id) AS n FROM fs QUALIFY n <= 30),
re AS (SELECT po.query_id, po.memory_id, final_score, CASE WHEN coalesce(dense_score, 0) <> 0 THEN dense_score ELSE rrf_score END AS b FROM po LEFT JOIN de USING (query_id, memory_id)),
ranked AS MATERIALIZED (SELECT query_id, memory_id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, memory_id) AS position FROM re QUALIFY position <= {pool})"""
