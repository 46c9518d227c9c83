"""The driver's queries over its tables, each beside the SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import embed
from larkspur.functions import json as J
from larkspur.functions import text as T
from larkspur.functions import time as D
from larkspur.operators import compress, dialogue, documents, log, merge, ranking, scroll, search, store, validate
from larkspur.operators.rounds import checkpoint, shared_folder
from larkspur.plans import extract, prompts, retrieve
from larkspur.sources import tables as S
from larkspur.streaming import bm25_state, incremental

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

# Shared pieces of the SQL side.
MEM = """mem AS (SELECT doc_id, 'm' || doc_id AS memory_id, 'u' || (doc_id % 10) AS user_id, text AS memory_content,
  CASE doc_id % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'episodic' ELSE 'state' END AS memory_type, lang AS memory_category,
  CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status, make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS created_at,
  (doc_id * 37 % 101)::DOUBLE / 100 AS importance, (doc_id * 53 % 97)::DOUBLE / 100 AS confidence FROM documents)"""
TERMS = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z]+|[0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
COUNT = r"(len(regexp_extract_all(coalesce({0}, ''), '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]')) + len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+')))"
MSG = """msg AS (SELECT conv_id, turn, lower(trim(role)) AS role, trim(text) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq
  FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant', 'system') AND trim(text) <> '')"""
REC = f"""rec AS (SELECT conv_id, seq // 2 AS record, string_agg(content, '' ORDER BY seq) AS text, count(*) AS n_messages, sum({COUNT.format("content")}) AS tokens FROM msg GROUP BY ALL)"""
SEG = f"""tok AS (SELECT conv_id, record, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS d FROM (SELECT conv_id, record, unnest({TERMS.format("text")}) AS t FROM rec)),
tf AS (SELECT conv_id, record, d, count(*)::DOUBLE AS w FROM tok GROUP BY ALL),
nrm AS (SELECT conv_id, record, sqrt(sum(w * w)) AS n FROM tf GROUP BY ALL),
dots AS (SELECT a.conv_id, a.record, sum(a.w * b.w) AS s FROM tf a JOIN tf b ON a.conv_id = b.conv_id AND a.record = b.record + 1 AND a.d = b.d GROUP BY ALL),
sim AS (SELECT r.conv_id, r.record, CASE WHEN r.record > 0 THEN round(coalesce(s / (n1.n * n0.n), 0), 9) END AS similarity FROM rec r
  LEFT JOIN dots USING (conv_id, record) LEFT JOIN nrm n1 ON n1.conv_id = r.conv_id AND n1.record = r.record LEFT JOIN nrm n0 ON n0.conv_id = r.conv_id AND n0.record = r.record - 1),
tot AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n FROM rec JOIN sim USING (conv_id, record)),
cut AS (SELECT *, (CASE WHEN total <= 512 OR n <= 1 THEN 0 ELSE sum(CASE WHEN similarity < 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY record) END)::INT AS topic_id FROM tot),
seg AS (SELECT conv_id, topic_id, min(record) AS start_record, max(record) AS end_record, sum(n_messages)::BIGINT AS n_messages, sum(tokens)::BIGINT AS token_count, count(*) OVER (PARTITION BY conv_id) > 1 AS segmented FROM cut GROUP BY conv_id, topic_id)"""
ENT = r"""ent AS (SELECT conv_id, topic_id, index, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS speaker, replace(content, chr(10), '\n') AS content FROM (
  SELECT m.conv_id, topic_id, role, content, row_number() OVER (PARTITION BY m.conv_id, topic_id ORDER BY seq) - 1 AS index
  FROM msg m JOIN seg s ON m.conv_id = s.conv_id AND m.seq // 2 BETWEEN start_record AND end_record))"""


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _text(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as text, which both engines write alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


# --- recall ---------------------------------------------------------------

BM25 = f"""dt AS (SELECT user_id, memory_id, unnest({TERMS.format("memory_content")}) AS term FROM mem WHERE status = 'active'),
tf AS (SELECT user_id, memory_id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT user_id, memory_id, count(*) AS length FROM dt GROUP BY ALL),
df AS (SELECT user_id, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT user_id, count(*) AS n_docs, avg(length) AS avgdl FROM dl GROUP BY ALL),
qt AS (SELECT query_id, user_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, 'u' || (item_id % 10) AS user_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, qt.user_id, tf.memory_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS bm25_score
  FROM qt JOIN tf USING (user_id, term) JOIN df USING (user_id, term) JOIN dl ON dl.user_id = qt.user_id AND dl.memory_id = tf.memory_id JOIN st ON st.user_id = qt.user_id GROUP BY ALL)"""


@query("bm25_topk", f"WITH {MEM}, {BM25} SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, memory_id))::INT AS bm25_rank FROM bm QUALIFY bm25_rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_topk(S.memories(spark, d).where("status = 'active'"), S.queries(spark, d), 20)


@query("bm25_stats", f"WITH {MEM}, {BM25} SELECT user_id, n_docs, round(avgdl, 6) AS avgdl, count(*) AS n_terms, max(df) AS max_df FROM st JOIN df USING (user_id) GROUP BY ALL")
def bm25_stats(spark, d):
    _, stats = search.bm25_index(S.memories(spark, d).where("status = 'active'"))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


@query("sparse_topk", f"""WITH {MEM}, {BM25}, sc AS (SELECT query_id, user_id, memory_id, round(sum(qtf::DOUBLE * tf), 6) AS sparse_score FROM qt JOIN tf USING (user_id, term) GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, memory_id))::INT AS sparse_rank FROM sc QUALIFY sparse_rank <= 10""")
def sparse_topk(spark, d):
    asked = search.term_frequencies(S.queries(spark, d), ["query_id", "user_id"], "text")
    items = search.term_frequencies(S.memories(spark, d).where("status = 'active'"), ["user_id", "memory_id"], "memory_content", asked)
    return search.sparse_topk(items.withColumn("w", F.col("tf").cast("double")), asked.withColumn("qw", F.col("tf").cast("double")).drop("tf"))


@query("dense_topk", """SELECT q.vec_id AS query_id, q.label AS user_id, e.vec_id AS memory_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS dense_score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) DESC, e.vec_id))::INT AS dense_rank
FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 QUALIFY dense_rank <= 10""")
def dense_topk(spark, d):
    v = S.vectors(spark, d)
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.col("dense").alias("qdense"))
    return search.dense_topk(v, q)


@query("euclid_topk", """SELECT q.vec_id AS query_id, q.label AS user_id, e.vec_id AS memory_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS dense_score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4), e.vec_id))::INT AS dense_rank
FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 QUALIFY dense_rank <= 10""")
def euclid_topk(spark, d):
    v = S.vectors(spark, d).withColumn("dense", F.col("dense").cast("array<double>"))
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.col("dense").alias("qdense"))
    return search.dense_topk(v, q, distance="euclid")


@query("embed_pairs", f"""WITH t AS (SELECT doc_id, unnest({TERMS.format("text")}) AS t FROM documents), h AS (SELECT doc_id, md5(t) AS h FROM t),
d AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS d, count(*)::DOUBLE AS w FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY doc_id),
s AS (SELECT doc_id, ('0x' || substr(h, 1, 7))::BIGINT AS k, count(*)::DOUBLE AS w FROM h GROUP BY ALL),
ds AS (SELECT a.doc_id AS query_id, sum(a.w * b.w) AS s FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 AND b.d = a.d GROUP BY ALL), ls AS (SELECT a.doc_id AS query_id, sum(a.w * b.w) AS s FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND b.k = a.k GROUP BY ALL)
SELECT a.doc_id AS query_id, b.doc_id, round(coalesce(ds.s / (x.n * y.n), 0), 6) AS dense_score, coalesce(ls.s, 0)::DOUBLE AS lexical_score FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
LEFT JOIN n x ON x.doc_id = a.doc_id LEFT JOIN n y ON y.doc_id = b.doc_id LEFT JOIN ds ON ds.query_id = a.doc_id LEFT JOIN ls ON ls.query_id = a.doc_id""")
def embed_pairs(spark, d):
    """Each document against the next one, dense and sparse from one pass of the model over each text."""
    e = checkpoint(embed.embedded(S.table(spark, d, "documents").select("doc_id", "text"), "text").drop("text"))
    q = e.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 1).alias("doc_id"), F.col("dense").alias("qdense"), F.col("sparse").alias("qsparse"))
    return embed.pair_scores(q.join(e, "doc_id"))


PAIRS = """pr AS (SELECT a.label AS user_id, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("similar_pairs", f"WITH {PAIRS} SELECT user_id, a, b, round(cosine, 6) AS cosine FROM pr WHERE cosine >= 0.3")
def similar_pairs(spark, d):
    return search.similar_pairs(S.vectors(spark, d), ["user_id"], "memory_id", "dense", 0.3).withColumn("cosine", F.round("cosine", 6))


@query("clusters", f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pr WHERE cosine >= 0.3 UNION SELECT b, a FROM pr WHERE cosine >= 0.3),
reach AS (SELECT a AS id, a AS q FROM e UNION SELECT id, b FROM reach JOIN e ON q = a) SELECT id AS memory_id, min(q) AS component FROM reach GROUP BY id""")
def clusters(spark, d):
    return merge.clusters(S.vectors(spark, d), ["user_id"], "memory_id", "dense", 0.3)


# --- ranking --------------------------------------------------------------

LISTS = """l0 AS (SELECT lang AS query_id, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
l1 AS (SELECT lang AS query_id, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
l2 AS (SELECT lang AS query_id, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS rank FROM documents),
ls AS (SELECT *, 0 AS list, 1.0::DOUBLE AS w FROM l0 WHERE rank <= 200 UNION ALL SELECT *, 1, 0.8::DOUBLE FROM l1 WHERE rank <= 200 UNION ALL SELECT *, 2, 0.7::DOUBLE FROM l2 WHERE rank <= 200),
fu AS (SELECT query_id, key, round(sum(w / (60 + rank)), 9) AS rrf_score, min({'r': rank, 'l': list}) AS best, list_sort(list(list)) AS sources FROM ls GROUP BY ALL),
rr AS (SELECT query_id, key, rrf_score, best.r AS best_rank, best.l AS best_list, sources, (row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best.r, best.l, key))::INT AS rrf_rank FROM fu QUALIFY rrf_rank <= 100)"""


def _fused(spark, d) -> DataFrame:
    """Three orders of each language's documents, of which fusion takes the first 200, as a recall of bounded size would give them."""
    docs = S.table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("key"), "n_chars", "text")
    lists = []
    for order in ([F.desc("n_chars"), "key"], ["key"], [F.md5(F.col("text").cast("binary")), "key"]):
        lists.append(docs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where("rank <= 200"))
    return ranking.rrf(lists, 100, weights=[1.0, 0.8, 0.7])


@query("rrf_fusion", f"WITH {LISTS} SELECT query_id, key, rrf_score, best_rank::INT AS best_rank, best_list::INT AS best_list, array_to_string(sources, ',') AS sources, rrf_rank FROM rr")
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


FINAL = f"""WITH {MEM}, {LISTS}, fs AS (SELECT query_id, key, round(rrf_score * exp(-greatest(0, epoch_us(TIMESTAMP '2024-02-15') - epoch_us(created_at)) / 86400000000.0 / 30) * (0.6 + 0.4 * importance) * (0.5 + 0.5 * confidence), 9) AS final_score
  FROM rr JOIN mem ON doc_id = key)"""


@query("final_score", f"{FINAL} SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, key))::INT AS rank FROM fs QUALIFY rank <= 30")
def final_score(spark, d):
    joined = _fused(spark, d).join(S.memories(spark, d).withColumnRenamed("doc_id", "key"), "key")
    scored = ranking.final_score(joined, F.lit("2024-02-15 00:00:00"))
    return search.top_k(scored.select("query_id", "key", "final_score"), ["query_id"], "final_score", "key", 30)


@query("fallback_rerank", """SELECT lang AS query_id, doc_id AS key, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 4)::DOUBLE WHEN n_chars % 5 <> 0 THEN (n_chars % 5)::DOUBLE ELSE 0::DOUBLE END AS bge_score,
  (row_number() OVER (PARTITION BY lang ORDER BY bge_score DESC, doc_id))::INT AS bge_rank FROM documents QUALIFY bge_rank <= 10""")
def fallback_rerank(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("key"), (F.col("doc_id") % 4).cast("double").alias("dense_score"), (F.col("n_chars") % 5).cast("double").alias("score"))
    return ranking.fallback_rerank(docs, 10).select("query_id", "key", "bge_score", "bge_rank")


@query("llm_rerank", """WITH c AS (SELECT user_id AS query_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS idx FROM events QUALIFY idx < 40),
r AS (SELECT query_id, (event_id * 7 % 45)::INT AS idx, min({'p': event_id % 10 * 1000 + idx, 's': (event_id % 7)::DOUBLE / 5}) AS x FROM c WHERE event_id * 7 % 45 < 40 GROUP BY ALL)
SELECT c.query_id, c.idx, greatest(0, least(1, coalesce(x.s, 0)))::DOUBLE AS llm_score, (row_number() OVER (PARTITION BY c.query_id ORDER BY x.p NULLS LAST, c.idx))::INT AS llm_rank FROM c LEFT JOIN r USING (query_id, idx) QUALIFY llm_rank <= 15""")
def llm_rerank(spark, d):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    c = S.table(spark, d, "events").select(F.col("user_id").alias("query_id"), "event_id", n.alias("idx")).where("idx < 40")
    r = c.select("query_id", (F.col("event_id") % 10 * 1000 + F.col("idx")).alias("pos"), (F.col("event_id") * 7 % 45).cast("int").alias("idx"), ((F.col("event_id") % 7) / 5.0).alias("llm_score"))
    return ranking.llm_rerank(c.drop("event_id"), r, 15)


@query("ordered_distinct_contents", """SELECT lang AS query_id, text AS content, (row_number() OVER (PARTITION BY lang ORDER BY min(doc_id), text))::INT AS position FROM documents GROUP BY lang, text""")
def ordered_distinct_contents(spark, d):
    return ranking.distinct_contents(S.table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("text").alias("content"), F.col("doc_id").alias("rank")))


def _pool(spark, d) -> DataFrame:
    v = S.vectors(spark, d)
    q = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.col("dense").alias("qdense"))
    best = search.dense_topk(v, q, 30)
    return best.join(v.select("memory_id", "dense"), "memory_id").join(q.select("query_id", "qdense"), "query_id").select("query_id", F.col("memory_id").alias("key"), F.col("dense_rank").alias("position"), "dense", "qdense", F.col("dense_score").alias("initial"))


# A pool of 30 a query, each candidate's cosine to the query and to the others; then k rounds that pick one each.
POOL = """d AS (SELECT q.vec_id AS query_id, e.vec_id AS key, e.embedding::DOUBLE[] AS v, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0),
p AS MATERIALIZED (SELECT query_id, key, v, round(c, 9) AS rel, round(c, 4) AS initial, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 4) DESC, key) AS position FROM d QUALIFY position <= 30),
s AS MATERIALIZED (SELECT a.query_id, a.key AS a, b.key AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM p a JOIN p b USING (query_id))"""


def mmr_sql(pool: str, k: int, lam: float) -> str:
    """Rounds k1, k2, ... over pool (query_id, key, position, rel) and s (query_id, a, b, s); the last one has all picks (query_id, key, n, rel, score)."""
    out = ["k0 AS (SELECT query_id, key, 0 AS n, rel, rel AS score FROM " + pool + " WHERE false)"]
    for n in range(1, k + 1):
        out.append(f"""w{n} AS (SELECT p.query_id, p.key, p.position, p.rel, {lam!r}::DOUBLE * p.rel - {1 - lam!r}::DOUBLE * coalesce(max(s.s), 0) AS score FROM {pool} p LEFT JOIN k{n - 1} k ON k.query_id = p.query_id
  LEFT JOIN s ON s.query_id = p.query_id AND s.a = p.key AND s.b = k.key GROUP BY p.query_id, p.key, p.position, p.rel HAVING count(*) FILTER (WHERE k.key = p.key) = 0),
k{n} AS MATERIALIZED (SELECT * FROM k{n - 1} UNION ALL SELECT query_id, key, {n}, rel, score FROM (SELECT * FROM w{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, key) = 1))""")
    return ", ".join(out)


@query("mmr_topk", f"WITH {POOL}, f AS (SELECT * FROM p WHERE rel >= 0), {mmr_sql('f', 10, 0.5)} SELECT query_id, key, n::INT AS mmr_rank, round(rel, 6) AS relevance_score, round(score, 6) AS mmr_score FROM k10")
def mmr_topk(spark, d):
    return ranking.mmr(_pool(spark, d).drop("initial"), 10, 0.5)


@query("mmr_rerank", f"""WITH {POOL}, m AS (SELECT *, min(initial) OVER (PARTITION BY query_id) AS lo, max(initial) OVER (PARTITION BY query_id) AS hi FROM p),
f AS (SELECT query_id, key, position, round(0.5::DOUBLE * CASE WHEN hi > lo THEN (initial - lo) / (hi - lo) ELSE 1 END + 0.5::DOUBLE * rel, 9) AS rel FROM m), {mmr_sql('f', 10, 0.7)}
SELECT query_id, key, n::INT AS mmr_rank, round(rel, 6) AS relevance_score, round(score, 6) AS mmr_score FROM k10""")
def mmr_rerank(spark, d):
    return ranking.mmr(_pool(spark, d), 10, 0.7, initial="initial", weight=0.5)


@query("diversity_topk", f"""WITH RECURSIVE {POOL}, o AS (SELECT query_id, key, round(rel, 6) AS rel, row_number() OVER (PARTITION BY query_id ORDER BY round(rel, 6) DESC, position, key) AS i FROM p),
l AS (SELECT o.query_id, o.key, o.rel, o.i, list(s.s ORDER BY x.i) AS near FROM o JOIN s ON s.query_id = o.query_id AND s.a = o.key JOIN o x ON x.query_id = o.query_id AND x.key = s.b GROUP BY ALL),
t AS (SELECT DISTINCT query_id, 0::BIGINT AS i, []::BIGINT[] AS taken FROM o UNION ALL SELECT t.query_id, l.i, CASE WHEN len(taken) < 10 AND coalesce(list_max(list_transform(taken, lambda j: near[j])), -2) < 0.8 THEN list_append(taken, l.i) ELSE taken END
  FROM t JOIN l ON l.query_id = t.query_id AND l.i = t.i + 1),
e AS (SELECT query_id, unnest(taken) AS i, unnest(range(1, len(taken) + 1)) AS n FROM (SELECT query_id, max_by(taken, i) AS taken FROM t GROUP BY query_id))
SELECT query_id, key, rel AS relevance_score, n::INT AS diverse_rank FROM e JOIN o USING (query_id, i)""")
def diversity_topk(spark, d):
    return ranking.diverse(_pool(spark, d), 10, 0.8)


@query("time_decay", "SELECT event_id, round(exp(-greatest(0, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0 / 30), 9) AS decay FROM events")
def time_decay(spark, d):
    return S.table(spark, d, "events").select("event_id", F.round(D.time_decay(F.col("ts"), F.lit("2024-01-20 00:00:00")), 9).alias("decay"))


@query("hybrid_retrieve", retrieve.sql(MEM, BM25, TERMS, 10) + " SELECT query_id, memory_id, final_score, position::INT AS rank FROM ranked")
def hybrid_retrieve(spark, d):
    memories = S.memories(spark, d)
    embedded = embed.embedded(memories.where("status = 'active'").select("memory_id", "memory_content"), "memory_content", sparse=False)
    hits = retrieve.retrieve(memories, embedded, S.queries(spark, d), now="2024-06-01 00:00:00", k=10, use_mmr=False)
    return hits.select("query_id", "memory_id", "final_score", "rank")


@query("hybrid_retrieve_mmr", f"""{retrieve.sql(MEM, BM25, TERMS, 30)}, f AS (SELECT re.query_id, re.memory_id AS key, final_score, re.position, round(coalesce(pr.s, 0), 9) AS rel FROM ranked re LEFT JOIN pr USING (query_id, memory_id) WHERE round(coalesce(pr.s, 0), 9) >= 0),
s AS MATERIALIZED (SELECT a.query_id, a.key AS a, b.key AS b, round(coalesce(sum(x.u * y.u), 0), 9) AS s FROM f a JOIN f b USING (query_id) LEFT JOIN mv x ON x.memory_id = a.key LEFT JOIN mv y ON y.memory_id = b.key AND y.d = x.d GROUP BY ALL), {mmr_sql('f', 10, 0.5)}
SELECT k.query_id, k.key AS memory_id, final_score, k.n::INT AS rank FROM k10 k JOIN f ON f.query_id = k.query_id AND f.key = k.key""")
def hybrid_retrieve_mmr(spark, d):
    memories = S.memories(spark, d)
    embedded = embed.embedded(memories.where("status = 'active'").select("memory_id", "memory_content"), "memory_content", sparse=False)
    hits = retrieve.retrieve(memories, embedded, S.queries(spark, d), now="2024-06-01 00:00:00", k=10)
    return hits.select("query_id", "memory_id", "final_score", "rank")


# --- dialogue -------------------------------------------------------------


@query("token_count", f"SELECT conv_id, turn, {COUNT.format('text')}::INT AS tokens FROM conversations")
def token_count(spark, d):
    return S.messages(spark, d).select("conv_id", "turn", T.token_count(F.col("content")).alias("tokens"))


@query("validate_history", f"WITH {MSG} SELECT conv_id, turn, role, content, seq::INT AS seq FROM msg")
def validate_history(spark, d):
    return dialogue.valid_messages(S.messages(spark, d))


@query("turn_records", f"WITH {MSG}, {REC} SELECT conv_id, record::INT AS record, text, n_messages::INT AS n_messages, tokens::BIGINT AS tokens FROM rec")
def turn_records(spark, d):
    return dialogue.turn_records(dialogue.valid_messages(S.messages(spark, d)))


@query("adjacent_similarity", f"WITH {MSG}, {REC}, {SEG} SELECT conv_id, record::INT AS record, round(similarity, 6) AS similarity FROM sim")
def adjacent_similarity(spark, d):
    records = dialogue.turn_records(dialogue.valid_messages(S.messages(spark, d)))
    return dialogue.adjacent_similarity(records).select("conv_id", "record", F.round("similarity", 6).alias("similarity"))


def _segments(spark, d):
    valid = dialogue.valid_messages(S.messages(spark, d))
    return valid, dialogue.topic_segments(dialogue.turn_records(valid))


@query("topic_segments", f"WITH {MSG}, {REC}, {SEG} SELECT conv_id, topic_id, start_record::INT AS start_record, end_record::INT AS end_record, n_messages, token_count, segmented FROM seg")
def topic_segments(spark, d):
    return _segments(spark, d)[1]


@query("topic_entries", f"WITH {MSG}, {REC}, {SEG}, {ENT} SELECT conv_id, topic_id, index::INT AS index, speaker, content FROM ent")
def topic_entries(spark, d):
    return dialogue.topic_entries(*_segments(spark, d))


@query("topic_text", f"WITH {MSG}, {REC}, {SEG}, {ENT} SELECT conv_id, topic_id, string_agg('[' || index || '] speaker:' || speaker || ',content:' || content, chr(10) ORDER BY index) AS topic_text FROM ent GROUP BY ALL")
def topic_text(spark, d):
    return dialogue.topic_texts(dialogue.topic_entries(*_segments(spark, d)))


@query("dry_run_extract", extract.dry_run_sql(MSG))
def dry_run_extract(spark, d):
    return extract.dry_run(dialogue.valid_messages(S.messages(spark, d)))


@query("chat_prompt", f"""WITH {MSG}, h AS (SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS history FROM msg GROUP BY conv_id),
u AS (SELECT conv_id, max_by(content, seq) AS said FROM msg WHERE role = 'user' GROUP BY conv_id),
m AS (SELECT doc_id // 10 AS conv_id, string_agg('- ' || text, chr(10) ORDER BY doc_id) AS block FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) <= 5) GROUP BY ALL)
SELECT conv_id, history, said || coalesce(chr(10) || chr(10) || '[memories]' || chr(10) || block, '') AS prompt FROM h JOIN u USING (conv_id) LEFT JOIN m USING (conv_id)""")
def chat_prompt(spark, d):
    docs = S.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("conv_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    top = F.row_number().over(W.partitionBy("conv_id").orderBy("position"))
    docs = docs.withColumn("rank", top).where("rank <= 5").drop("rank")  # C12: a prompt has the first five memories
    return extract.chat_prompts(dialogue.valid_messages(S.messages(spark, d)), docs)


# Spellings of both speakers, spaced and cased, between names that are neither.
SPOKEN = ["Speaker A", "a", " MALE ", "boy", "Boy_Friend", "user", "speaker_b", "B", "Female", "g i r l", "girlfriend", " AI", "assistant", "robot", ""]
_IN = lambda names: "plain IN (" + ", ".join(f"'{n}'" for n in names) + ")"


@query("speaker_normalize", f"""WITH s AS (SELECT conv_id, turn, {SPOKEN!r}[(conv_id + turn) % {len(SPOKEN)} + 1] AS said FROM conversations),
p AS (SELECT *, replace(replace(lower(trim(said)), ' ', ''), '_', '') AS plain FROM s)
SELECT conv_id, turn, CASE WHEN {_IN(T.FIRST_SPEAKER)} THEN 'Lin' WHEN {_IN(T.SECOND_SPEAKER)} THEN 'Chen' ELSE said END AS speaker, {_IN(T.FIRST_SPEAKER + T.SECOND_SPEAKER)} AS fixed FROM p""")
def speaker_normalize(spark, d):
    """F27."""
    said = F.get(F.array(*[F.lit(x) for x in SPOKEN]), ((F.col("conv_id") + F.col("turn")) % len(SPOKEN)).cast("int"))
    s = T.speaker(said, F.lit("Lin"), F.lit("Chen"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", s["speaker"].alias("speaker"), s["fixed"].alias("fixed"))


@query("speaker_fix_counts", f"""WITH s AS (SELECT conv_id, {SPOKEN!r}[(conv_id + turn) % {len(SPOKEN)} + 1] AS said FROM conversations), p AS (SELECT *, replace(replace(lower(trim(said)), ' ', ''), '_', '') AS plain FROM s)
SELECT conv_id, count(*) FILTER ({_IN(T.FIRST_SPEAKER + T.SECOND_SPEAKER)}) AS fixed, count(*) AS total FROM p GROUP BY conv_id""")
def speaker_fix_counts(spark, d):
    """A16."""
    return speaker_normalize(spark, d).groupBy("conv_id").agg(F.count_if("fixed").alias("fixed"), F.count("*").alias("total"))


@query("speaker_repair", """WITH t AS (SELECT conv_id AS session, turn AS n, CASE role WHEN 'user' THEN 'a' WHEN 'assistant' THEN 'b' END AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
k AS (SELECT *, max(CASE WHEN speaker IS NOT NULL THEN p END) OVER (PARTITION BY session ORDER BY n) AS la FROM t),
j AS (SELECT k.*, l.speaker AS ls FROM k LEFT JOIN t l ON l.session = k.session AND l.p = k.la)
SELECT session, n, CASE WHEN (p - coalesce(la, 0)) % 2 = 0 THEN coalesce(ls, 'b') WHEN coalesce(ls, 'b') = 'a' THEN 'b' ELSE 'a' END AS speaker, speaker IS NULL AS fixed, 'D' || session || ':' || p AS dia_id FROM j""")
def speaker_repair(spark, d):
    role = F.when(F.col("role") == "user", "a").when(F.col("role") == "assistant", "b")
    return dialogue.repair_speakers(S.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), role.alias("speaker")))


# --- store ----------------------------------------------------------------


@query("list_user_memories", f"""WITH {MEM} SELECT user_id, memory_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, (row_number() OVER (PARTITION BY user_id ORDER BY mem.created_at DESC, memory_id))::INT AS position
FROM mem WHERE status = 'active' AND memory_type = 'profile' QUALIFY position <= 20""")
def list_user_memories(spark, d):
    return _text(store.list_user_memories(S.memories(spark, d), 20, memory_type="profile").select("user_id", "memory_id", "created_at", "position"), "created_at")


@query("filter_memories", f"WITH {MEM} SELECT memory_id, user_id FROM mem WHERE user_id = 'u3' AND status = 'active' AND memory_type = 'profile' AND memory_category = 'en'")
def filter_memories(spark, d):
    return S.memories(spark, d).where(search.build_filter(user_id="u3", memory_type="profile", memory_category="en")).select("memory_id", "user_id")


@query("count_filtered", f"WITH {MEM} SELECT user_id, count(*) AS n FROM mem WHERE status = 'active' GROUP BY user_id")
def count_filtered(spark, d):
    return S.memories(spark, d).where(search.build_filter()).groupBy("user_id").agg(F.count("*").alias("n"))


@query("scroll_pages", f"WITH {MEM} SELECT memory_id, position, position // 256 AS page FROM (SELECT memory_id, row_number() OVER (ORDER BY memory_id) - 1 AS position FROM mem WHERE status = 'active')")
def scroll_pages(spark, d):
    """All active memories in pages of 256."""
    return scroll.pages(S.memories(spark, d).where(search.build_filter()).select("memory_id"), "memory_id")


@query("get_by_ids", f"WITH {MEM} SELECT memory_id, user_id, importance FROM mem WHERE memory_id IN (SELECT 'm' || item_id * 3 FROM benchmark)")
def get_by_ids(spark, d):
    ids = S.table(spark, d, "benchmark").select(F.concat(F.lit("m"), F.col("item_id") * 3).alias("memory_id"))
    return store.get_by_ids(S.memories(spark, d), ids).select("memory_id", "user_id", "importance")


def _new(spark, d):
    m = S.memories(spark, d)
    new = m.where("doc_id % 5 = 0").withColumns({"memory_content": F.concat(F.lit("new "), "memory_content"), "importance": F.lit(0.95), "created_at": F.current_timestamp()})
    extra = m.where("doc_id % 5 = 1").withColumns({"memory_id": F.concat(F.lit("n"), F.col("doc_id")), "memory_content": F.lit("added")})
    cols = ["memory_id", "user_id", "memory_content", "importance", "created_at"]
    return m.select(cols), new.select(cols).unionByName(extra.select(cols))


@query("upsert_memories", f"""WITH {MEM} SELECT memory_id, user_id, CASE WHEN doc_id % 5 = 0 THEN 'new ' || memory_content ELSE memory_content END AS memory_content,
  CASE WHEN doc_id % 5 = 0 THEN 0.95::DOUBLE ELSE importance END AS importance, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM mem
UNION ALL SELECT 'n' || doc_id, user_id, 'added', importance, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM mem WHERE doc_id % 5 = 1""")
def upsert_memories(spark, d):
    old, new = _new(spark, d)
    return _text(store.upsert(old, new, "memory_id", keep=("created_at", "user_id")), "created_at")


@query("update_status", f"WITH {MEM} SELECT memory_id, CASE WHEN doc_id % 7 = 0 THEN 'archived' ELSE status END AS status FROM mem")
def update_status(spark, d):
    m = S.memories(spark, d)
    return store.update_status(m, m.where("doc_id % 7 = 0"), "archived").select("memory_id", "status")


@query("bump_retrieval", """SELECT 'm' || d.doc_id AS memory_id, coalesce(n, 0)::BIGINT AS retrieval_count, strftime(a, '%Y-%m-%d %H:%M:%S') AS last_retrieved_at FROM documents d LEFT JOIN
  (SELECT event_id // 10 AS doc_id, count(DISTINCT user_id) AS n, max(ts) AS a FROM events GROUP BY 1) USING (doc_id)""")
def bump_retrieval(spark, d):
    hits = S.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.concat(F.lit("m"), F.floor(F.col("event_id") / 10)).alias("memory_id"), F.col("ts").alias("at"))
    old = S.memories(spark, d).select("memory_id", F.lit(0).cast("long").alias("retrieval_count"), F.lit(None).cast(dict(hits.dtypes)["at"]).alias("last_retrieved_at"))
    return _text(store.bump_retrieval(old, hits), "last_retrieved_at")


@query("store_merge_on_read", f"""WITH {MEM}, h AS (SELECT doc_id, sum(n)::INT AS n, max(a) AS a FROM (SELECT event_id // 10 AS doc_id, event_id % 2 AS half, count(DISTINCT user_id) AS n, max(ts) AS a FROM events GROUP BY ALL) GROUP BY doc_id)
SELECT memory_id, user_id, md5(CASE WHEN doc_id % 5 = 0 THEN 'new ' || memory_content ELSE memory_content END) AS content_md5, CASE WHEN doc_id % 5 = 0 THEN 0.95::DOUBLE ELSE importance END AS importance,
  CASE WHEN doc_id % 7 = 0 THEN 'archived' ELSE status END AS status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(n, 0)::INT AS retrieval_count, strftime(a, '%Y-%m-%d %H:%M:%S') AS last_retrieved_at
FROM mem LEFT JOIN h USING (doc_id) WHERE doc_id % 9 <> 0
UNION ALL SELECT 'n' || doc_id, user_id, md5('added'), importance, status, strftime(created_at, '%Y-%m-%d %H:%M:%S'), 0, NULL FROM mem WHERE doc_id % 5 = 1""")
def store_merge_on_read(spark, d):
    """Upserts, patches, bumps and deletes as deltas over a base, half of them compacted."""
    cols = ["memory_id", "user_id", "memory_content", "importance", "status", "created_at"]
    counters = {"retrieval_count": F.lit(0), "last_retrieved_at": F.lit(None).cast("timestamp")}
    memories = S.memories(spark, d).withColumns(counters)
    new = memories.where("doc_id % 5 = 0").withColumns({"memory_content": F.concat(F.lit("new "), "memory_content"), "importance": F.lit(0.95), "created_at": F.lit("2030-01-01").cast("timestamp"), "user_id": F.lit("nobody")})
    extra = memories.where("doc_id % 5 = 1").withColumns({"memory_id": F.concat(F.lit("n"), F.col("doc_id")), "memory_content": F.lit("added")})
    events = S.table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("m"), F.floor(F.col("event_id") / 10)).alias("memory_id"), F.col("ts").cast("timestamp").alias("at"))
    hits = lambda half: events.where(F.col("event_id") % 2 == half).groupBy("memory_id", "user_id").agg(F.max("at").alias("last_retrieved_at")).select("memory_id", F.lit(1).alias("retrieval_count"), "last_retrieved_at")
    s = log.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    s.replace({"memories": (memories.select(*cols, *counters), "memory_id", ("created_at", "user_id"))})
    s.append(log.Delta("memories", "upsert", new.unionByName(extra).select(*cols, *counters)), log.Delta("memories", "bump", hits(0)))
    s.compact("memories")
    s.append(log.Delta("memories", "patch", memories.where("doc_id % 7 = 0").select("memory_id", F.lit("archived").alias("status"))))
    s.append(log.Delta("memories", "bump", hits(1)), log.Delta("memories", "delete", memories.where("doc_id % 9 = 0").select("memory_id")))
    got = s.read("memories").withColumn("content_md5", F.md5(F.col("memory_content").cast("binary"))).drop("memory_content")
    return _text(got, "created_at", "last_retrieved_at")


@query("delete_memory", f"WITH {MEM} SELECT memory_id FROM mem WHERE doc_id % 9 <> 0")
def delete_memory(spark, d):
    m = S.memories(spark, d)
    return store.delete(m, m.where("doc_id % 9 = 0")).select("memory_id")


@query("list_user_ids", f"WITH {MEM} SELECT DISTINCT user_id FROM mem")
def list_user_ids(spark, d):
    return S.memories(spark, d).select("user_id").distinct()


TOP = """top AS (SELECT 't' || conv_id AS topic_id, conv_id FROM conversations GROUP BY conv_id)"""


@query("provenance", f"""WITH {TOP}, l AS (SELECT 'm' || doc_id AS memory_id, 0 AS i, 't' || doc_id // 10 AS topic_id FROM documents UNION ALL SELECT 'm' || doc_id, 1, 't' || doc_id // 7 FROM documents),
c AS (SELECT memory_id, i, 0 AS j, 'c' || conv_id % 4 AS cid FROM l JOIN top USING (topic_id) UNION ALL SELECT memory_id, i, 1, 'c' || conv_id FROM l JOIN top USING (topic_id)),
f AS (SELECT memory_id, cid, min(i * 2 + j) AS p FROM c GROUP BY ALL) SELECT memory_id, string_agg(cid, ',' ORDER BY p, cid) AS conversation_ids FROM f GROUP BY memory_id""")
def provenance(spark, d):
    return store.provenance(S.memories(spark, d), S.topics(spark, d)).withColumn("conversation_ids", F.array_join("conversation_ids", ","))


@query("cite_resolution", """WITH c AS (SELECT 'm' || doc_id AS memory_id, 't' || doc_id // 10 AS topic_id, doc_id // 10 AS conv_id, 0 AS position, doc_id % 5 AS index FROM documents
  UNION ALL SELECT 'm' || doc_id, 't' || doc_id // 10, doc_id // 10, 1, doc_id % 3 FROM documents)
SELECT memory_id, topic_id, position::INT AS position, index::INT AS index, text AS content FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.index""")
def cite_resolution(spark, d):
    return store.cited_messages(S.memories(spark, d), S.topics(spark, d))


def _members(spark, d):
    return S.memories(spark, d).withColumn("cluster", F.floor(F.col("doc_id") / 20)).withColumn("position", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("created_at"), "memory_id")))


@query("merge_provenance", """WITH ps AS (SELECT doc_id // 20 AS cluster, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id DESC) AS position FROM documents),
l AS (SELECT cluster, position * 2 AS p, 't' || doc_id // 10 AS t FROM ps UNION ALL SELECT cluster, position * 2 + 1, 't' || doc_id // 7 FROM ps),
f AS (SELECT cluster, t, min(p) AS p FROM l GROUP BY ALL), x AS (SELECT cluster, string_agg(t, ',' ORDER BY p) AS topic_ids FROM f GROUP BY cluster),
c AS (SELECT DISTINCT doc_id // 20 AS cluster, 't' || doc_id // 10 AS t, unnest([doc_id % 5, doc_id % 3]) AS i FROM documents),
y AS (SELECT cluster, t || ':' || string_agg(i, '+' ORDER BY i) AS s FROM c GROUP BY cluster, t), z AS (SELECT cluster, string_agg(s, ',' ORDER BY s) AS cites FROM y GROUP BY cluster)
SELECT cluster, topic_ids, cites FROM x JOIN z USING (cluster)""")
def merge_provenance(spark, d):
    m = _members(spark, d)
    cites = F.array_sort(F.transform(F.map_entries("cites"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda i: i.cast("string")), "+"))))
    return merge.merged_topics(m).join(merge.merged_cites(m), "cluster").select("cluster", F.array_join("topic_ids", ",").alias("topic_ids"), F.array_join(cites, ",").alias("cites"))


@query("merge_scores", f"""WITH {MEM}, a AS (SELECT doc_id // 20 AS cluster, max(importance) AS most, avg(confidence) AS mean, count(*) AS merged_count FROM mem GROUP BY 1),
g AS (SELECT *, CASE WHEN cluster % 3 = 0 THEN 0::DOUBLE WHEN cluster % 3 = 1 THEN 1.7 END AS li, CASE WHEN cluster % 2 = 0 THEN 0.4::DOUBLE END AS lc FROM a)
SELECT cluster, round(greatest(0, least(1, CASE WHEN li <> 0 THEN li ELSE most END)), 9)::DOUBLE AS importance, round(greatest(0, least(1, CASE WHEN lc <> 0 THEN lc ELSE mean END)), 9)::DOUBLE AS confidence, merged_count FROM g""")
def merge_scores(spark, d):
    m = _members(spark, d)
    c = F.col("cluster")
    decisions = m.select("cluster").distinct().select("cluster", F.when(c % 3 == 0, 0.0).when(c % 3 == 1, 1.7).alias("llm_importance"), F.when(c % 2 == 0, 0.4).alias("llm_confidence"))
    return merge.merged_scores(m, decisions)


# A running sum of tokens per group; the first row is always in.
_BUDGET = "SELECT *, sum({tokens}) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS place FROM {rows}"


@query("merge_prompts", f"""WITH {MEM}, r AS (SELECT *, doc_id // 20 AS cluster FROM mem), b AS ({_BUDGET.format(tokens=COUNT.format('memory_content'), by='cluster', order='created_at DESC, memory_id', rows='r')})
SELECT cluster, count(*)::INT AS n, md5('[' || string_agg(memory_id || ':' || memory_content, '|' ORDER BY place) || ']') AS payload_md5 FROM b WHERE total <= 2048 OR place = 0 GROUP BY cluster""")
def merge_prompts(spark, d):
    """The payload of each prompt, read back from it."""
    rows = prompts.merge_prompts(S.memories(spark, d).withColumn("cluster", F.floor(F.col("doc_id") / 20)))
    items = F.from_json(F.regexp_extract("prompt", r"(?s)\n\n(\[.*)$", 1), "array<struct<memory_id: string, memory_content: string>>")
    body = F.array_join(F.transform(items, lambda x: F.concat(x["memory_id"], F.lit(":"), x["memory_content"])), "|")
    return rows.select("cluster", "n", F.md5(F.concat(F.lit("["), body, F.lit("]")).cast("binary")).alias("payload_md5"))


@query("rerank_candidates", f"""WITH {MEM}, {BM25}, h AS (SELECT query_id, memory_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, memory_id) AS rank FROM bm QUALIFY rank <= 50),
r AS (SELECT h.query_id, h.rank, h.bm25_score, mem.memory_id, memory_type, memory_category, substr(memory_content, 1, 500) AS content FROM h JOIN mem USING (memory_id)), b AS ({_BUDGET.format(tokens=COUNT.format('content'), by='query_id', order='rank', rows='r')})
SELECT query_id, place::INT AS index, memory_id, md5(content) AS content_md5, memory_type, memory_category, bm25_score AS score FROM b WHERE place < 40 AND (total <= 1024 OR place = 0)""")
def rerank_candidates(spark, d):
    """P15."""
    m = S.memories(spark, d).where("status = 'active'")
    hits = search.bm25_topk(m, S.queries(spark, d), 50).select("query_id", "memory_id", F.col("bm25_rank").alias("rank"), F.col("bm25_score").alias("score"))
    rows = hits.join(m.drop("user_id"), "memory_id").withColumns({"updated_at": F.lit(None).cast("string"), "retrieval_count": F.lit(0)})
    got = prompts.rerank_candidates(rows, tokens=1024)
    return got.select("query_id", "index", "memory_id", F.md5(F.col("memory_content").cast("binary")).alias("content_md5"), "memory_type", "memory_category", "score")


@query("category_docs", f"""WITH {MEM} SELECT user_id, memory_type, memory_category, count(*) AS n,
  '# ' || CASE memory_type WHEN 'profile' THEN 'Profile Memory' WHEN 'episodic' THEN 'Episodic Memory' ELSE 'State Memory' END || ' / ' || memory_category || chr(10) || chr(10) || '## 摘要' || chr(10)
  || user_id || ' 在 ' || memory_type || '/' || memory_category || ' 下共有 ' || count(*) || ' 条活跃记忆。' || chr(10) || chr(10) || '## 详细记忆' || chr(10)
  || string_agg('- (' || printf('%.2f', importance) || ') ' || memory_content, chr(10) ORDER BY importance DESC, created_at DESC, memory_id) || chr(10) AS markdown
FROM mem WHERE status = 'active' GROUP BY user_id, memory_type, memory_category""")
def category_docs(spark, d):
    return store.category_docs(S.memories(spark, d))


@query("category_parts", f"""WITH {MEM}, b AS (SELECT *, '- (' || printf('%.2f', importance) || ') ' || memory_content || chr(10) AS bullet FROM mem WHERE status = 'active' AND trim(memory_content) <> ''),
s AS (SELECT *, coalesce(sum(length(bullet)) OVER (PARTITION BY user_id, memory_type, memory_category ORDER BY importance DESC, created_at DESC, memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone FROM b)
SELECT user_id, memory_type, memory_category, gone // 8192 AS part, count(*) AS n, md5(string_agg(bullet, '' ORDER BY gone)) AS body_md5 FROM s GROUP BY ALL""")
def category_parts(spark, d):
    """Documents in parts of 8192 characters."""
    rows = documents.category_parts(S.memories(spark, d), 8192)
    return rows.withColumn("body_md5", F.md5(F.col("body").cast("binary"))).drop("body")


@query("category_payload_size", f"WITH {MEM} SELECT user_id, memory_type, memory_category, least(60, count(*))::INT AS n FROM mem WHERE status = 'active' GROUP BY ALL")
def category_payload_size(spark, d):
    rows = store.category_payload(S.memories(spark, d))
    return rows.select("user_id", "memory_type", "memory_category", F.json_array_length("payload").alias("n"))


@query("object_key", f"""WITH {MEM} SELECT memory_id, 'docs/' || user_id || '/' || CASE memory_type WHEN 'profile' THEN 'Profile Memory' WHEN 'episodic' THEN 'Episodic Memory' ELSE 'State Memory' END || '/' || memory_category || '_x.md' AS key FROM mem""")
def object_key(spark, d):
    return S.memories(spark, d).select("memory_id", T.object_key("docs/", F.col("user_id"), F.col("memory_type"), F.concat("memory_category", F.lit(" / x"))).alias("key"))


@query("token_usage_rollup", """WITH u AS (SELECT event_type AS model, greatest(event_id % 100 - 10, 0) AS p, greatest(user_id, 0) AS c, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 ELSE 0 END AS t FROM events)
SELECT model, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(CASE WHEN t > 0 THEN t ELSE p + c END)::BIGINT AS total_tokens, count(*) AS n_calls FROM u GROUP BY ROLLUP (model)""")
def token_usage_rollup(spark, d):
    e = S.table(spark, d, "events")
    return store.token_usage(e.select(F.col("event_type").alias("model"), (F.col("event_id") % 100 - 10).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 1000).alias("total_tokens")))


def _log(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("ts").alias("at"))


@query("run_log_state", """SELECT user_id AS run_id, max_by(event_type, event_id) AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max_by(ts, event_id), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS n_steps FROM events GROUP BY user_id""")
def run_log_state(spark, d):
    return _text(store.run_states(_log(spark, d)), "started_at", "updated_at")


@query("run_status_counts", "SELECT status, count(*) AS n FROM (SELECT user_id, max_by(event_type, event_id) AS status FROM events GROUP BY user_id) GROUP BY status")
def run_status_counts(spark, d):
    return store.run_states(_log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("content_md5_dedup", "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_md5_dedup(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.groupBy(T.content_id(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("session_ids", f"WITH {MSG} SELECT conv_id, 'sess_' || substr(md5('u' || conv_id % 10 || '|2024-01-01|' || count(*)), 1, 20) AS session_id FROM msg GROUP BY conv_id")
def session_ids(spark, d):
    n = dialogue.valid_messages(S.messages(spark, d)).groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", T.session_id(F.concat(F.lit("u"), F.col("conv_id") % 10), F.lit("2024-01-01"), F.col("n")).alias("session_id"))


@query("timestamp_normalize", """SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS normal,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') AS wall, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS beijing FROM events""")
def timestamp_normalize(spark, d):
    ts, e = F.col("ts").cast("timestamp"), F.col("event_id")
    given = F.when(e % 3 == 0, F.date_format(ts, "yyyy/MM/dd (EEE) HH:mm")).when(e % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    return S.table(spark, d, "events").select("event_id", D.normalise_timestamp(given).alias("normal"), D.wall_clock(iso).alias("wall"), D.beijing(ts).alias("beijing"))


WRAPPED = """w AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' ' || props WHEN 1 THEN 'Sure! ' || props || ' done {"x": 1}' WHEN 2 THEN 'so:' || chr(10) || '```json' || chr(10) || props || chr(10) || '``` tail'
  WHEN 3 THEN '```' || chr(10) || 'not json' || chr(10) || '``` then ' || props WHEN 4 THEN 'a { "s": "}{", "p": ' || props || ' } b' WHEN 5 THEN 'list [1, 2, ' || event_id || '] end'
  WHEN 6 THEN 'open ' || substr(props, 1, length(props) - 1) ELSE 'bad {not json} [' || event_id || '] x' END AS t FROM events)"""


@query("json_outermost", f"""WITH {WRAPPED}, c AS (SELECT event_id, trim(t) AS t, trim(regexp_extract(t, '```(?:json)?\\s*(.*?)```', 1, 's'), chr(10)) AS f,
  regexp_extract(t, '\\{{(?:[^{{}}"]|"(?:[^"\\\\]|\\\\.)*"|\\{{[^{{}}]*\\}})*\\}}') AS o, regexp_extract(t, '\\[[^\\[\\]]*\\]') AS a FROM w)
SELECT event_id, CASE WHEN json_valid(f) THEN f WHEN json_valid(t) THEN t WHEN json_valid(o) THEN o WHEN json_valid(a) THEN a END AS found FROM c""")
def json_outermost(spark, d):
    """F16: objects of events in prose, in fences, nested, beside others, and cut short."""
    e, p, n = F.col("event_id"), F.col("props"), "\n"
    wraps = [F.concat(F.lit(" "), p), F.concat(F.lit("Sure! "), p, F.lit(' done {"x": 1}')), F.concat(F.lit(f"so:{n}```json{n}"), p, F.lit(f"{n}``` tail")), F.concat(F.lit(f"```{n}not json{n}``` then "), p), F.concat(F.lit('a { "s": "}{", "p": '), p, F.lit(" } b"))]
    wraps += [F.concat(F.lit("list [1, 2, "), e, F.lit("] end")), F.concat(F.lit("open "), F.substr(p, F.lit(1), F.length(p) - 1)), F.concat(F.lit("bad {not json} ["), e, F.lit("] x"))]
    text = F.get(F.array(*wraps), (e % 8).cast("int"))
    return S.table(spark, d, "events").select("event_id", J.outermost(text).alias("found"))


def _items(spark, d):
    i = F.col("doc_id")
    item = F.to_json(F.struct(
        F.when(i % 17 != 0, "text").otherwise(" ").alias("memory_content"),
        F.when(i % 3 == 0, "profile").when(i % 3 == 1, " Episodic ").otherwise("odd").alias("memory_type"),
        F.when(i % 5 == 0, "life_event").otherwise("fact").alias("memory_category"),
        ((i % 13) / 10.0).alias("importance"), (i % 2).alias("confidence"), F.array(i, i + 1).alias("cite"),
    ))
    return S.table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, "profile").alias("kind"), F.try_parse_json(item).alias("item"))


ITEMS = """i AS (SELECT doc_id, doc_id % 17 = 0 AS e1, doc_id % 3 = 2 AS e2, doc_id % 2 = 0 AND doc_id % 3 = 1 AS e3,
  NOT ((doc_id % 3 = 0 AND doc_id % 5 <> 0) OR (doc_id % 3 = 1 AND doc_id % 5 = 0)) AS e4, doc_id % 13 > 10 AS e5, CASE WHEN doc_id % 2 = 0 THEN 'profile' END AS kind FROM documents)"""


@query("verify_items", f"WITH {ITEMS} SELECT doc_id, e1::INT + e2::INT + e3::INT + e4::INT + e5::INT AS n_errors, NOT (e1 OR e2 OR e3 OR e4 OR e5) AS valid FROM i")
def verify_items(spark, d):
    return validate.verify_items(_items(spark, d)).select("doc_id", F.size("errors").alias("n_errors"), "valid")


@query("verify_rollup", f"""WITH {ITEMS} SELECT kind, bool_and(NOT (e1 OR e2 OR e3 OR e4 OR e5)) AS valid, count(*) AS total, count(*) FILTER (NOT (e1 OR e2 OR e3 OR e4 OR e5)) AS valid_count,
  sum(e1::INT + e2::INT + e3::INT + e4::INT + e5::INT)::BIGINT AS n_errors FROM i GROUP BY kind""")
def verify_rollup(spark, d):
    return validate.verify_rollup(validate.verify_items(_items(spark, d)), ["kind"])


# --- event time -----------------------------------------------------------


@query("sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n_messages FROM g GROUP BY user_id, s""")
def sessions(spark, d):
    return _text(incremental.sessions(S.table(spark, d, "events")), "start", "end")


@query("activity", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def activity(spark, d):
    return _text(incremental.activity(S.table(spark, d, "events")), "start")


@query("bm25_stream_stats", f"""WITH t AS (SELECT 'u' || conv_id % 10 AS user_id, conv_id, turn, unnest({TERMS.format("text")}) AS term FROM conversations),
l AS (SELECT user_id, conv_id, turn, count(*) AS length FROM t GROUP BY ALL), s AS (SELECT user_id, count(*) AS n_docs, round(avg(length), 6) AS avgdl FROM l GROUP BY user_id),
f AS (SELECT user_id, term, count(*) AS df FROM (SELECT DISTINCT * FROM t) GROUP BY ALL)
SELECT user_id, n_docs, avgdl, count(*) AS n_terms, max(df) AS max_df FROM s JOIN f USING (user_id) GROUP BY ALL""")
def bm25_stream_stats(spark, d):
    """A02, A03 by a stream over all messages, kept in a table of counts."""
    path = f"{d}/conversations.parquet"
    at = F.timestamp_seconds(F.lit(S.EPOCH) + F.col("turn"))
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/conversations.parque[t]")  # a stream's source is a folder or a pattern
    said = source.select(F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"), F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("text").alias("memory_content"), at.alias("ts"))
    top = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    kept = log.Store(spark, f"{top}/store")
    stream = bm25_state.keep(said, kept, "counts", f"{top}/checkpoint", late="3650 days")
    stream.awaitTermination()
    return bm25_state.stats(kept.read("counts")).withColumn("avgdl", F.round("avgdl", 6))


# --- scalar functions ------------------------------------------------------


@query("strip_blanks", r"SELECT doc_id, md5(regexp_replace(text, '[\t\n\x0B\f\r ]+', '', 'g')) AS stripped_md5 FROM documents")
def strip_blanks(spark, d):
    """F04."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(T.strip_blanks(F.col("text"))).alias("stripped_md5"))


@query("compress_text", r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|\n|[^\s]') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i, len(w) AS n FROM t),
e AS (SELECT doc_id, n, list(coalesce(last_end, -1) ORDER BY i) AS le FROM (SELECT *, max(CASE WHEN word IN ('.', chr(10)) THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last_end FROM p) GROUP BY doc_id, n),
c AS (SELECT doc_id, n, le, 0::BIGINT AS a, 0::BIGINT AS chunk FROM e UNION ALL SELECT doc_id, n, le, CASE WHEN le[a + 200] >= a THEN le[a + 200] + 1 ELSE a + 200 END, chunk + 1 FROM c WHERE a + 200 < n),
k AS (SELECT doc_id, chunk, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY chunk), n) AS b FROM c),
x AS (SELECT p.doc_id, k.chunk, i, word, lower(word) AS term, n FROM p JOIN k ON k.doc_id = p.doc_id AND i >= a AND i < b),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY term),
q AS (SELECT x.*, df, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY df DESC) - 1 AS r, count(*) OVER (PARTITION BY doc_id, chunk) AS m FROM x JOIN f USING (term)),
l AS (SELECT doc_id, chunk, df AS most FROM q WHERE r = floor(m * (1 - 0.5))::BIGINT),
y AS (SELECT q.*, word IN (chr(10), '.', '!', '?', ',', '、') AS forced FROM q JOIN l USING (doc_id, chunk) WHERE df <= most OR word IN (chr(10), '.', '!', '?', ',', '、')),
z AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM y),
o AS (SELECT doc_id, count(*)::INT AS n_kept, string_agg(word, ' ' ORDER BY i) AS compressed FROM z WHERE NOT (forced AND coalesce(before = word, false)) GROUP BY doc_id)
SELECT t.doc_id, len(w)::INT AS n_tokens, coalesce((SELECT count(*) FROM k WHERE k.doc_id = t.doc_id), 0)::INT AS n_chunks, coalesce(n_kept, 0) AS n_kept, md5(coalesce(compressed, '')) AS compressed_md5 FROM t LEFT JOIN o USING (doc_id)""")
def compress_text(spark, d):
    """X04, F03."""
    got = compress.compress(S.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", rate=0.5, budget=200, labels=False)
    return got.select("doc_id", "n_tokens", "n_chunks", "n_kept", F.md5(F.col("compressed").cast("binary")).alias("compressed_md5"))


@query("mask_values", "SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE substr(source, 1, 4) || '***' END AS masked FROM documents")
def mask_values(spark, d):
    """F26."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.mask(F.col("source")).alias("masked"))


@query("item_keys", "SELECT doc_id, md5(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'm' || doc_id END, ''), CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END, 'content:' || text)) AS key_md5 FROM documents")
def item_keys(spark, d):
    """F31."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    key = T.item_key(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(name("m")), F.when(F.col("doc_id") % 2 == 0, name("x")))
    return docs.select("doc_id", F.md5(key).alias("key_md5"))


@query("snowflake_parts", """SELECT event_id, (v >> 22) + 1704067200000 AS millis, ((v >> 17) & 31)::INT AS datacenter, ((v >> 12) & 31)::INT AS worker, (v & 4095)::INT AS sequence
  FROM (SELECT event_id, event_id * 1000003 * 4099 AS v FROM events)""")
def snowflake_parts(spark, d):
    """F22."""
    parts = T.snowflake_parts(F.col("event_id") * 1000003 * 4099)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", parts.alias("p")).select("event_id", "p.*")


@query("point_ids", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
  substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) END AS point_id
  FROM (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('m' || doc_id)) AS h FROM documents)""")
def point_ids(spark, d):
    """F21."""
    name = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("m"), F.col("doc_id").cast("string")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.point_id(name).alias("point_id"))


@query("dense_threshold", """SELECT q.vec_id AS query_id, q.label AS user_id, e.vec_id AS memory_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS dense_score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) DESC, e.vec_id))::INT AS dense_rank
FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) >= 0.2 QUALIFY dense_rank <= 30""")
def dense_threshold(spark, d):
    """P11."""
    v = S.vectors(spark, d)
    asked = v.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), "user_id", F.col("dense").alias("qdense"))
    return search.dense_topk(v, asked, 30, threshold=0.2)


@query("memory_view", f"WITH {MEM} SELECT user_id, memory_id, memory_content, memory_type, memory_category, importance, confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM mem WHERE status = 'active'")
def memory_view(spark, d):
    """P12."""
    return _text(store.memory_view(S.memories(spark, d).where("status = 'active'")), "created_at")


@query("counts_by_type", f"WITH {MEM} SELECT user_id, memory_type, count(*) AS n FROM mem GROUP BY ALL")
def counts_by_type(spark, d):
    """A15."""
    return store.counts_by_type(S.memories(spark, d))


@query("sigmoid_scores", "SELECT event_id, round(1 / (1 + exp(-value / 50)), 9) AS score FROM events")
def sigmoid_scores(spark, d):
    """F11."""
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(ranking.sigmoid(F.col("value") / 50), 9).alias("score"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
