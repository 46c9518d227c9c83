"""Recall over all users and queries at once: BM25, dense, sparse; similar pairs within buckets.

Every join is an equi-join: on the user and the term, or on the user and a cell of the vector index.
Ranks come from row_number() <= k, which Spark turns into a group limit before the
shuffle; ties go to the lesser id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.operators.index import PivotIndex
from larkspur.operators.rounds import checkpoint, spread_join


def top_k(df: DataFrame, by: list[str], score: str, key: str, k: int, rank: str = "rank", ascending: bool = False) -> DataFrame:
    """The k best rows of each group, numbered from 1."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(order, F.col(key)))).where(F.col(rank) <= k)


#: Distinct (user, term) of queries up to which they are broadcast: some 20 MB.
ASKED_TERMS = 200_000


def only_asked(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """The tokens (user_id, term, ...) whose term a query of their user has, before they are shuffled."""
    terms = asked.select("user_id", "term").distinct()
    if terms.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS:
        terms = F.broadcast(terms)
    return tokens.join(terms, ["user_id", "term"], "left_semi")


def term_frequencies(items: DataFrame, keys: list[str], text: str | Column, asked: DataFrame | None = None) -> DataFrame:
    """(keys, term, tf) of a text, or of an array of terms, of the terms asked for if given; partial counts are made before the shuffle."""
    tokens = items.select(*keys, F.explode(T.bm25_terms(F.col(text)) if isinstance(text, str) else text).alias("term"))
    tokens = tokens if asked is None else only_asked(tokens, asked).select(*keys, "term")
    return tokens.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


#: Stands for a memory itself among its terms, none of which is empty.
WHOLE = ""


def asked_counts(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, memory_id, length, term, tf) of the terms asked for, and a row with the term WHOLE for each memory of the users that ask.

    One pass over the contents has what BM25 and sparse recall need of them: lengths of all memories, and counts of the terms asked for.
    """
    sized = memories.select("user_id", "memory_id", T.bm25_terms(F.col("memory_content")).alias("terms")).withColumn("length", F.size("terms"))
    asked = asked.select("user_id", "term").unionByName(asked.select("user_id", F.lit(WHOLE).alias("term")))
    return term_frequencies(sized, ["user_id", "memory_id", "length"], F.concat(F.array(F.lit(WHOLE)), F.col("terms")), asked)


def bm25_index(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of memories (user_id, memory_id, memory_content).

    postings: (user_id, term, memory_id, tf, length, df); stats: (user_id, n_docs, avgdl, n_terms, max_df).  The document's length travels
    with its postings, as tokens are counted in the row that yields them: no join brings it back.
    """
    terms = T.bm25_terms(F.col("memory_content"))
    sized = memories.select("user_id", "memory_id", terms.alias("terms")).where(F.size("terms") > 0)
    docs = sized.select("user_id", "memory_id", F.size("terms").alias("length"))
    tf = sized.select("user_id", "memory_id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("user_id", "memory_id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("user_id", "term").agg(F.count("*").alias("df"))
    stats = docs.groupBy("user_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))
    terms_of = df.groupBy("user_id").agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
    return tf.join(df, ["user_id", "term"]), stats.join(terms_of, "user_id")


def bm25_topk(memories: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, digits: int = 6, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, user_id, memory_id, bm25_score, bm25_rank); a repeated query term counts as often as it stands there.

    counts: what ``asked_counts`` gives for the memories and the queries' terms, kept by the caller, so that the contents are not read here.
    """
    q = term_frequencies(queries, ["query_id", "user_id"], "text").withColumnRenamed("tf", "qtf")
    if counts is None:
        terms = T.bm25_terms(F.col("memory_content"))
        sized = memories.select("user_id", "memory_id", terms.alias("terms")).withColumn("length", F.size("terms")).where("length > 0")
        stats = sized.groupBy("user_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))
        tokens = only_asked(sized.select("user_id", "memory_id", "length", F.explode("terms").alias("term")), q)
        tf = tokens.groupBy("user_id", "term", "memory_id", "length").agg(F.count("*").alias("tf"))
    else:
        whole = counts.where((F.col("term") == WHOLE) & (F.col("length") > 0))  # one row for all memories of one id and length
        stats = whole.groupBy("user_id").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("avgdl"))
        tf = counts.where(F.col("term") != WHOLE)
    postings = tf.join(tf.groupBy("user_id", "term").agg(F.count("*").alias("df")), ["user_id", "term"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    scored = q.join(postings, ["user_id", "term"]).join(stats, "user_id")
    scores = scored.groupBy("query_id", "user_id", "memory_id").agg(F.round(F.sum(part * F.col("qtf")), digits).alias("bm25_score"))
    return top_k(scores, ["query_id", "user_id"], "bm25_score", "memory_id", k, "bm25_rank")


def dense_topk(items: DataFrame, queries: DataFrame, k: int = 10, distance: str = "cosine", threshold: float | None = None, digits: int = 4) -> DataFrame:
    """Items (user_id, memory_id, dense) against queries (query_id, user_id, qdense), exact, within the user.

    Through cells around pivots (see ``index``), which are set up by some jobs here, before the caller acts.
    """
    metric, less = V.distance_name(distance)
    found = PivotIndex.build(items, ["user_id"], "memory_id", "dense", metric).top_k(queries, "qdense", k, less, threshold, digits)
    return top_k(found.withColumnsRenamed({"key": "memory_id", "score": "dense_score"}), ["query_id", "user_id"], "dense_score", "memory_id", k, "dense_rank", less)


def sparse_topk(weights: DataFrame, query_weights: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(user_id, memory_id, term, w) against (query_id, user_id, term, qw); a query without terms has no rows."""
    hits = query_weights.join(weights, ["user_id", "term"])
    scores = hits.groupBy("query_id", "user_id", "memory_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), digits).alias("sparse_score"))
    return top_k(scores, ["query_id", "user_id"], "sparse_score", "memory_id", k, "sparse_rank")


def similar_pairs(items: DataFrame, buckets: list[str], key: str, vector: str, threshold: float, digits: int = 9) -> DataFrame:
    """(buckets, a, b, cosine) for keys a < b of one bucket whose cosine is at least the threshold; buckets of one row give none.

    Through cells around pivots: only cells that the threshold can reach meet, block by block.
    """
    return PivotIndex.build(items, buckets, key, vector).pairs(threshold, digits).withColumnRenamed("score", "cosine")


#: Vectors of a cell where links are sought: a block gives as many links as it has vectors at most, so that small blocks give more of them.
LINKED_CELL = 1024


def similar_links(items: DataFrame, buckets: list[str], key: str, vector: str, threshold: float, digits: int = 9) -> DataFrame:
    """(a, b): links that join the keys of each bucket into the components of ``similar_pairs``, without all of its pairs.

    Equal vectors are joined to the least of their keys; of those that differ, each block gives a spanning forest.
    """
    given = items.where(F.col(vector).isNotNull()).select(*buckets, F.col(key).alias("key"), F.col(vector).alias("vector"))
    same = checkpoint(given.groupBy(*buckets, "vector").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    links = PivotIndex.build(same, buckets, "least", "vector", per_cell=LINKED_CELL).pairs(threshold, digits, linked_only=True).select("a", "b")
    alike = same.where((F.col("n") > 1) & (F.round(V.dot(V.unit(F.col("vector")), V.unit(F.col("vector"))), digits) >= threshold))
    total = alike.agg(F.sum("n")).first()[0] or 0
    if not total:
        return links
    copies = spread_join(given, alike.select(*buckets, "vector", "least"), [*buckets, "vector"], alike, total, "key")
    return links.union(copies.where("key != least").select("least", "key"))


def build_filter(user_id=None, memory_type=None, memory_category=None, status="active", content_hash=None, memory_ids=None, updated_from=None, updated_to=None, extra: list[Column] | None = None) -> Column:
    """The conjunction of what is given; true if nothing is."""
    out = F.lit(True)
    for name, value in (("user_id", user_id), ("memory_type", memory_type), ("memory_category", memory_category), ("status", status), ("content_hash", content_hash)):
        if value:
            out = out & (F.col(name) == value)
    if memory_ids:
        out = out & F.col("memory_id").isin(list(memory_ids))
    if updated_from is not None:
        out = out & (F.col("updated_at") >= F.lit(updated_from))
    if updated_to is not None:
        out = out & (F.col("updated_at") <= F.lit(updated_to))
    for c in extra or ():
        out = out & c
    return out
