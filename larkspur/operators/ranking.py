"""Fusion and reranking of ranked lists, for all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import time as D
from larkspur.functions import vector as V
from larkspur.operators.scroll import numbered_within
from larkspur.operators.search import top_k


def rrf(lists: list[DataFrame], k: int = 10, constant: int = 60, weights: list[float] | None = None, digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists (query_id, key, rank).

    A key counts once a list, at its best rank. Order: score, best rank, best list, key. Gives rrf_score, best_rank, best_list, sources.
    """
    if constant < 1:
        raise ValueError("the rank constant is at least 1")
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight a list")
    tagged = [x.select("query_id", "key", "rank", F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    rows = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "key", "list", "w").agg(F.min("rank").alias("rank"))
    fused = rows.groupBy("query_id", "key").agg(
        F.round(F.sum(F.col("w") / (constant + F.col("rank"))), digits).alias("rrf_score"),
        F.min(F.struct("rank", "list")).alias("best"),
        F.array_sort(F.collect_list("list")).alias("sources"),  # one entry a list at most
    )
    fused = fused.select("query_id", "key", "rrf_score", F.col("best.rank").alias("best_rank"), F.col("best.list").alias("best_list"), "sources")
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "best_rank", "best_list", "key")
    return fused.withColumn("rrf_rank", F.row_number().over(w)).where(F.col("rrf_rank") <= max(1, k))


def final_score(df: DataFrame, now, tau_days: float = 30.0, digits: int = 9) -> DataFrame:
    """rrf_score with time decay, importance and confidence; created_at stands in for a missing updated_at."""
    when = F.coalesce("updated_at", "created_at") if "updated_at" in df.columns else F.col("created_at")
    decay = D.time_decay(when, now, tau_days)
    score = F.col("rrf_score") * decay * (0.6 + 0.4 * F.coalesce("importance", F.lit(0.5))) * (0.5 + 0.5 * F.coalesce("confidence", F.lit(0.5)))
    return df.withColumn("time_decay", F.round(decay, digits)).withColumn("final_score", F.round(score, digits))


def fallback_rerank(df: DataFrame, k: int) -> DataFrame:
    """K06 without a model: by the first of dense_score and score that is not zero."""
    first = F.coalesce(F.when(F.col("dense_score") != 0, F.col("dense_score")), F.when(F.col("score") != 0, F.col("score")), F.lit(0.0))
    return top_k(df.withColumn("bge_score", first), ["query_id"], "bge_score", "key", k, "bge_rank")


def llm_rerank(candidates: DataFrame, ranked: DataFrame, k: int, pool: int = 40) -> DataFrame:
    """Candidates (query_id, idx) in the order that ranked (query_id, pos, idx, llm_score) gives; bad and repeated indexes are dropped,
    candidates it does not name follow in their own order."""
    named = ranked.where((F.col("idx") >= 0) & (F.col("idx") < pool)).groupBy("query_id", "idx").agg(F.min(F.struct("pos", "llm_score")).alias("x"))
    rows = candidates.join(named, ["query_id", "idx"], "left").withColumn("llm_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.llm_score", F.lit(0.0)))))
    order = W.partitionBy("query_id").orderBy(F.col("x.pos").asc_nulls_last(), "idx")
    return rows.withColumn("llm_rank", F.row_number().over(order)).where(F.col("llm_rank") <= k).drop("x")


#: Characters of a content by which ranges of equal rank are cut.
CUT = 64


def distinct_contents(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """(query_id, content, position): each content at its best rank; a query's contents are ordered by many tasks."""
    first = hits.groupBy("query_id", "content").agg(F.min(rank).alias("rank"))
    return numbered_within(first, "query_id", ["rank", "content"], ["rank", F.substring("content", 1, CUT)]).select("query_id", "content", "position")


#: Digits to which similarities are rounded before anything is chosen by them, so that ties are ties whatever the order of summation.
SIMILARITY_DIGITS = 9


def mmr_select(relevance: Column, similarities: Column, k: int, lam: float) -> Column:
    """Array of (index, mmr_score): greedy maximal marginal relevance on given similarities; ties go to the first.

    relevance: array<double>; similarities: array of each candidate's array<double> to all. One fold of k steps, no Python worker.
    """
    if not 0 <= lam <= 1:
        raise ValueError("lambda lies between 0 and 1")
    none = F.array().cast("array<struct<index: int, mmr_score: double>>")
    start = F.struct(none.alias("picked"), F.transform(relevance, lambda _: F.lit(0.0)).alias("worst"))

    def step(state: Column, _: Column) -> Column:
        taken = F.transform(state["picked"], lambda p: p["index"])
        open_ = F.filter(
            F.transform(relevance, lambda r, i: F.struct((lam * r - (1 - lam) * F.get(state["worst"], i)).alias("score"), (-i).alias("last"))),
            lambda c: ~F.array_contains(taken, -c["last"]),
        )
        best = F.array_max(open_)
        near = F.get(similarities, -best["last"])
        worst = F.when(F.size(taken) == 0, near).otherwise(F.zip_with(state["worst"], near, lambda a, b: F.greatest(a, b)))
        more = F.struct(F.concat(state["picked"], F.array(F.struct((-best["last"]).alias("index"), best["score"].alias("mmr_score")))).alias("picked"), worst.alias("worst"))
        return F.when(F.size(open_) > 0, more).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, k))), start, step, lambda s: s["picked"]) if k > 0 else none


def diverse_select(similarities: Column, k: int, threshold: float) -> Column:
    """Indexes, in order, of the candidates that are less similar than the threshold to all that were taken before."""

    def step(taken: Column, i: Column) -> Column:
        near = F.array_max(F.transform(taken, lambda j: F.get(F.get(similarities, i), j)))
        return F.when((F.size(taken) < k) & (near.isNull() | (near < threshold)), F.concat(taken, F.array(i))).otherwise(taken)

    every = F.filter(F.sequence(F.lit(0), F.size(similarities)), lambda i: i < F.size(similarities))
    return F.aggregate(every, F.array().cast("array<int>"), step)


def pool_vectors(pool: DataFrame, embed, stored: str = "emb", content: str = "memory_content") -> DataFrame:
    """The pool (query_id, ...) with ``dense``: the stored vectors where all rows of a query's pool have one, else all made from the content."""
    whole = F.bool_and(F.col(stored).isNotNull()).over(W.partitionBy("query_id"))
    return pool.withColumn("_whole", whole).withColumn("dense", F.when(F.col("_whole"), F.col(stored)).otherwise(embed(F.col(content)))).drop("_whole")


def _pools(pool: DataFrame, order: list, *more: str) -> DataFrame:
    """(query_id, c, s): each query's candidates in order, and their similarities to each other. A pool is a few times k rows."""
    rows = pool.withColumn("u", V.unit(F.col("dense"))).withColumn("rel", F.round(V.dot(F.col("u"), V.unit(F.col("qdense"))), SIMILARITY_DIGITS))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*order, "key", "u", "rel", *more))).alias("c"))
    return lists


def _with_similarities(pools: DataFrame) -> DataFrame:
    s = F.transform("c", lambda a: F.transform("c", lambda b: F.round(V.dot(a["u"], b["u"]), SIMILARITY_DIGITS)))
    return pools.where(F.size("c") > 0).withColumn("s", s)


def mmr(pool: DataFrame, k: int = 10, lam: float = 0.5, min_relevance: float | None = 0.0, initial: str | None = None, weight: float = 0.5, digits: int = 6) -> DataFrame:
    """Pool (query_id, key, position, dense, qdense[, initial]) -> (query_id, key, mmr_rank, relevance_score, mmr_score).

    A query's pool has at most a few times k rows and is folded within its row; queries are dealt over all tasks.
    With ``initial``, relevance is mixed with the min-max normalised initial score (A17).
    """
    if not 0 <= lam <= 1:
        raise ValueError("lambda lies between 0 and 1")
    rows = pool if initial is None else pool.withColumn("initial", F.col(initial).cast("double"))
    pools = _pools(rows, ["position"], *(["initial"] if initial else []))
    if initial is None and min_relevance is not None:
        pools = pools.withColumn("c", F.filter("c", lambda x: x["rel"] >= min_relevance))
    relevance = F.transform("c", lambda x: x["rel"])
    if initial is not None:
        scores = F.transform("c", lambda x: x["initial"])
        pools = pools.withColumns({"least": F.array_min(scores), "most": F.array_max(scores)})
        mixed = lambda x: F.when(F.col("most") > F.col("least"), (x["initial"] - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(1.0)
        relevance = F.transform("c", lambda x: F.round(weight * mixed(x) + (1 - weight) * x["rel"], SIMILARITY_DIGITS))
    ready = _with_similarities(pools).withColumn("relevance", relevance)
    picked = ready.select("query_id", "c", "relevance", F.posexplode(mmr_select(F.col("relevance"), F.col("s"), k, lam)).alias("n", "p"))
    at = F.col("p.index")
    return picked.select("query_id", F.get("c", at)["key"].alias("key"), (F.col("n") + 1).alias("mmr_rank"), F.round(F.get("relevance", at), digits).alias("relevance_score"), F.round("p.mmr_score", digits).alias("mmr_score"))


def diverse(pool: DataFrame, k: int = 10, threshold: float = 0.8, digits: int = 6) -> DataFrame:
    """By relevance, whatever is less similar than the threshold to all that were taken: (query_id, key, relevance_score, diverse_rank)."""
    rows = pool.withColumn("u", V.unit(F.col("dense"))).withColumn("far", -F.round(V.dot(F.col("u"), V.unit(F.col("qdense"))), digits))
    ready = _with_similarities(_pools(rows, ["far", "position"]))
    picked = ready.select("query_id", "c", F.posexplode(diverse_select(F.col("s"), k, threshold)).alias("n", "i"))
    return picked.select("query_id", F.get("c", F.col("i"))["key"].alias("key"), (-F.get("c", F.col("i"))["far"]).alias("relevance_score"), (F.col("n") + 1).alias("diverse_rank"))


def sigmoid(logit):
    """a scorer's logit as a score between 0 and 1."""
    return 1 / (1 + F.exp(-logit))
