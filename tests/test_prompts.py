"""Prompts within budgets, answers brought back, pages, and choices on given similarities."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ranking, scroll
from larkspur.plans import prompts

MEMBER = "cluster string, memory_id string, memory_content string, memory_type string, memory_category string, importance double, confidence double, created_at timestamp"


def members(spark, rows):
    return spark.createDataFrame([(*r, "profile", "fact", 0.5, 0.5, t) for *r, t in rows], MEMBER.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))


def payload(prompt):
    return json.loads(prompt[prompt.rindex("\n\n[") :])


def test_merge_prompts_stop_at_the_budget(spark):
    rows = [("c", "m1", 'old "quoted" \n{x}', "2025-01-01"), ("c", "m2", "four words stand here", "2025-01-03"), ("c", "m3", "two words", "2025-01-02"), ("d", "m4", "word " * 50, "2025-01-01"), ("e", "m5", None, "2025-01-01")]
    got = {r.cluster: (r.n, [x.get("memory_id") for x in payload(r.prompt)]) for r in prompts.merge_prompts(members(spark, rows), 6).collect()}
    assert got == {"c": (2, ["m2", "m3"]), "d": (1, ["m4"]), "e": (1, ["m5"])}
    whole = {r.cluster: r.prompt for r in prompts.merge_prompts(members(spark, rows)).collect()}
    assert [x["memory_content"] for x in payload(whole["c"])][-1] == 'old "quoted" \n{x}' and whole["c"].startswith(prompts.TEMPLATES["merge"][:20])
    assert prompts.merge_prompts(members(spark, rows).limit(0)).count() == 0


def test_rerank_round_trip(spark):
    hits = spark.createDataFrame([("q", i, f"m{i}", "x" * 600 if i == 1 else f"content {i}", 1.0 / i) for i in range(1, 6)], "query_id string, rank int, memory_id string, memory_content string, score double")
    hits = hits.withColumns({"memory_type": F.lit(None).cast("string"), "memory_category": F.lit("fact"), "updated_at": F.lit(None).cast("string"), "retrieval_count": F.lit(None).cast("int")})
    c = prompts.rerank_candidates(hits, most=4).cache()
    asked = prompts.rerank_prompts(c, spark.createDataFrame([("q", "what?")], "query_id string, text string")).first()
    items = payload(asked.prompt)
    assert [x["index"] for x in items] == [0, 1, 2, 3] and len(items[0]["memory_content"]) == 500 and items[0]["memory_type"] == "" and "Query: what?" in asked.prompt
    answers = [("q", 'Sure: {"ranked": [{"index": 2, "score": 7}, {"index": "x"}, {"index": 9}, {"index": 0, "score": "bad"}, {"index": 2, "score": 0.1}, 5]}')]
    got = prompts.ranked_answers(spark.createDataFrame(answers, "query_id string, response string"), c)
    assert sorted((r.pos, r.idx, r.llm_score, r.memory_id) for r in got.collect()) == [(0, 2, 1.0, "m3"), (3, 0, 0.0, "m1")]
    order = ranking.llm_rerank(c.withColumn("idx", F.col("index")), got, 4).orderBy("llm_rank").collect()
    assert [r.memory_id for r in order] == ["m3", "m1", "m2", "m4"]
    lists = spark.createDataFrame([("q", '[{"index": 1}]'), ("p", "no json"), ("r", '{"other": 1}')], "query_id string, response string")
    assert [(r.query_id, r.idx) for r in prompts.ranked_answers(lists, c).collect()] == [("q", 1)]


def test_decisions_and_documents(spark):
    answers = [("a", 'ok {"should_merge": true, "merged_content": "x", "importance": 0.4}'), ("b", "cannot"), ("c", '{"should_merge": "maybe"}')]
    got = {r.component: (r.should_merge, r.merged_content, r.llm_importance, r.llm_confidence) for r in prompts.merge_decisions(spark.createDataFrame(answers, "component string, response string")).collect()}
    assert got == {"a": (True, "x", 0.4, None), "b": (False, None, None, None), "c": (False, None, None, None)}
    m = members(spark, [("u", "m1", "tea", "2025-01-01"), ("u", "m2", "more tea", "2025-01-02")]).withColumnsRenamed({"cluster": "user_id"}).withColumn("status", F.lit("active"))
    asked = prompts.category_prompts(m, most=1).first()
    assert asked.n == 1 and payload(asked.prompt)[0]["memory_id"] == "m2"
    docs = spark.createDataFrame([("u", "profile", "fact", 2, "# own\n"), ("v", "profile", "fact", 1, "# own\n")], "user_id string, memory_type string, memory_category string, n int, markdown string")
    back = spark.createDataFrame([("u", "profile", "fact", "```markdown\nhello\n```"), ("v", "profile", "fact", "  ")], "user_id string, memory_type string, memory_category string, response string")
    assert {r.user_id: r.markdown for r in prompts.category_answers(docs, back).collect()} == {"u": "# Profile Memory / fact\n\nhello\n", "v": "# own\n"}


def test_pages_and_cursors(spark):
    keys = [f"k{i:04d}é" for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys[::-1]], "k string").repartition(7)
    paged = scroll.pages(df, "k", 256)
    assert [(r.k, r.position, r.page) for r in paged.orderBy("position").collect()] == [(k, i, i // 256) for i, k in enumerate(sorted(keys))]
    assert sorted((r.page, r.n, r.first) for r in scroll.cursors(paged, "k").collect()) == [(p, min(256, 1000 - 256 * p), keys[256 * p]) for p in range(4)]
    assert scroll.pages(df.limit(0), "k").count() == 0
    found, cursor = [], None
    while True:
        rows, cursor = scroll.scroll(df, "k", cursor, 400)
        found += [r.k for r in rows]
        if cursor is None:
            break
    assert found == sorted(keys)


def test_choices_on_given_similarities(spark):
    rel, sim = [0.9, 0.9, 0.5, 0.1], [[1.0, 1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.5, 1.0]]
    df = spark.createDataFrame([(rel, sim)], "r array<double>, s array<array<double>>")
    pick = lambda k, lam: [(p["index"], round(p["mmr_score"], 9)) for p in df.select(ranking.mmr_select(F.col("r"), F.col("s"), k, lam).alias("p")).first().p]
    assert pick(3, 0.5) == [(0, 0.45), (2, 0.25), (1, -0.05)]
    assert [i for i, _ in pick(9, 1.0)] == [0, 1, 2, 3] and pick(0, 0.5) == [] and pick(2, 0.0)[0] == (0, 0.0)
    with pytest.raises(ValueError):
        ranking.mmr_select(F.col("r"), F.col("s"), 2, 1.1)
    assert df.select(ranking.diverse_select(F.col("s"), 3, 0.5).alias("p")).first().p == [0, 2]
    empty = df.select(F.array().cast("array<double>").alias("r"), F.array().cast("array<array<double>>").alias("s"))
    assert empty.select(ranking.mmr_select(F.col("r"), F.col("s"), 2, 0.5).alias("p"), ranking.diverse_select(F.col("s"), 2, 0.5).alias("d")).first()[:] == ([], [])


def test_stored_vectors_only_if_all_rows_have_one(spark):
    pool = spark.createDataFrame([(1, "a", [1.0]), (1, "b", None), (2, "c", [2.0]), (2, "d", [3.0])], "query_id int, memory_content string, emb array<double>")
    got = ranking.pool_vectors(pool, lambda text: F.array(F.length(text).cast("double") * 10)).collect()
    assert {r.memory_content: r.dense for r in got} == {"a": [10.0], "b": [10.0], "c": [2.0], "d": [3.0]}
