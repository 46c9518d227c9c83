"""Hand-computed cases of the operators (the micro-fixtures of FIXTURES.md, part C)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import dialogue, graph, log, merge, ranking, search, store, validate


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_repeated_term_and_empty_documents(spark):
    m = spark.createDataFrame([("u", "m1", "cat dog"), ("u", "m2", "cat cat"), ("u", "m3", ""), ("v", "m4", "")], "user_id string, memory_id string, memory_content string")
    q = spark.createDataFrame([(1, "u", "dog"), (2, "u", "dog dog"), (3, "u", "?"), (4, "v", "cat")], "query_id int, user_id string, text string")
    got = {r.query_id: r.bm25_score for r in search.bm25_topk(m, q).collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    assert got[1] == pytest.approx(idf * 2.5 / 2.5, abs=1e-6) and got[2] == pytest.approx(2 * got[1], abs=1e-5)
    assert set(got) == {1, 2}
    _, stats = search.bm25_index(m)
    assert rows(stats, "user_id", "n_docs", "avgdl") == [("u", 2, 2.0)]


def test_rrf_ties_and_duplicates(spark):
    ranked = lambda *xs: spark.createDataFrame([("q", k, i) for i, k in enumerate(xs, 1)], "query_id string, key string, rank int")
    out = ranking.rrf([ranked("a", "b", "a"), ranked("b", "a"), ranked("c")], 10)
    got = [(r.key, r.best_list) for r in out.orderBy("rrf_rank").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2)]  # a and b tie: both best at rank 1, list 0 first
    with pytest.raises(ValueError):
        ranking.rrf([ranked("a")], constant=0)
    with pytest.raises(ValueError):
        ranking.rrf([ranked("a")], weights=[1.0, 2.0])


def brute_mmr(vectors, q, k, lam):
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    left = [i for i in range(len(vectors)) if cos(vectors[i], q) >= 0]
    out = []
    while left and len(out) < k:
        best = max(left, key=lambda i: lam * cos(vectors[i], q) - (1 - lam) * max([cos(vectors[i], vectors[j]) for j in out], default=0))
        out.append(best)
        left.remove(best)
    return out


def test_mmr_and_diversity_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data, pools = [], {}
    for query in range(4):
        vectors, q = rng.normal(size=(12, 5)), rng.normal(size=5)
        vectors[3] = 0
        pools[query] = (vectors, q)
        data += [(query, i, i, vectors[i].tolist(), q.tolist()) for i in range(12)]
    pool = spark.createDataFrame(data, "query_id int, key int, position int, dense array<double>, qdense array<double>")
    for lam in (0.0, 0.5, 1.0):
        got = ranking.mmr(pool, 6, lam).orderBy("query_id", "mmr_rank").collect()
        for query, (vectors, q) in pools.items():
            assert [r.key for r in got if r.query_id == query] == brute_mmr(vectors, q, 6, lam)
    with pytest.raises(ValueError):
        ranking.mmr(pool, 6, 1.5)
    for r in ranking.diverse(pool, 12, 0.3).groupBy("query_id").agg(F.collect_list("key").alias("keys")).collect():
        v = pools[r.query_id][0]
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        assert all(v[i] @ v[j] < 0.3 for i in r["keys"] for j in r["keys"] if i < j)


def test_llm_rerank_drops_bad_and_appends_rest(spark):
    c = spark.createDataFrame([(1, i) for i in range(4)], "query_id int, idx int")
    r = spark.createDataFrame([(1, 0, 2, 0.9), (1, 1, 2, 0.1), (1, 2, 77, 0.5), (1, 3, 0, 3.0)], "query_id int, pos int, idx int, llm_score double")
    assert [(x.idx, x.llm_score) for x in ranking.llm_rerank(c, r, 4).orderBy("llm_rank").collect()] == [(2, 0.9), (0, 1.0), (1, 0.0), (3, 0.0)]


def test_messages_turns_and_topics(spark):
    m = spark.createDataFrame(
        [(1, 0, " System ", "s"), (1, 1, "USER", " a\nb "), (1, 2, "robot", "x"), (1, 3, "assistant", "  "), (1, 4, "assistant", "c"), (2, 0, "bad", "x")], "conv_id int, turn int, role string, content string"
    )
    valid = dialogue.valid_messages(m)
    assert rows(valid, "seq", "role", "content") == [(0, "system", "s"), (1, "user", "a\nb"), (2, "assistant", "c")]
    records = dialogue.turn_records(valid)
    assert rows(records, "record", "text", "n_messages") == [(0, "sa\nb", 2), (1, "c", 1)]
    segments = dialogue.topic_segments(records)
    assert rows(segments, "topic_id", "start_record", "end_record", "n_messages", "segmented") == [(0, 0, 1, 3, False)]
    text = dialogue.topic_texts(dialogue.topic_entries(valid, segments)).first().topic_text
    assert text == "[0] speaker:system,content:s\n[1] speaker:user,content:a\\nb\n[2] speaker:ai,content:c"


@pytest.mark.parametrize(("tokens", "topics"), [(512, 1), (513, 2)])
def test_token_gate(spark, tokens, topics):
    m = spark.createDataFrame([(1, 0, "user", "a " * 200), (1, 1, "user", "a " * 56), (1, 2, "user", "b " * 200), (1, 3, "user", "b " * (tokens - 456))], "conv_id int, turn int, role string, content string")
    assert dialogue.topic_segments(dialogue.turn_records(dialogue.valid_messages(m))).count() == topics


def test_validate_history(spark):
    ok = [("user", "hi")]
    h = spark.createDataFrame(
        [("u", "s1", None, "x9", "2025-01-01T00:00:00Z", ok), ("u", None, None, None, " ", ok), (" ", "s", None, None, None, ok), ("u", "s", None, None, None, []), ("u", "s", None, None, None, [("user", " ")])],
        "user_id string, session_id string, raw_conversation_id string, raw_convation_id string, conversation_date_time string, conversation array<struct<role: string, content: string>>",
    )
    valid, bad = dialogue.validate_history(h, "2025-02-02")
    got = rows(valid, "conversation_id", "conversation_time")
    assert got[1] == ("x9", "2025-01-01T00:00:00Z") and got[0][0].startswith("sess_") and got[0][1] == "2025-02-02"
    assert sorted(r.error for r in bad.collect()) == ["conversation is empty", "no valid message", "user_id is missing"]


def test_clusters_follow_chains(spark):
    e = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", [1.0, 0.8]), ("u", "c", [0.2, 1.0]), ("u", "z", [-1.0, 0.0]), ("v", "q", [1.0, 0.0]), ("u", "n", None)], "user_id string, memory_id string, dense array<double>")
    assert rows(merge.clusters(e, ["user_id"], "memory_id", "dense", 0.7), "memory_id", "component") == [("a", "a"), ("b", "a"), ("c", "a")]


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_consolidate(spark):
    data = [
        ("m1", "u", "old", "profile", "fact", "active", "2025-01-01 00:00:00", 0.2, 0.4, ["t1", "t2"], {"t1": [3, 1]}),
        ("m2", "u", "new", "profile", "fact", "active", "2025-01-02 00:00:00", 0.6, 0.8, ["t2", "t3"], {"t1": [1, 2]}),
        ("m3", "u", "far", "profile", "fact", "active", "2025-01-02 00:00:00", 0.6, 0.8, [], {}),
        ("m4", "u", "same bucket no", "state", "fact", "active", "2025-01-02 00:00:00", 0.6, 0.8, [], {}),
    ]
    m = spark.createDataFrame(data, "memory_id string, user_id string, memory_content string, memory_type string, memory_category string, status string, created_at string, importance double, confidence double, source_topic_ids array<string>, source_topic_cites map<string, array<int>>")
    m = m.withColumn("created_at", F.to_timestamp("created_at"))
    v = spark.createDataFrame([("m1", [1.0, 0.1]), ("m2", [1.0, 0.0]), ("m3", [0.0, 1.0]), ("m4", [1.0, 0.0])], "memory_id string, dense array<double>")
    d = spark.createDataFrame([("m1", True, " merged ", "", None, 0.0, None)], "component string, should_merge boolean, merged_content string, memory_type string, memory_category string, llm_importance double, llm_confidence double")
    after, report = merge.consolidate(m, v, d, "2025-03-01 00:00:00", 0.9)
    assert tuple(report.first()) == (1, 1, 2)
    got = {r.memory_id: r for r in after.collect()}
    assert [got[i].status for i in ("m1", "m2", "m3", "m4")] == ["archived", "archived", "active", "active"]
    new = next(r for i, r in got.items() if i.startswith("mem_"))
    assert (new.memory_content, new.memory_type, new.memory_category, new.importance, new.derived_memory_count) == ("merged", "profile", "fact", 0.6, 2)
    assert new.confidence == pytest.approx(0.6)
    assert new.derived_from_memory_ids == ["m2", "m1"] and new.source_topic_ids == ["t2", "t3", "t1"] and new.source_topic_cites == {"t1": [1, 2, 3]}


def test_upsert_keeps_and_bump_counts_queries(spark):
    old = spark.createDataFrame([("a", "u1", 1, "t0"), ("b", "u1", 2, "t0")], "memory_id string, user_id string, x int, created_at string")
    new = spark.createDataFrame([("a", "u9", 7, "t9", 1), ("a", "u9", 8, "t9", 2), ("c", "u2", 3, "t5", 1)], "memory_id string, user_id string, x int, created_at string, seq int")
    got = store.upsert(old, new, "memory_id", keep=("created_at", "user_id"), seq="seq")
    assert rows(got, "memory_id", "user_id", "x", "created_at") == [("a", "u1", 8, "t0"), ("b", "u1", 2, "t0"), ("c", "u2", 3, "t5")]
    counted = old.select("memory_id", F.lit(1).alias("retrieval_count"), F.lit("t1").alias("last_retrieved_at"))
    hits = spark.createDataFrame([(1, "a", "t3"), (1, "a", "t2"), (2, "a", "t2"), (2, "zz", "t9")], "query_id int, memory_id string, at string")
    assert rows(store.bump_retrieval(counted, hits), "memory_id", "retrieval_count", "last_retrieved_at") == [("a", 3, "t3"), ("b", 1, "t1")]


def test_snapshots(spark, tmp_path):
    s = log.Store(spark, f"{tmp_path}/s")
    whole = lambda **tables: {n: (df, "id", ()) for n, df in tables.items()}
    s.replace(whole(a=spark.range(3), b=spark.range(2)))
    s.replace(whole(a=s.read("a").where("id > 0")))
    assert s.read("a").count() == 2 and s.read("b").count() == 2 and s.tables() == ["a", "b"]
    with pytest.raises(Exception):
        s.replace(whole(b=spark.range(9), a=spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))))
    assert s.read("b").count() == 2


def test_provenance_passes_over_dangling(spark):
    m = spark.createDataFrame([("m", ["t2", "gone", "t1"], {"t1": [5, 0], "gone": [1]})], "memory_id string, source_topic_ids array<string>, source_topic_cites map<string, array<int>>")
    t = spark.createDataFrame([("t1", ["c1", "c2"], [(0, "zero"), (1, "one")]), ("t2", ["c2"], [])], "topic_id string, source_conversation_ids array<string>, topic_messages array<struct<index: int, content: string>>")
    assert store.provenance(m, t).first().conversation_ids == ["c2", "c1"]
    assert rows(store.cited_messages(m, t), "position", "content") == [(1, "zero")]


def test_validators(spark):
    items = [
        ("profile", '{"memory_content":"likes tea","memory_type":"profile","memory_category":"preference","importance":1,"confidence":0.5,"cite":[1]}'),
        ("profile", '{"memory_content":" ","memory_type":"profile","memory_category":"odd","importance":1.5,"confidence":"high","cite":[1,"x"]}'),
        (None, '{"memory_content":"a","memory_type":"state","memory_category":"current_focus","importance":true,"confidence":0,"cite":[true]}'),
    ]
    got = validate.verify_items(spark.createDataFrame(items, "kind string, j string").select("kind", F.parse_json("j").alias("item")))
    assert [len(r.errors) for r in got.collect()] == [0, 5, 2]
    assert rows(validate.verify_rollup(got.where("kind IS NOT NULL"), ["kind"]), "kind", "valid", "total", "valid_count") == [("profile", False, 2, 1)]


def test_extractor_answers(spark):
    answers = [
        ("t1", "profile", 'Sure: {"memories":[{"memory_type":"state","memory_category":" FACT ","content":" x ","cite":[1,true,"2"],"importance":"9"},{"memory_category":"odd","content":"y"}]} ok'),
        ("t2", "state", '[{"memory_type":"state","memory_category":"current_focus","memory_content":"z"}]'),
        ("t3", "state", "not json"),
        ("t4", "state", '{"topic":"no memories"}'),
    ]
    df = spark.createDataFrame(answers, "topic_id string, kind string, answer string")
    assert rows(validate.extracted(df), "topic_id", "memory_type", "memory_content", "cites", "importance", "confidence") == [("t1", "profile", "x", [1], 1.0, 0.5), ("t2", "state", "z", [], 0.5, 0.5)]
    assert rows(validate.extracted(df, force_kind=False), "topic_id", "memory_type") == [("t2", "state")]


def test_missing_facts(spark):
    facts = spark.createDataFrame([("f1", "s9"), ("f2", "s9")], "fact_id string, planned_session string")
    evidence = spark.createDataFrame([("f1", "D2:1", "s2", 1), ("f1", "D1:1", "s1", 0), ("f1", "D2:1", "s2", 3)], "fact_id string, dia_id string, session string, position int")
    got = {r.fact_id: (r.sessions, r.evidence, r.missing) for r in store.missing_facts(facts, evidence).collect()}
    assert got == {"f1": (["s1", "s2"], ["D1:1", "D2:1"], False), "f2": (["s9"], [], True)}
