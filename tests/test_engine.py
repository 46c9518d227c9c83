"""Extract, update and retrieve end to end, with replayed model answers; the same by a stream."""

import json

from pyspark.sql import functions as F

from larkspur.main import main
from larkspur.plans.engine import Engine
from larkspur.sources import tables
from larkspur.streaming import incremental

NOW = "2025-06-01 00:00:00"


def answer(kind, text):
    item = F.struct(kind.alias("memory_type"), F.when(kind == "profile", "fact").when(kind == "episodic", "life_event").otherwise("current_focus").alias("memory_category"), F.concat(kind, F.lit(" of "), F.substring(text, 1, 40)).alias("content"), F.array(F.lit(0)).alias("cite"), F.lit(0.7).alias("importance"))
    return F.to_json(F.struct(F.array(item).alias("memories")))


def histories(path):
    path.mkdir()
    for i in range(3):
        turns = [{"role": "user", "content": f"I like tea number {i % 2}"}, {"role": "assistant", "content": "noted"}, {"role": "robot", "content": "drop"}]
        (path / f"h{i}.json").write_text(json.dumps({"user_id": f"u{i % 2}", "session_id": f"s{i}", "conversation_date_time": "2025-05-01T10:00:00Z", "conversation": turns}))
    (path / "bad.json").write_text(json.dumps({"user_id": "", "session_id": "x", "conversation": []}))
    return str(path)


def test_extract_update_retrieve(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store", answer=answer)
    source = tables.histories(spark, histories(tmp_path / "in"))
    counts, rejected = engine.extract(source, NOW)
    assert counts == {"topics": 3, "memories": 9, "vectors": 9} and rejected.count() == 1
    again, _ = engine.extract(source, NOW)
    assert again == counts  # ids follow from the content: a repeated batch changes nothing
    groups = engine.clusters(0.9)
    decisions = groups.select("component").distinct().select("component", F.lit(True).alias("should_merge"), F.lit("tea, always tea").alias("merged_content"), F.lit("").alias("memory_type"), F.lit("").alias("memory_category"), F.lit(0.0).alias("llm_importance"), F.lit(None).cast("double").alias("llm_confidence"))
    report = engine.update(decisions, NOW, 0.9).first()
    assert (report.clusters, report.merged, report.archived) == (3, 3, 6)
    assert engine.store.read("documents").count() == 6
    queries = spark.createDataFrame([(1, "u0", "tea"), (2, "u1", "tea number 1"), (3, "nobody", "tea")], "query_id int, user_id string, text string")
    hits = engine.retrieve(queries, NOW, 2).collect()
    assert {r.query_id for r in hits} == {1, 2} and all(r.status == "active" for r in hits)
    assert engine.memories().agg(F.sum("retrieval_count")).first()[0] == len(hits)


def test_replay_table_and_cli(spark, tmp_path, capsys):
    source = histories(tmp_path / "in")
    text = "[0] speaker:user,content:I like tea number 0\n[1] speaker:ai,content:noted"
    replay = spark.createDataFrame([("profile\n" + text, '{"memories":[{"memory_category":"fact","content":"likes tea"}]}')], "prompt string, response string")
    replay.select(F.md5("prompt").alias("prompt_md5"), "response").write.parquet(f"{tmp_path}/answers")
    main(["--store", f"{tmp_path}/store", "--now", NOW, "extract", "--histories", source, "--answers", f"{tmp_path}/answers"])
    assert "'memories': 2" in capsys.readouterr().out
    spark.createDataFrame([(1, "u0", "tea")], "query_id int, user_id string, text string").write.parquet(f"{tmp_path}/queries")
    main(["--store", f"{tmp_path}/store", "--now", NOW, "retrieve", "--queries", f"{tmp_path}/queries", "--out", f"{tmp_path}/out", "--top-k", "1"])
    assert [r.memory_content for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["likes tea"]


def test_stream_of_histories(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/store", answer=answer)
    stream = incremental.history_stream(spark, histories(tmp_path / "in"), files_per_trigger=2)
    incremental.extract_stream(stream, lambda df, _: engine.extract(df, NOW), f"{tmp_path}/check").awaitTermination(120)
    assert engine.memories().count() == 9


def test_sessions_in_a_stream(spark, tmp_path):
    rows = [("u", "2025-01-01 10:00:00"), ("u", "2025-01-01 10:20:00"), ("u", "2025-01-01 12:00:00"), ("w", "2025-01-03 00:00:00")]
    events = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events")
    batch = incremental.sessions(events)
    assert sorted((r.user_id, r.n_messages) for r in batch.collect()) == [("u", 1), ("u", 2), ("w", 1)]
    stream = incremental.sessions(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.n_messages) for r in spark.table("found").collect()) == [("u", 1), ("u", 2)]  # w's window is still open
