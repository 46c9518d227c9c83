"""Contents of one query are ordered by several tasks."""

from pyspark.sql import functions as F

from larkspur.operators.ranking import distinct_contents


def test_distinct_contents_of_a_large_query(spark):
    rows = [("q", f"c{i % 300:03d}" + "x" * 80 + str(i % 3), i % 50) for i in range(900)] + [(None, "b", 2), (None, "a", 2), ("r", "one", 7), ("r", "one", 3)]
    hits = spark.createDataFrame(rows, "query_id string, content string, rank int").repartition(3)
    best = {}
    for q, c, r in rows:
        best[q, c] = min(r, best.get((q, c), r))
    want = {(q, c): n for g in ("q", None, "r") for n, (_, q, c) in enumerate(sorted((r, q, c) for (q, c), r in best.items() if q == g), 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = distinct_contents(hits).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.query_id, r.content): r.position for r in got} == want and len(got) == len(want)
    assert len({r.task for r in got if r.query_id == "q"}) > 1
