"""Category documents in parts: cutting, writing and reading back."""

from pyspark.sql import functions as F

from larkspur.operators import documents

ROW = "user_id string, memory_type string, memory_category string, status string, memory_id string, memory_content string, importance double, created_at timestamp"


def memories(spark, rows):
    df = spark.createDataFrame([(u, "profile", c, s, m, t, i) for u, c, s, m, t, i in rows], ROW.replace(", created_at timestamp", ""))
    return df.withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))


def whole(rows, user, category):
    mine = sorted((-i, m, t) for u, c, s, m, t, i in rows if (u, c, s) == (user, category, "active") and t and t.strip())
    return "".join(f"- ({-i:.2f}) {t}\n" for i, _, t in mine)


def test_parts_put_and_get(spark, tmp_path):
    rows = [("hot", "fact", "active", f"m{i:03d}", f"text é {i} " * (i % 5 + 1), (i % 7) / 10) for i in range(300)]
    rows += [("u/1", "a b", "active", "x", "only one", 0.5), ("u/1", "a b", "archived", "y", "gone", 0.5), ("u/1", "a b", "active", "z", " ", 0.9), ("u/1", "goal", "active", "n", None, 0.9)]
    parts = documents.category_parts(memories(spark, rows).repartition(5), 500)
    got = parts.orderBy("part").collect()
    hot = [r for r in got if r.user_id == "hot"]
    assert "".join(r.body for r in hot) == whole(rows, "hot", "fact") and [r.part for r in hot] == sorted({r.part for r in hot})
    assert len(hot) > 10 and all(len(r.body) < 500 + 100 for r in hot) and sum(r.n for r in hot) == 300
    assert [(r.user_id, r.part, r.n) for r in got if r.user_id != "hot"] == [("u/1", 0, 1)]
    root = f"{tmp_path}/docs"
    documents.put(parts, root)
    assert {(r.user, r.dir, r.category, r.parts, r.n) for r in documents.listed(spark, root).collect()} == {("hot", "Profile Memory", "fact", len(hot), 300), ("u_1", "Profile Memory", "a_b", 1, 1)}
    # a shorter document takes the place of a longer one; others stay; the same again changes nothing
    fewer = documents.category_parts(memories(spark, rows[:3]), 500)
    for _ in range(2):
        documents.put(fewer, root)
    assert "".join(documents.get(spark, root, "hot", "profile", "fact")) == "# Profile Memory / fact\n\n" + whole(rows[:3], "hot", "fact")
    assert documents.get(spark, root, "u/1", "profile", "a b") == ["# Profile Memory / a b\n\n- (0.50) only one\n"]
    assert documents.get(spark, root, "nobody", "profile", "fact") == []
    assert documents.category_parts(memories(spark, rows[:1]).limit(0)).count() == 0
