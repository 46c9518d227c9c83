"""The vector index against full scans, and components against union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph, index, search
from larkspur.operators.graph import components, forest
from larkspur.operators.merge import clusters
from larkspur.operators.rounds import SPLIT, spread_join
from larkspur.operators.search import dense_topk, similar_links, similar_pairs

D = 6


def table(kind, seed, n=240):
    """(bucket, key, vector): random ones, tight clusters, or a crowd of equal and nearly equal ones; some that are left out."""
    rng = np.random.default_rng(seed)
    if kind == "random":
        x = rng.normal(size=(n, D))
    elif kind == "clustered":
        x = rng.normal(size=(12, D))[rng.integers(0, 12, n)] + rng.normal(size=(n, D)) * 0.05
    else:
        x = np.where(rng.random((n, 1)) < 0.6, 1.0, rng.normal(size=(n, D)) * 0.01 + 1)
    rows = [(f"u{i % 3}" if i % 5 else "u0", f"k{i:04d}", [float(v) for v in x[i]]) for i in range(n)]
    return [*rows, ("u0", "zero", [0.0] * D), ("u1", "null", None), ("u1", "nan", [float("nan")] + [0.0] * 5), ("u2", "short", [1.0]), ("u9", "alone", [1.0] * D)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id string, memory_id string, dense array<double>").repartition(4)


def good(rows):
    return [(b, k, np.array(v)) for b, k, v in rows if v is not None and len(v) == D and np.isfinite(v).all()]


def score(metric, q, x):
    if metric == "cosine":
        n = np.linalg.norm(q) * np.linalg.norm(x)
        return float(q @ x / n) if n > 1e-12 else 0.0
    return {"dot": lambda: float(q @ x), "euclid": lambda: float(np.sqrt(((q - x) ** 2).sum())), "manhattan": lambda: float(np.abs(q - x).sum())}[metric]()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks of a few rows, so that cells and queries are split."""
    monkeypatch.setattr(index, "BLOCK", 7)
    monkeypatch.setattr(search, "LINKED_CELL", 20)


@pytest.mark.parametrize(("kind", "metric", "threshold"), [("random", "cosine", None), ("clustered", "cosine", 0.9), ("crowd", "cosine", None), ("clustered", "euclid", None), ("random", "dot", None), ("clustered", "manhattan", 2.0)])
def test_top_k_is_that_of_a_full_scan(spark, kind, metric, threshold):
    rows = table(kind, 1)
    asked = [("q%d" % i, b, v) for i, (b, _, v) in enumerate(rows) if i % 9 == 0 or i >= 240] + [("qx", "nobody", [1.0] * D), ("q0", "u1", [0.5] * D)]
    queries = spark.createDataFrame(asked, "query_id string, user_id string, qdense array<double>")
    got = {(r.query_id, r.user_id, r.dense_rank): (r.memory_id, r.dense_score) for r in dense_topk(frame(spark, rows), queries, 5, metric, threshold).collect()}
    want, less = {}, metric in ("euclid", "manhattan")
    for q, b, v in asked:
        if v is None or len(v) != D or not np.isfinite(v).all():
            continue
        s = sorted(((round(score(metric, np.array(v), x), 4) * (1 if less else -1), k) for u, k, x in good(rows) if u == b))
        s = [x for x in s if threshold is None or (x[0] <= threshold if less else -x[0] >= threshold)]
        want |= {(q, b, n): (k, abs(x) if less else -x) for n, (x, k) in enumerate(s[:5], 1)}
    assert got.keys() == want.keys()
    assert all(g[0] == want[n][0] and abs(g[1] - want[n][1]) < 1e-9 for n, g in got.items())


@pytest.mark.parametrize(("kind", "threshold"), [("random", 0.5), ("clustered", 0.99), ("crowd", 0.9999), ("random", -0.2)])
def test_pairs_and_links_are_those_of_a_full_scan(spark, kind, threshold):
    rows = table(kind, 2, 150)
    got = {(r.user_id, r.a, r.b): r.cosine for r in similar_pairs(frame(spark, rows), ["user_id"], "memory_id", "dense", threshold).collect()}
    kept = sorted(good(rows), key=lambda r: r[1])
    want = {(b, k, m): score("cosine", x, y) for i, (b, k, x) in enumerate(kept) for c, m, y in kept[i + 1 :] if b == c and round(score("cosine", x, y), 9) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in got)
    links = [(r.a, r.b) for r in similar_links(frame(spark, rows), ["user_id"], "memory_id", "dense", threshold).collect()]
    assert union(links) == union([p[1:] for p in want])
    got = clusters(frame(spark, rows), ["user_id"], "memory_id", "dense", threshold).collect()
    assert {r.memory_id: r.component for r in got} == union([p[1:] for p in want])


def union(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_far_cells_are_left_out(spark, monkeypatch):
    """Of tight clusters, a query meets few vectors."""
    seen = spark.sparkContext.accumulator(0)
    real = index._best

    def counted(*args):
        run = real(*args)

        def task(left, right):
            seen.add(left.num_rows * right.num_rows)
            return run(left, right)

        return task

    monkeypatch.setattr(index, "_best", counted)
    rows = [("u0", k, v) for _, k, v in table("clustered", 3, 600) if k.startswith("k")]
    queries = spark.createDataFrame([(r[1], "u0", r[2]) for r in rows[:40]], "query_id string, user_id string, qdense array<double>")
    assert dense_topk(frame(spark, rows), queries, 5).count() == 200
    assert 0 < seen.value < 40 * 600 / 2


def test_no_join_on_the_user_alone(spark):
    rows = table("random", 4)
    queries = frame(spark, rows[:9]).withColumnsRenamed({"memory_id": "query_id", "dense": "qdense"})
    for df in (dense_topk(frame(spark, rows), queries), similar_pairs(frame(spark, rows), ["user_id"], "memory_id", "dense", 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "cell" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert not [x for x in plan.splitlines() if "Join" in x and "[user_id#" in x and x.split("[user_id#")[1].split("]")[0].count(",") == 0]


def test_nothing_to_find(spark):
    none = frame(spark, [])
    queries = spark.createDataFrame([("q", "u", [1.0] * D)], "query_id string, user_id string, qdense array<double>")
    assert dense_topk(none, queries).count() == 0 and dense_topk(frame(spark, table("random", 5)), queries.limit(0)).count() == 0
    assert similar_pairs(none, ["user_id"], "memory_id", "dense", 0.5).count() == 0
    assert clusters(none, ["user_id"], "memory_id", "dense", 0.5).count() == 0


@pytest.mark.parametrize("at_once", [40, 500_000])
def test_components_of_all_shapes(spark, monkeypatch, at_once):
    """By rounds over the tables, or by one task."""
    monkeypatch.setattr(graph, "_AT_ONCE", at_once)
    rnd = random.Random(1)
    for kind, name in (("string", lambda i: f"n{i:05d}é"), ("long", lambda i: i - 50)):
        edges = [(i, i + 1) for i in range(0, 400)] + [(500, 500 + i) for i in range(300)] + [(1500 - i, 1500) for i in range(300)]
        edges += [(rnd.randrange(2000, 2600), rnd.randrange(2000, 2600)) for _ in range(250)] + [(9, 9), (3000, 3000)]
        edges = [(name(a), name(b)) for a, b in rnd.sample(edges, len(edges))]
        df = spark.createDataFrame([*edges, (None, edges[0][0]), (edges[0][1], None)], f"a {kind}, b {kind}").repartition(5)
        assert {r.id: r.component for r in components(df).collect()} == union(edges)
    assert components(df.limit(0)).count() == 0


def test_forest():
    u, v = np.array([5, 4, 9, 7]), np.array([4, 3, 8, 3])
    assert sorted(zip(*(x.tolist() for x in forest(u, v)), strict=True)) == [(4, 3), (5, 3), (7, 3), (9, 8)]


def test_a_star_of_a_million_leaves_is_dealt_out(spark):
    """The hub is the greatest id, the worst case: its edges meet its least neighbour in parts."""
    n = 1_000_000
    edges = spark.range(n).select(F.col("id").alias("a"), F.lit(n).cast("long").alias("b"))
    got = components(edges)
    assert got.agg(F.count("*"), F.max("component")).first()[:] == (n + 1, 0)
    both = edges.withColumnsRenamed({"b": "u", "a": "v"})
    sizes = both.groupBy("u").agg(F.count("*").alias("n"))
    met = spread_join(both, sizes.select("u", F.lit(0).alias("m")), ["u"], sizes, n, "v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert sum(parts) == n and len(parts) > 1 and parts[-1] <= 2 * parts[len(parts) // 2] and n > 100 * SPLIT


def test_tasks_hold_matrices_of_a_bounded_size(monkeypatch):
    """However many pivots there are, and however many cells a vector reaches."""
    rng = np.random.default_rng(3)
    x, pivots = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(100, D)), rng.normal(size=(50, D))))
    batch = index.pa.record_batch([index.pa.array(np.arange(100)), index.pa.array(x.tolist())], names=["key", "v"])
    seen, real = [], index.gaps
    monkeypatch.setattr(index, "AT_ONCE", 500, raising=False)
    monkeypatch.setattr(index, "gaps", lambda metric, x, pivots: seen.append(x.size // D * len(pivots)) or real(metric, x, pivots))
    out = list(index._reaching(pivots, np.zeros(50), np.full(50, 4.0), 4.0)([batch]))
    assert max(o.num_rows for o in out) <= index.BLOCK and sum(o.num_rows for o in out) > 1000
    assert sum(o.num_rows for o in index._placed("cosine", pivots)([batch])) == 100 and max(seen) <= 500
