"""k-means over integer vectors, exact in every step.

A vector's components become integers (floor of component times scale).  In a round each
task multiplies its vectors with the centroids in float32.  For each product there is a
bound of what rounding can have done to it, whatever the order of summation, so that every
distance is known to lie in an interval.  A vector whose least interval overlaps no other
is assigned at once; for the others the centroids with overlapping intervals are compared
by exact integers, ties to the smaller number.  Tasks return the sums of their vectors by
centroid and component, Spark adds them up, and the driver gets k * dims numbers.
Centroids are k * dims integers that travel with the tasks.  No vector is kept between
rounds; each reads its input anew.

Integers of more than ``EXACT`` in size do not fit the fast path's 64 bits; their vectors
(or, if a centroid is that large, all vectors) are compared as Python integers, and sums
travel in limbs of 40 bits.

Defined results: a vector that is null, has another number of components, or a component
that is null or not finite, is left out.  Rows with a null id come last when centroids are
chosen, and are clustered like any other.  Repeated rows count each; rows that tie for a
first centroid go by their vectors.  With fewer than k vectors there are as many centroids.
An empty table gives no rows.  A distance or sum beyond 64 bits is null.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components up to this size, and the squared distances of as many dims as ``_fits`` allows, are exact in 64 bits.
EXACT = 1 << 27
_LIMB = 40
_COUNT, _INERTIA = -1, -2
_LONG = 1 << 63


def kept_vectors(items: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, v): the vectors with exactly ``dims`` components, none null or not finite."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & finite)


def _integers(batch, dims: int, scale: int) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """(n x dims int64, [(row, its components)] of rows that do not fit there, whose int64 row is zero)."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    large = np.flatnonzero((np.abs(x) > EXACT).any(1))
    rows = []
    for i in large.tolist():
        parts = [v.as_integer_ratio() for v in values[i].tolist()]
        rows.append((i, [n * scale // d for n, d in parts]))
    x[large] = 0
    return x.astype(np.int64), rows


def _fits(centroids: list[list[int]], dims: int) -> bool:
    return 4 * EXACT * EXACT * dims < _LONG and all(abs(c) <= EXACT for row in centroids for c in row)


def _exact(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """(nearest centroid, squared distance) by Python integers."""
    return min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(centroids))[::-1]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, exactly; integers of EXACT at most, ties to the smaller number.

    Any sum of n float32 products is within (n + 8) * 2**-24 * 1.01 of its exact value, relative to the product of the norms:
    n - 1 additions, n products and two conversions, each with an error of 2**-24 at most, and something to spare.
    The float64 steps after it err by less than 2**-50 of the same terms.
    """
    dims = x.shape[1]
    xs, cs = x.astype(np.float64), centroids.astype(np.float64)
    x_norm, c_norm = np.sqrt((xs * xs).sum(1)), np.sqrt((cs * cs).sum(1))
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    near = c_norm * c_norm - 2 * product
    both = x_norm[:, None] * c_norm
    width = 2 * both * ((dims + 8) * 2.0**-24 * 1.01) + (both + c_norm * c_norm) * 2.0**-48
    open_ = near - width <= (near + width).min(1, keepdims=True)
    out = open_.argmax(1)
    doubt = np.flatnonzero(open_.sum(1) > 1)
    for a in range(0, len(doubt), 4096):
        rows = doubt[a : a + 4096]
        far = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        for j in range(len(centroids)):
            some = np.flatnonzero(open_[rows, j])
            gap = x[rows[some]] - centroids[j]
            far[some, j] = (gap * gap).sum(1)
        out[rows] = far.argmin(1)
    return out


def _assigned(batch, centroids: list[list[int]], dims: int, scale: int):
    """(int64 rows, cluster of each row, [(row, components, distance)] of the rows that do not fit)."""
    x, large = _integers(batch, dims, scale)
    if not _fits(centroids, dims):
        seen = dict(large)
        large = [(i, seen.get(i) or x[i].tolist()) for i in range(len(x))]
        x = np.zeros_like(x)
        cluster = np.zeros(len(x), np.int64)
    else:
        cluster = nearest(x, np.array(centroids, np.int64)) if len(x) else np.zeros(0, np.int64)
    found = []
    for i, row in large:
        cluster[i], far = _exact(row, centroids)
        found.append((i, row, far))
    return x, cluster, found


def _distances(x: np.ndarray, cluster: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    gap = x - np.array(centroids, np.int64)[cluster]
    return (gap * gap).sum(1)


def _limbs(value: int):
    at = 0
    while abs(value) >= 1 << _LIMB:
        value, low = divmod(value, 1 << _LIMB)
        yield at, low
        at += 1
    yield at, value


def _totals(centroids: list[list[int]], dims: int, scale: int, inertia: bool):
    """Of each batch: rows (cluster, what, limb, total): counts, sums of each component, and distances if asked for."""

    def run(batches):
        for batch in batches:
            x, cluster, large = _assigned(batch, centroids, dims, scale)
            total: Counter = Counter()
            order = np.argsort(cluster, kind="stable")
            which, first = np.unique(cluster[order], return_index=True)
            if len(which):
                sums = np.add.reduceat(x[order], first)
                for j, n, row in zip(which.tolist(), np.diff(np.append(first, len(order))).tolist(), sums.tolist(), strict=True):
                    total[j, _COUNT, 0] += n
                    for d, s in enumerate(row):
                        total[j, d, 0] += s
            if inertia:
                small = np.ones(len(x), bool)
                small[[i for i, _, _ in large]] = False
                if small.any():
                    far = _distances(x[small], cluster[small], centroids)
                    for j in np.unique(cluster[small]).tolist():
                        for at, low in _limbs(sum(far[cluster[small] == j].tolist())):
                            total[j, _INERTIA, at] += low
            for i, row, far in large:
                for what, value in [*enumerate(row), *([(_INERTIA, far)] if inertia else [])]:
                    for at, low in _limbs(value):
                        total[int(cluster[i]), what, at] += low
            keys = list(total)
            yield pa.record_batch([*[pa.array([k[i] for k in keys], pa.int32()) for i in range(3)], pa.array([total[k] for k in keys], pa.int64())], names=["cluster", "what", "limb", "total"])

    return run


def _summed(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int, inertia: bool = False) -> dict[tuple[int, int], int]:
    """(cluster, what) -> total over all vectors: k * (dims + 2) numbers of some limbs each, whatever the number of vectors."""
    parts = rows.mapInArrow(_totals(centroids, dims, scale, inertia), "cluster int, what int, limb int, total long")
    out: Counter = Counter()
    for r in parts.groupBy("cluster", "what", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.what] += int(r.total) << (_LIMB * r.limb)
    return out


def _final(centroids: list[list[int]], dims: int, scale: int):
    def run(batches):
        for batch in batches:
            x, cluster, large = _assigned(batch, centroids, dims, scale)
            far = _distances(x, cluster, centroids).tolist() if _fits(centroids, dims) else [0] * len(x)
            for i, _, d in large:
                far[i] = d if d < _LONG else None
            yield pa.record_batch([batch.column("key"), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["key", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: str, dims: int, scale: int) -> list[list[int]]:
    """The k vectors with the least sha256 of ``seed:<key>``, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    best = rows.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()
    return [[n * scale // d for n, d in (v.as_integer_ratio() for v in r.v)] for r in best]


def centroid_clusters(items: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256), final centroids) of items (key, vector).

    k * dims numbers are held by the driver and by every task.  Rounds end early where no centroid moves: later ones would change nothing.
    """
    rows = kept_vectors(items, key, vector, dims)
    centroids = first_centroids(rows, k, seed, dims, scale)
    for _ in range(rounds if centroids else 0):
        sums = _summed(rows, centroids, dims, scale)
        new = [[sums[j, d] // sums[j, _COUNT] for d in range(dims)] if sums[j, _COUNT] else c for j, c in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    sums = _summed(rows, centroids, dims, scale, inertia=True) if centroids else Counter()
    inertia = [sums[j, _INERTIA] for j in range(len(centroids))]
    long = lambda n: F.lit(n if n < _LONG else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    names = [F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    found = (rows if centroids else rows.limit(0)).mapInArrow(_final(centroids or [[0] * dims], dims, scale), f"key {rows.schema['key'].dataType.simpleString()}, cluster int, distance long")
    out = found.select(
        F.col("key").alias(key), "cluster", "distance", of([long(n) for n in inertia] or [F.lit(None).cast("long")]).alias("cluster_inertia"),
        long(sum(inertia)).alias("inertia"), of(names or [F.lit(None).cast("string")]).alias("centroid_sha256"),
    )
    return out, centroids


# --- the registered query -------------------------------------------------


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql(k: int = 8, rounds: int = 10) -> str:
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < {k})"""]  # fmt: skip
    gap = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS x FROM (SELECT r, vec_id, v.v, c, {gap} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT x.c AS c, unnest(v) AS e, unnest(range(64)) AS i FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} USING (c))""")
    return f"""WITH {", ".join(steps)},
t AS (SELECT x.c AS c, sum(x.d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, a.x.c::INT AS cluster, a.x.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM t)::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t ON t.c = a.x.c JOIN c{rounds} c ON c.c = a.x.c"""


QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}
ORACLES = {"op13_centroid_clusters": _sql()}
