"""Vector Columns over array<float|double>: higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """zero vectors have similarity 0."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-12, 0.0).otherwise(dot(a, b) / n)


def let(value: Column, body) -> Column:
    """body of a value that is computed once a row: an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays zero. Cosines of units are plain dot products."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n < 1e-12, 0.0).otherwise(x.cast("double") / n))))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


#: F32: aliases, the function and whether less is nearer.
DISTANCES = {"cosine": (cosine, False), "cos": (cosine, False), "dot": (dot, False), "dotproduct": (dot, False), "euclid": (euclid, True), "euclidean": (euclid, True), "l2": (euclid, True), "manhattan": (manhattan, True), "l1": (manhattan, True)}


def distance(name: str | None):
    """(function, less is nearer); unknown names mean cosine."""
    return DISTANCES.get((name or "").strip().lower(), (cosine, False))


def distance_name(name: str | None) -> tuple[str, bool]:
    """The name without aliases, and whether less is nearer."""
    function, less = distance(name)
    return next(n for n in ("cosine", "dot", "euclid", "manhattan") if DISTANCES[n][0] is function), less


def hash_embedding(terms: Column, dim: int = 64) -> Column:
    """The deterministic default embedder: md5 of each term picks its place, weights are counts, length is 1."""
    places = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim)
    return let(places, lambda p: unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double"))))


def lexical_score(q: Column, d: Column) -> Column:
    """sum of products over the common keys of two map<int, float>."""
    return F.aggregate(F.map_entries(q), F.lit(0.0), lambda a, e: a + e["value"].cast("double") * F.coalesce(F.element_at(d, e["key"]).cast("double"), F.lit(0.0)))
