"""Connected components of any size and shape: alternating stars over written rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.rounds import Rounds, checkpoint, spread_join

#: Edges that a task joins at once.
_AT_ONCE = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (u, v) as stars: each id but the least of its tree, with that least one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        if np.array_equal(root[a], root[b]):
            break
        for x in (a, b):
            np.minimum.at(root, root[x], low)
        while not np.array_equal(root[root], root):
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def _stars(batches):
    """What a partition's edges join, as stars; some hundred thousand edges at a time."""

    def joined(held):
        u, v = forest(*(np.concatenate([np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for b in held]) for c in "uv"))
        return pa.record_batch([pa.array(u, held[0].schema.field("u").type), pa.array(v, held[0].schema.field("v").type)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _AT_ONCE:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def _star_shaped(e: DataFrame) -> bool:
    """Each id of the edges (u, v), u > v, either has one least id or is one: then they are the components."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) with the least id reachable, for every id of edges (a, b); edges with a null end are left out.

    A round hands the greater neighbours of each id to the least of its neighbours, then the lesser ones, which takes a number of rounds that
    grows with the logarithm of the longest chain; each task first joins what it holds.  The neighbours of an id with many are dealt
    to several tasks.
    """
    kind = edges.schema["a"].dataType.simpleString()
    whole = edges.where("a IS NOT NULL AND b IS NOT NULL")
    starred = lambda df: df.mapInArrow(_stars, f"u {kind}, v {kind}").distinct()
    with Rounds(edges.sparkSession) as rounds:
        e = rounds.write(starred(whole.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
        few = e.count() <= _AT_ONCE
        if few:  # one task joins them all at once
            e = rounds.write(e.coalesce(1).mapInArrow(_stars, f"u {kind}, v {kind}"))
        while not few and not _star_shaped(e):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
            up = spread_join(both.where("v > u"), least.select("u", "m"), ["u"], least, e.count(), "v")
            large = rounds.write(up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            down = spread_join(large, least.select("u", "m"), ["u"], least, large.count(), "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = rounds.write(starred(down.union(least.select("u", F.col("m").alias("v")))))
            rounds.forget(1)
        roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).union(whole.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")))
        return checkpoint(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).groupBy("id").agg(F.min("component").alias("component")))
