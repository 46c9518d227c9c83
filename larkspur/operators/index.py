"""An exact index of vectors: cells around pivots, and bounds that tell which cells can hold a hit.

Some vectors, drawn by the hash of their key, are the pivots; each vector goes to the cell of
its nearest one and keeps its gap to it.  By the triangle inequality (on angles, for the
cosine) a cell's pivot and the range of its gaps bound the score of everything in it.  A
query first looks into the cells nearest to it that hold k vectors together; then only into
those whose bound still beats its k-th best hit.  Pairs of similar vectors are sought in
the cells that their threshold can reach.  Cells and queries meet in blocks of bounded size:
a cell or a cell's queries beyond it are split, so that no bucket, cell or query set has to
fit one task.  Bounds only leave out what cannot be a hit: results are those of a full scan.

Pivots are MOST_PIVOTS at most and travel with the tasks; the directory of cells stays a
table.  A vector that is null, not finite, or of another length than most, is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import vector as V
from larkspur.operators.graph import forest
from larkspur.operators.rounds import checkpoint

MOST_PIVOTS = 4096
#: Vectors, or queries, of a block; at most about HOT_CELLS cells are split, by larger blocks if need be.
BLOCK = 4096
#: Vectors of a block's sides where all pairs of a block are given out, a million at most.
PAIRED = 1024
#: Numbers of a matrix (vectors by pivots) that a task holds at once.
AT_ONCE = 1 << 20
#: Rows of a plan of cells (some 50 bytes each) up to which it is broadcast.
PLAN_ROWS = 100_000
#: What rounding may do to an angle near 0, and to other distances relative to their size.
_ANGLE, _RELATIVE = 1e-6, 1e-9


def rows_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _slices(batches, width: int):
    """Parts of batches whose products with ``width`` pivots are of a bounded size."""
    for batch in batches:
        size = max(1, AT_ONCE // max(1, width))
        yield from (batch.slice(at, size) for at in range(0, batch.num_rows, size))


def _far(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Distances of each x to each y: componentwise differences, no cancellation."""
    out = np.empty((len(x), len(y)))
    for j, row in enumerate(y):
        gap = np.abs(x - row)
        out[:, j] = gap.sum(1) if order == 1 else np.sqrt((gap * gap).sum(1))
    return out


def gaps(metric: str, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What obeys the triangle inequality: angles of units, else distances."""
    if metric == "cosine":
        return np.arccos(np.clip(x @ pivots.T, -1, 1))
    return _far(x, pivots, 1 if metric == "manhattan" else 2)


def scores(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of each x with each y; cosines are of units."""
    if metric in ("cosine", "dot"):
        return x @ y.T
    return _far(y, x, 1 if metric == "manhattan" else 2).T


def best_possible(metric: str, near: Column, length: Column, lo: Column, hi: Column) -> Column:
    """The best score of a query with anything whose gap to the pivot lies in [lo, hi]; near: its own gap, or product, with the pivot."""
    if metric == "dot":
        return near + length * hi + _RELATIVE * (F.abs(near) + length * hi) + 1e-12
    slack = F.lit(_ANGLE) if metric == "cosine" else _RELATIVE * (near + hi) + 1e-12
    least = F.greatest(F.lit(0.0), near - hi - slack, lo - near - slack)
    return F.cos(least) if metric == "cosine" else least


def prepared(df: DataFrame, vector: str, metric: str) -> DataFrame:
    """Units for the cosine, doubles otherwise, in the column v; rows without a finite vector are left out."""
    v = F.col(vector).cast("array<double>")
    rows = df.withColumn("v", V.unit(v) if metric == "cosine" else v)
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


@dataclass
class PivotIndex:
    """placed: (by, key, v, cell, gap); directory: (by, cell, n, lo, hi)."""

    by: list[str]
    metric: str
    dims: int
    pivots: np.ndarray
    rows: DataFrame
    placed: DataFrame
    directory: DataFrame

    @staticmethod
    def build(items: DataFrame, by: list[str], key: str, vector: str, metric: str = "cosine", per_cell: int | None = None) -> PivotIndex:
        """The index of items (by, key, vector); about the square root of a bucket's size of pivots, or one for ``per_cell`` vectors, for all buckets alike."""
        rows = prepared(items.select(*by, F.col(key).alias("key"), vector), vector, metric).select(*by, "key", "v")
        n, buckets, dims = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*by)) if by else F.lit(1), F.mode(F.size("v"), deterministic=True)).first()
        rows = rows.where(F.size("v") == (dims or 0))
        held = n / max(1, buckets)
        m = min(MOST_PIVOTS, ceil(held / per_cell if per_cell else sqrt(held)))
        chosen = rows.orderBy(F.xxhash64("key", *by), "key").select("v").limit(m).collect() if m else []
        pivots = np.unique(np.array([r.v for r in chosen]), axis=0) if chosen else np.zeros((0, dims or 0))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = (rows if len(pivots) else rows.limit(0)).mapInArrow(_placed(metric, pivots), f"{schema}, cell int, gap double")
        directory = checkpoint(placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi")))
        return PivotIndex(by, metric, dims or 0, pivots, rows, placed, directory)

    def _meet(self, left: DataFrame, left_id: str, task, schema: str, block: int | None = None) -> DataFrame:
        """left (by, cell, left_id, v, ...) against all vectors of its cells, block by block: ``task`` gets a block's two tables, of ``block`` rows or so."""
        cell = [*self.by, "cell"]
        plan = left.groupBy(*cell).agg(F.count("*").alias("asks")).join(self.directory.select(*cell, "n"), cell)
        cells, asks, held = plan.agg(F.count("*"), F.sum("asks"), F.sum("n")).first()
        most = [max(min(BLOCK, block or BLOCK), (x or 0) // PLAN_ROWS) for x in (asks, held)]
        plan = plan.select(*cell, *[F.ceil(F.col(c) / x).cast("int").alias(p) for c, x, p in zip(("asks", "n"), most, ("_a", "_b"), strict=True)])
        plan = F.broadcast(plan) if cells <= PLAN_ROWS else plan
        part = lambda c, p: F.pmod(F.xxhash64(c), F.col(p)).cast("int")
        every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
        one = left.join(plan, cell).withColumn("_i", part(left_id, "_a")).withColumn("_j", every("_b")).drop("_a", "_b")
        two = self.placed.join(plan, cell).withColumn("_j", part("key", "_b")).withColumn("_i", every("_a")).drop("_a", "_b", "gap")
        of = [*cell, "_i", "_j"]
        return one.groupBy(*of).cogroup(two.groupBy(*of)).applyInArrow(task, schema)

    def top_k(self, queries: DataFrame, vector: str, k: int, less: bool, threshold: float | None = None, digits: int = 4) -> DataFrame:
        """(query_id, by, key, score): of each query (query_id, by, vector) the k best and all that tie with the last, at least; scores rounded."""
        by, metric, unit = self.by, self.metric, 10.0**-digits
        who = ["query_id", *by]
        asked = prepared(queries.select(*who, vector), vector, metric).where(F.size("v") == self.dims).select(*who, "v")
        kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in who)
        probes = (asked if len(self.pivots) else asked.limit(0)).mapInArrow(_probes(metric, self.pivots), f"{kinds}, cell int, near double, length double")
        probes = probes.join(self.directory, [*by, "cell"])
        bound = best_possible(metric, F.col("near"), F.col("length"), F.col("lo"), F.col("hi"))
        nearest = F.col("near").desc() if metric == "dot" else F.col("near").asc()
        before = F.sum("n").over(W.partitionBy(*who).orderBy(nearest, "cell").rowsBetween(W.unboundedPreceding, -1))
        probes = checkpoint(probes.select(*who, "cell", bound.alias("bound"), (F.coalesce(before, F.lit(0)) < k).alias("first")))
        of = f"{kinds}, `key` {self.rows.schema['key'].dataType.simpleString()}, score double"

        def hits(some: DataFrame) -> DataFrame:
            found = self._meet(some.select(*who, "cell").join(asked, who), "query_id", _best(metric, who, k, less, unit), of)
            return found.withColumn("score", F.round("score", digits))

        order = F.col("score").asc() if less else F.col("score").desc()
        near = checkpoint(hits(probes.where("first")))
        worst = near.withColumn("_n", F.row_number().over(W.partitionBy(*who).orderBy(order, "key"))).where(F.col("_n") == k).select(*who, F.col("score").alias("worst"))
        wanted = F.coalesce(F.col("bound") <= F.col("worst") + unit if less else F.col("bound") >= F.col("worst") - unit, F.lit(True))
        if threshold is not None:
            wanted = wanted & (F.col("bound") <= threshold + unit if less else F.col("bound") >= threshold - unit)
        out = near.unionByName(hits(probes.where("NOT first").join(worst, who, "left").where(wanted)))
        return out if threshold is None else out.where(F.col("score") <= threshold if less else F.col("score") >= threshold)

    def pairs(self, threshold: float, digits: int = 9, linked_only: bool = False) -> DataFrame:
        """(by, a, b, score) for keys a < b of one bucket with a cosine of the threshold at least; cosines rounded.

        linked_only: (by, a, b) that join the same keys into components, fewer than all pairs.
        """
        if self.metric != "cosine":
            raise ValueError("pairs are sought by cosine")
        least = threshold - 10.0**-digits
        reach = acos(min(1.0, max(-1.0, least))) + _ANGLE
        ranges = self.directory.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row a pivot at most
        lo, hi = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        for r in ranges:
            lo[r.cell], hi[r.cell] = r.lo, r.hi
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.schema)
        left = (self.rows if len(self.pivots) else self.rows.limit(0)).mapInArrow(_reaching(self.pivots, lo, hi, reach), f"{kinds}, home int, cell int")
        key = self.rows.schema["key"].dataType.simpleString()
        names = ", ".join(f"`{c}` {self.rows.schema[c].dataType.simpleString()}" for c in self.by)
        schema = f"{names}{', ' if names else ''}a {key}, b {key}, score double, own boolean"
        found = self._meet(left.withColumnRenamed("key", "left_key"), "left_key", _close(self.by, least, linked_only), schema, None if linked_only else PAIRED)
        if linked_only:
            return found.select(*self.by, "a", "b")
        found = found.where("NOT own OR a < b").withColumn("score", F.round("score", digits)).where(F.col("score") >= threshold)
        return found.select(*self.by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def _placed(metric: str, pivots: np.ndarray):
    def run(batches):
        for batch in _slices(batches, len(pivots)):
            gap = gaps(metric, rows_of(batch.column("v")), pivots)
            cell = gap.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap[np.arange(len(gap)), cell])], names=[*batch.schema.names, "cell", "gap"])

    return run


def _probes(metric: str, pivots: np.ndarray):
    """Each query once for each pivot."""

    def run(batches):
        for batch in _slices(batches, len(pivots)):
            x = rows_of(batch.column("v"))
            near = x @ pivots.T if metric == "dot" else gaps(metric, x, pivots)
            at = pa.array(np.repeat(np.arange(len(x)), len(pivots)))
            length = np.repeat(np.sqrt((x * x).sum(1)), len(pivots))
            names = [c for c in batch.schema.names if c != "v"]
            more = [pa.array(np.tile(np.arange(len(pivots)), len(x)), pa.int32()), pa.array(near.ravel()), pa.array(length)]
            yield pa.record_batch([*[batch.column(c).take(at) for c in names], *more], names=[*names, "cell", "near", "length"])

    return run


def _best(metric: str, who: list[str], k: int, less: bool, unit: float):
    """A block's k best for each of its queries, and what may tie with the last of them once rounded."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*who, "key", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([*[left.column(c)[:0] for c in who], right.column("key")[:0], pa.array([], pa.float64())], names=names)
        s = scores(metric, rows_of(left.column("v")), rows_of(right.column("v")))
        bad = s if less else -s
        n = min(k, s.shape[1])
        limit = np.partition(bad, n - 1, axis=1)[:, n - 1 : n]
        i, j = np.nonzero(bad <= limit + unit)
        at, to = pa.array(i), pa.array(j)
        return pa.table([*[left.column(c).take(at) for c in who], right.column("key").take(to), pa.array(s[i, j])], names=names)

    return run


def _reaching(pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: float):
    """Each vector once for its own cell and each later one that may hold a vector within ``reach`` of it.

    A vector of another cell is no nearer than the cell's ranges of gaps allow, nor than half of what its pivot is farther away than the own one.
    """

    def run(batches):
        for batch in _slices(batches, len(pivots)):
            gap = gaps("cosine", rows_of(batch.column("v")), pivots)
            home = gap.argmin(1)
            own = gap[np.arange(len(gap)), home][:, None]
            can = (gap - hi <= reach + _ANGLE) & (lo - gap <= reach + _ANGLE) & ((gap - own) / 2 <= reach + _ANGLE)
            can &= np.arange(len(pivots)) > home[:, None]
            can[np.arange(len(gap)), home] = True
            every, cells = np.nonzero(can)
            for start in range(0, len(every), BLOCK):
                i, cell = every[start : start + BLOCK], cells[start : start + BLOCK]
                yield pa.record_batch([*[c.take(pa.array(i)) for c in batch.columns], pa.array(home[i], pa.int32()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "home", "cell"])

    return run


def _close(by: list[str], least: float, linked_only: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right.schema.field("key").type
        if not left.num_rows or not right.num_rows:
            return pa.table({c: left.column(c)[:0] for c in by} | {"a": pa.nulls(0, key), "b": pa.nulls(0, key), "score": pa.array([], pa.float64()), "own": pa.array([], pa.bool_())})
        a, b, s, own = [], [], [], []
        x, y = rows_of(left.column("v")), rows_of(right.column("v"))
        here = left.column("home").to_numpy() == left.column("cell").to_numpy()
        for start in range(0, len(x), 128):
            near = x[start : start + 128] @ y.T
            i, j = np.nonzero(near >= least)
            p, q = left.column("left_key").take(pa.array(i + start)), right.column("key").take(pa.array(j))
            if linked_only and len(i):
                u, v = forest(p.to_numpy(), q.to_numpy())
                a.append(pa.array(u, key))
                b.append(pa.array(v, key))
            elif len(i):
                a += p.chunks
                b += q.chunks
                s.append(near[i, j])
                own.append(here[i + start])
        a, b = pa.chunked_array(a, key), pa.chunked_array(b, key)
        if linked_only:
            u, v = forest(a.to_numpy(), b.to_numpy()) if len(a) else (a, b)
            a, b, s, own = pa.array(u, key), pa.array(v, key), [np.zeros(len(u))], [np.ones(len(u), bool)]
        s, own = np.concatenate([*s, np.zeros(0)]), np.concatenate([*own, np.zeros(0, bool)])
        return pa.table({c: left.column(c).take(pa.array(np.zeros(len(s), np.int64))) for c in by} | {"a": a, "b": b, "score": pa.array(s), "own": pa.array(own)})

    return run
