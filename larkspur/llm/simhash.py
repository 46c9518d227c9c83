"""Near copies by SimHash fingerprints a few bits apart, all links found.

A document's fingerprint has a bit where more than half of its shingles' XXH64 hashes have
it.  Fingerprints are joined once each, however many documents share one.  A fingerprint is
embedded as its bit counts in SEGMENTS equal segments: the Manhattan distance of two such
points is at most the number of bits in which the fingerprints differ.  Points within 2 of
each other have a lattice point within 1 of both, so each point goes to its own cell of the
grid and to the neighbours at distance 1, and points that meet in a cell are compared bit
by bit.

Cells around a point with more than DENSE fingerprints are refined: there the grid has
segments of one bit, in which a cell is a fingerprint, meets at most 65 others, and the
distance is exact.  A cell that is not refined has at most DENSE fingerprints of each of 33
points.  Which cells to refine is a property of the cell, so that both ends of a link agree
on where they meet.  The list of them is a bitmap of at most 8 MB; the cells that a full
bitmap refines needlessly cost some more rows and lose nothing.

Defined results: a null or blank text has fingerprint zero, which is linked like any other;
fewer words than a shingle's make one shingle; a text of any length is read in all its
words; a repeated row is a document of its own; documents without an id come last, by a
hash of their text, and give a null component if no document with one is in it; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.keys import KEY, KEY_SCHEMA, key_columns, text_column
from larkspur.llm.links import _contract, connected_components, may_hold, mixed_bitmap, spread_join
from larkspur.llm.session import checkpoint, shuffle_partitions
from larkspur.llm.text_hash import U, mix

SEED = 42
SEGMENTS = 16
_WIDTH = 64 // SEGMENTS
#: Fingerprints of one point above which the cells around it are refined.
DENSE = 16
#: Shingles of a text that are hashed before their bits are counted.
_PART = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FINE = U(0xD1B54A32D192ED03)
_STEPS = U(1) << (np.arange(SEGMENTS, dtype=U) * U(_WIDTH))
_BITS = U(1) << np.arange(64, dtype=U)


def fingerprint(text: str | None, n: int) -> int:
    """The 64 bits as a number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - n + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, total, _PART):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(a, min(total, a + _PART))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(n: int):
    def run(batches):
        for batch in batches:
            f = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column("text")), U, batch.num_rows)
            yield pa.record_batch([batch.column("late"), batch.column("k"), pa.array(f.view(np.int64))], names=["late", "k", "f"])

    return run


def points(f: np.ndarray) -> np.ndarray:
    """The bit counts of each segment, _WIDTH bits a count: counts go up to 4 of 15."""
    x = f - ((f >> U(1)) & U(0x5555555555555555))
    return (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))


def cells(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, exists), n x 33 each: the point, then each segment's next greater and next lesser count."""
    count = (p[:, None] >> (np.arange(SEGMENTS, dtype=U) * U(_WIDTH))) & U(15)
    at = np.concatenate([p[:, None], p[:, None] + _STEPS, p[:, None] - _STEPS], 1)
    return at, np.concatenate([np.ones((len(p), 1), bool), count < _WIDTH, count > 0], 1)


def _points(batches):
    for batch in batches:
        p, n = np.unique(points(np.asarray(batch.column("f"), np.int64).view(U)), return_counts=True)
        yield pa.record_batch([pa.array(p.view(np.int64)), pa.array(n)], names=["p", "n"])


def _around(batches):
    """The names of the cells around points."""
    for batch in batches:
        at, exists = cells(np.asarray(batch.column("p"), np.int64).view(U))
        yield pa.record_batch([pa.array(mix(at[exists]).view(np.int64))], names=["cell"])


def meeting_places(f: np.ndarray, dense: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(names, fingerprints): the cells where each fingerprint meets others; ``dense``: the bitmap of the refined ones."""
    at, exists = cells(points(f))
    names = mix(at)
    fine = may_hold(dense, names.view(np.int64).ravel()).reshape(names.shape) & exists if dense is not None else np.zeros(names.shape, bool)
    coarse = exists & ~fine
    row = np.nonzero(coarse)[0]
    out, who = [names[coarse]], [f[row]]
    some = np.flatnonzero(fine.any(1))
    if len(some):
        g = f[some]
        # a flipped bit moves the point to the next greater or lesser count of its segment
        to = 1 + np.arange(64) // _WIDTH + np.where(g[:, None] & _BITS != 0, SEGMENTS, 0)
        here, flip = fine[some, 0], np.take_along_axis(fine[some], to, 1)
        row = np.nonzero(flip)[0]
        out += [mix(g[here] ^ _FINE), mix((g[:, None] ^ _BITS)[flip] ^ _FINE)]
        who += [g[here], g[row]]
    return np.concatenate(out), np.concatenate(who)


def _meet(dense):
    def run(batches):
        for batch in batches:
            f = np.asarray(batch.column("f"), np.int64).view(U)
            for a in range(0, len(f), 2048):
                names, who = meeting_places(f[a : a + 2048], dense.value if dense else None)
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(who.view(np.int64))], names=["cell", "f"])

    return run


def _compare(cell: np.ndarray, f: np.ndarray, distance: int):
    """Stars (u, v) that join what is linked within the cells of sorted rows."""
    same = np.flatnonzero(np.append(cell[1:] == cell[:-1], False))
    u, v, lag = [], [], 1
    while len(same):
        a, b = f[same], f[same + lag]
        near = np.bitwise_count(a ^ b) <= distance
        u.append(a[near].view(np.int64))
        v.append(b[near].view(np.int64))
        lag += 1
        same = same[same + lag < len(cell)]
        same = same[cell[same + lag] == cell[same]]
    if u:
        u, v = np.concatenate(u), np.concatenate(v)
        yield from _contract([pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])])


def _linked(distance: int):
    """Of rows sorted by cell: the links; the rows of a cell that a batch cuts wait for the next one."""

    def run(batches):
        cell, f = np.zeros(0, np.int64), np.zeros(0, U)
        for batch in batches:
            cell = np.append(cell, np.asarray(batch.column("cell"), np.int64))
            f = np.append(f, np.asarray(batch.column("f"), np.int64).view(U))
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            yield from _compare(cell[:whole], f[:whole], distance)
            cell, f = cell[whole:], f[whole:]
        yield from _compare(cell, f, distance)

    return run


def fingerprint_components(fingerprints: DataFrame, distance: int = 2) -> DataFrame:
    """(id, component), the least id reachable, for every fingerprint of f (long, distinct) that has a link; f is read several times."""
    if distance not in (1, 2):
        raise ValueError("cells meet fingerprints 1 or 2 bits apart")
    dense = fingerprints.select("f").mapInArrow(_points, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > DENSE)
    around = checkpoint(dense.select("p").mapInArrow(_around, "cell long").distinct())
    refined = None if around.isEmpty() else mixed_bitmap(around, "cell")
    rows = fingerprints.select("f").mapInArrow(_meet(refined), "cell long, f long")
    rows = rows.repartition(shuffle_partitions(fingerprints.sparkSession), "cell").sortWithinPartitions("cell")
    edges = rows.mapInArrow(_linked(distance), "u long, v long")
    return connected_components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))


def simhash_components(docs: DataFrame, n: int = 5, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id for every row of docs (doc_id, text): n-word shingles, links at ``distance`` bits at most."""
    texts = docs.select(*key_columns(), text_column().alias("text"))
    rows = checkpoint(texts.mapInArrow(_fingerprints(n), f"{KEY_SCHEMA}, f long"))
    first = F.min(F.struct(*KEY)).alias("first")
    distinct = checkpoint(rows.groupBy("f").agg(first, F.count("*").alias("n")))
    linked = fingerprint_components(distinct, distance).withColumnRenamed("id", "f")
    named = checkpoint(distinct.join(linked, "f", "left").withColumn("component", F.coalesce("component", "f")))
    least = checkpoint(named.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    of = checkpoint(spread_join(named.select("f", "n", "component"), least.select("component", "least"), "component", sizes=least.select("component", "n")))
    out = spread_join(rows, of.select("f", "least"), "f", sizes=of.select("f", "n"))
    own = lambda late, k: F.when(~late, k)
    return out.select(
        own(F.col("late"), F.col("k")).alias("doc_id"), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), own(F.col("least.late"), F.col("least.k")).alias("component_id")
    )


# --- the registered query -------------------------------------------------


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, distance=2)


QUERIES = {"op12_simhash": op12_simhash}
#: XXH64 has no SQL form; tests/llm compares with all pairs.
ORACLES: dict = {}
