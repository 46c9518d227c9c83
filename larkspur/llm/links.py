"""From groups of items that may be similar to the components of those that are.

Items are distinct sets (of shingles) named by 64-bit ids, with a size and a parity
sketch of some hundred bits: the sets of two items differ in at least as many elements
as their sketches differ in bits, so a pair whose sketches differ too much is dropped
without loss.  In a small group each item is first compared with the least one, in the
parts of a large group with hubs, the least items of those still alone; their links are
verified and joined into components.  Then, round by round, only pairs across components
are looked at, the nearest few of each two components: a large group that is one component
by now is done, and of any other only the items outside its largest component are dealt
out against all, block by block.  Rounds end when no pair across components is left
untested.  No step emits all pairs of a group, and no join brings all rows of a frequent
key to one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.packed import BLOCK
from larkspur.llm.session import Scratch, checkpoint, shuffle_partitions

#: Frequent keys are split once they have more than this and one HOT_SHARE-th of all rows.
SPLIT = 1024
HOT_SHARE = 4096
#: So many edges, 1 MB of them, are joined by one task; more of them in rounds.
ALONE = 1 << 16


def sketch_columns(words: int) -> list[str]:
    return [f"s{i}" for i in range(words)]


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity of the distinct hashes of one set over 64 * words bits; words is a power of two."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame | None = None, total: int | None = None, by: str | None = None) -> DataFrame:
    """left joined with right, which has one row a key; a key with many left rows is met in several tasks.

    sizes: (key, n), the left rows of each key; total: all of them; both are counted here if not given.
    At most HOT_SHARE keys can have more than one HOT_SHARE-th of the rows, so that the broadcast list of split keys is small.
    by: a column of left by which rows of one key are split, else all.
    """
    total = left.count() if total is None else total
    if total <= 16 * SPLIT:
        return left.join(right, key)
    most = max(SPLIT, total // HOT_SHARE)
    sizes = left.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int").alias("_parts")
    hot = sizes.where(F.col("n") > most).select(key, parts)
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(checkpoint(hot))
    salt = F.pmod(F.xxhash64(*([by] if by else [c for c in left.columns if c != key])), F.coalesce("_parts", F.lit(1))).cast("int")
    many = left.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    one = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return many.join(one, [key, "_salt"]).drop("_salt")


def with_both(pairs: DataFrame, items: DataFrame, what: str) -> DataFrame:
    """Pairs (a, b) with the column ``what`` of both their items (id, what); an item of many pairs is met in several tasks."""
    total, out = pairs.count(), pairs
    for x, y in (("a", "b"), ("b", "a")):
        one = items.select(F.col("id").alias(x), F.col(what).alias(f"{what}_{x}"))
        out = spread_join(out, one, x, pairs.groupBy(x).agg(F.count("*").alias("n")), total, by=y)
    return out.select("a", "b", f"{what}_a", f"{what}_b")


def _contract(batches):
    """The edges (u, v) of a partition as stars: each node with the least it reaches there."""
    parts = [(np.asarray(b.column("u"), np.int64), np.asarray(b.column("v"), np.int64)) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        for i in range(0, len(moved), 1 << 16):
            some = moved[i : i + (1 << 16)]
            yield pa.record_batch([pa.array(ids[some]), pa.array(ids[label[some]])], names=["u", "v"])


def _are_stars(e: DataFrame) -> bool:
    """Whether each node of the edges (u, v), u > v, has one least node and that one none: then they are components."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("low")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("low")))
    return ends.groupBy("id").agg(F.sum("low").alias("lows"), F.count("*").alias("n")).where("lows > 0 AND n > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component), the least id reachable, for every id of edges (a, b).

    Alternating stars, written each round.  Each partition first joins what it holds by itself, so that few edges and
    few rounds are left.  Once no more than ALONE are left, one partition holds them all and is done.
    """
    with Scratch(edges.sparkSession) as files:
        e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        e = files.written(e.mapInArrow(_contract, "u long, v long").distinct())
        while True:
            if e.count() <= ALONE:
                e = files.written(e.coalesce(1).mapInArrow(_contract, "u long, v long"))
                break
            if _are_stars(e):
                break
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            stats = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
            large = spread_join(both.where("v > u"), stats.select("u", "m"), "u", sizes=stats.select("u", "n"))
            large = files.written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
            stats = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = spread_join(large, stats.select("u", "m"), "u", sizes=stats.select("u", "n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = small.union(stats.select("u", F.col("m").alias("v")))
            e = files.written(e.mapInArrow(_contract, "u long, v long").distinct())
            files.drop_before(files.n - 1)
        return checkpoint(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def _bits(keys: DataFrame, h, most_bits: int):
    n = max(1, keys.count())
    words = min(most_bits, 1 << max(10, (16 * n - 1).bit_length())) // 64
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 56).bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(F.pmod(h, F.lit(words)).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, np.int64)
    out[np.asarray(rows.column("w"), np.int64)] = np.asarray(rows.column("b"), np.int64)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def bitmap(keys: DataFrame, column: str, most_bits: int = 1 << 26):
    """A broadcast bitmap of hashed keys, 16 bits a key up to ``most_bits``: 8 MB at most, whatever the number of keys."""
    return _bits(keys, F.xxhash64(column), most_bits)


def mixed_bitmap(keys: DataFrame, column: str, most_bits: int = 1 << 26):
    """Like ``bitmap`` for ids that are well mixed hashes themselves; ``may_hold`` asks it inside a task."""
    return _bits(keys, F.col(column), most_bits)


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (table[ids % len(table)] >> (ids.view(np.uint64) >> np.uint64(56) & np.uint64(63)) & np.uint64(1)).astype(bool)


def possible(rows: DataFrame, column: str, found) -> DataFrame:
    """The rows whose key may be in a bitmap, before they are shuffled to meet the keys themselves."""
    h, names = F.xxhash64(column), rows.columns

    def run(batches):
        table = found.value
        for batch in batches:
            hit = table[np.asarray(batch.column("_w"), np.int64)] >> np.asarray(batch.column("_b"), np.int64).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(names)

    marked = rows.select("*", F.pmod(h, F.lit(len(found.value))).alias("_w"), F.shiftrightunsigned(h, 56).bitwiseAND(F.lit(63)).alias("_b"))
    return marked.mapInArrow(run, rows.schema)


class Bound:
    """Jaccard similarity of num / den at least, and what follows from it; whole numbers only."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        """Linked sets share one of the first so many elements in any common order."""
        return n - -(-self.num * n // self.den) + 1

    def pair_prefix(self, n: int) -> int:
        """Linked sets share two elements that are neighbours in both of their first so many.

        Sets that differ in d elements share d + 2 of the first n - least overlap + d + 2; d elements cannot part d + 1 neighbours.
        """
        return min(n, self.prefix(n) - 1 + n * (self.den - self.num) // self.num + 2)

    def linked(self, inter: int, na: int, nb: int) -> bool:
        return self.den * inter >= self.num * (na + nb - inter)

    def may(self, apart, na, nb):
        """Arrays or Columns alike: sizes and the sketches' distance allow a link."""
        return (apart * (self.den + self.num) <= (na + nb) * (self.den - self.num)) & (na * self.num <= nb * self.den) & (nb * self.num <= na * self.den)


def _groups(table: pa.Table, names: list[str]):
    """Arrays of each group g of a bucket, by id."""
    sketches = [c for c in table.column_names if c[0] == "s" and c[1:].isdigit()]
    g, ids = (np.asarray(table.column(x), np.int64) for x in ("g", "id"))
    order = np.lexsort((ids, g))
    cols = {x: np.asarray(table.column(x), np.int64)[order] for x in ["g", "id", "n", *names]}
    cols["s"] = np.stack([np.asarray(table.column(x), np.int64)[order] for x in sketches], 1).view(np.uint64)
    cuts = np.flatnonzero(np.append(True, cols["g"][1:] != cols["g"][:-1])) if len(g) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(g)), strict=True):
        yield {k: v[a:b] for k, v in cols.items()}


def _apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64)


def _pairs(a, b) -> pa.Table:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _stars(bound: Bound):
    def run(table: pa.Table) -> pa.Table:
        left, right = [], []
        for x in _groups(table, []):
            alone = np.arange(len(x["id"]))
            while len(alone) > 1:
                hub, rest = alone[0], alone[1:]
                near = bound.may(_apart(x["s"][hub], x["s"][rest]), x["n"][hub], x["n"][rest])
                left.append(np.full(int(near.sum()), x["id"][hub]))
                right.append(x["id"][rest[near]])
                alone = rest[~near]
        return _pairs(left, right)

    return run


def _firsts(keys: tuple[np.ndarray, ...], by: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` least rows, by ``by``, of each combination of keys."""
    order = np.lexsort((by, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < most]


def _across(bound: Bound, most: int):
    """Pairs of different components that may be linked: the ``most`` nearest of each two components; ``cut`` if there were more."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for x in _groups(table, ["component", "outside", "right"]):
            c, found = x["component"], []
            right = np.flatnonzero(x["right"])
            for i in np.flatnonzero(x["right"] == 0):
                # two items outside the largest component meet on both sides, and count once
                near = right[(c[right] != c[i]) & ((x["outside"][right] == 0) | (x["id"][right] > x["id"][i]))]
                apart = _apart(x["s"][i], x["s"][near])
                fits = bound.may(apart, x["n"][i], x["n"][near])
                near, apart = near[fits], apart[fits]
                pick = _firsts((c[near],), apart, most + 1)
                near, apart = near[pick], apart[pick]
                found.append(np.stack([np.minimum(c[i], c[near]), np.maximum(c[i], c[near]), apart, np.full(len(near), x["id"][i]), x["id"][near]]))
            if found:
                rows = np.concatenate(found, 1)
                keys = (rows[0], rows[1])
                kept, wider = _firsts(keys, rows[2], most), _firsts(keys, rows[2], most + 1)
                out.append((rows[3][kept], rows[4][kept], np.full(len(kept), len(wider) > len(kept))))
        a, b, cut = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "cut": cut})

    return run


def _dealt(large: DataFrame, known: DataFrame, n_buckets: int):
    """The large groups of several components, dealt out: items outside the largest component against all of their group."""
    rows = checkpoint(large.select("lid", "id").distinct().join(known.select("id", "component"), "id"))
    parts = rows.groupBy("lid", "component").agg(F.count("*").alias("n"))
    shape = parts.groupBy("lid").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))
    shape = checkpoint(shape.where("others > 0"))
    sides = [F.ceil(F.col(c) / F.lit(BLOCK)).cast("int").alias(to) for c, to in (("others", "outer"), ("n", "all"))]
    rows = spread_join(rows, shape.select("lid", "main", *sides), "lid", sizes=shape.select("lid", "n"))
    block = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.withColumn("outside", (F.col("component") != F.col("main")).cast("long"))
    left = rows.where("outside = 1").select("id", "lid", "outside", block(1, "outer").alias("i"), every("all").alias("j"), F.lit(0).cast("long").alias("right"))
    right = rows.select("id", "lid", "outside", every("outer").alias("i"), block(2, "all").alias("j"), F.lit(1).cast("long").alias("right"))
    dealt = left.union(right).select("id", "outside", "right", F.xxhash64("lid", "i", "j").alias("g")).join(known, "id")
    return dealt.groupBy(F.pmod(F.xxhash64("g"), F.lit(n_buckets)).alias("bucket"))


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after some more links (a, b): only those that the links join are looked at."""
    for x in "ab":
        links = links.join(components.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    ends = checkpoint(links.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    merged = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("component")), F.struct(F.col("b").alias("id"), F.col("cb").alias("component")))).alias("x")).select("x.*").distinct()
    known = components.union(new.join(components, "id", "left_anti"))
    moved = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
    new_name = checkpoint(known.groupBy("component").agg(F.count("*").alias("n")).join(moved, "component", "left").select("component", "n", F.coalesce("to", "component").alias("to")))
    named = spread_join(known, new_name.select("component", "to"), "component", sizes=new_name.select("component", "n"))
    return checkpoint(named.select("id", F.col("to").alias("component")))


def similar_components(found: DataFrame, attrs: DataFrame, bound: Bound, verify: Callable[[DataFrame], DataFrame], doubtful: bool = True) -> DataFrame:
    """(id, component) of the linked items.

    found: (lid, a, b, hub) as ``key_groups`` gives them, once each; any linked pair is one of its pairs or in one of its lists.
    attrs: (id, n, s0, s1, ...), of the lists' items at least.  Both are read several times.  verify keeps the linked
    pairs of a DataFrame (a, b).  doubtful: most of found's pairs are not linked, so that all of them are held against
    the sketches first, for which attrs must know all items.
    """
    spark = found.sparkSession
    n_buckets = 4 * shuffle_partitions(spark)
    pairs = found.where("lid IS NULL AND b IS NOT NULL").select("a", "b", "hub")
    if doubtful:
        one, two = attrs.select([F.col(c).alias(f"{c}_a") for c in attrs.columns]), attrs.select([F.col(c).alias(f"{c}_b") for c in attrs.columns])
        sketches = [c for c in attrs.columns if c not in ("id", "n")]
        apart = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in sketches), F.lit(0))
        sized = pairs.join(one, pairs["a"] == one["id_a"]).join(two, pairs["b"] == two["id_b"])
        pairs = checkpoint(sized.where(bound.may(apart, F.col("n_a"), F.col("n_b"))).select("a", "b", "hub"))
    large = checkpoint(found.where("lid IS NOT NULL").select("lid", F.col("a").alias("id"), F.col("b").alias("part")))
    tested = pairs.where("hub").select("a", "b")
    some_large = not large.isEmpty()
    if some_large:
        blocks = large.select("id", F.xxhash64("lid", "part").alias("g")).distinct().join(attrs, "id")
        tested = tested.union(blocks.groupBy(F.pmod(F.xxhash64("g"), F.lit(n_buckets)).alias("bucket")).applyInArrow(_stars(bound), "a long, b long"))
    tested = checkpoint(tested.distinct())
    components, most = connected_components(checkpoint(verify(tested))), 4
    while True:
        ends = [components.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
        rest = pairs.where("NOT hub").join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b", F.lit(False).alias("cut"))
        if some_large:
            labelled = attrs.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
            rest = _dealt(large, labelled, n_buckets).applyInArrow(_across(bound, most), "a long, b long, cut boolean").union(rest)
        rest = rest.groupBy("a", "b").agg(F.bool_or("cut").alias("cut"))
        rest = checkpoint(rest.join(tested.withColumn("old", F.lit(True)), ["a", "b"], "left"))
        n, cut = rest.agg(F.count_if(F.col("old").isNull()), F.bool_or("cut")).first()
        if not n and not cut:
            return components
        rest = rest.where("old IS NULL").select("a", "b")
        most *= 256
        if n:
            more = checkpoint(verify(rest))
            if more.isEmpty() and not cut:
                return components
            tested = checkpoint(tested.union(rest))
            components = _joined(components, more)
