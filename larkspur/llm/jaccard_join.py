"""Similarity join of documents on the Jaccard index of their word n-grams.

Documents with the same set of shingles form a class, and classes are joined.  Shingles
are ordered by their hash.  Round one indexes each class by the single shingles of its
prefix; a shingle that few classes have in their prefix gives them as a group.  Round
two takes the classes that have a more frequent shingle in their prefix: their prefixes
are extended and indexed by combinations of two shingles that are neighbours in the
common order, of which linked sets share one.  Groups go through sketches to an exact
comparison of the sets, and links to connected components (see ``links``).

Shingles are 64-bit hashes of their words.  A class is named by a 64-bit hash of its set.

Defined results: a null or blank text has an empty set, is linked with nothing and is a
component by itself; fewer words than a shingle's make one shingle; rows with one doc_id
are told apart by their sets; documents without an id come last, by a hash of their text,
and give a null component if no document with one is in it; a text of any length is
compared in all its words; an empty table gives no rows; other columns are ignored, and
``keep_one`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.keys import KEY, KEY_SCHEMA, key_columns, text_column, text_of, unfolded, whole_rows
from larkspur.llm.links import Bound, bitmap, may_hold, mixed_bitmap, possible, similar_components, sketch, sketch_columns, spread_join, with_both
from larkspur.llm.packed import GROUPS, SMALL, SPREAD, key_groups, pack_spread
from larkspur.llm.session import checkpoint, shuffle_partitions
from larkspur.llm.text_hash import U, Words, doc_ngrams, mix, slices, utf8

_KEY_BYTES = 5
#: Texts whose keys are gathered and sent at once.
_TEXTS = 2500
#: 64-bit words of a set's sketch.
WORDS = 8
SKETCH = sketch_columns(WORDS)


def shingle_sets(batch_column, k: int):
    """(row, sorted distinct hashes) of each text's k-word shingles."""
    data, offsets = utf8(batch_column)
    for a, b in slices(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        grams, bounds = doc_ngrams(words, k)
        for i in range(b - a):
            g = grams[bounds[i] : bounds[i + 1]]
            lo, hi = words.bounds[i], words.bounds[i + 1]
            if len(g) == 0 and hi > lo:  # the whole sequence as one shingle
                g = mix(words.hash[lo:hi] + np.arange(1, hi - lo + 1, dtype=U) * U(0x9E3779B97F4A7C15)).sum(dtype=U, keepdims=True)
            g = np.sort(g)
            yield a + i, g[np.append(True, g[1:] != g[:-1])] if len(g) else g


def set_name(s: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(mix(mix(s).sum(dtype=U, keepdims=True) + U(len(s))).view(np.int64)[0])


def _classes(k: int):
    def run(batches):
        for batch in batches:
            rows = [(i, set_name(s), len(s), sketch(s, WORDS)) for i, s in shingle_sets(batch.column("text"), k) if len(s)]
            if rows:
                at, names, sizes, sketches = zip(*rows, strict=True)
                parity = np.stack(sketches)
                at = pa.array(at)
                cols = [batch.column("late").take(at), batch.column("k").take(at), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(parity[:, j]) for j in range(len(SKETCH))]]
                yield pa.record_batch(cols, names=["late", "k", "id", "n", *SKETCH])

    return run


def _once(batch: pa.RecordBatch, k: int):
    """For each part of a batch, its distinct sets that no part before it has."""
    seen: set[int] = set()
    return (_new(shingle_sets(batch.column("text").slice(at, _TEXTS), k), seen) for at in range(0, batch.num_rows, _TEXTS))


def _new(sets, seen: set[int]):
    for _, s in sets:
        if len(s):
            name = set_name(s)
            if name not in seen:
                seen.add(name)
                yield name, s


def _single(k: int, bound: Bound, n_buckets: int):
    def run(batches):
        for part in (part for batch in batches for part in _once(batch, k)):
            keys, ids = [], []
            for name, s in part:
                keys.append(s[: bound.prefix(len(s))])
                ids.append(np.full(len(keys[-1]), name, np.int64))
            if keys:
                yield pack_spread(mix(np.concatenate(keys)), np.concatenate(ids), n_buckets, _KEY_BYTES)

    return run


def _prefixes(k: int, bound: Bound, wanted):
    """The extended prefix of each class that may be wanted, in 32 bits a shingle."""

    def run(batches):
        for part in (part for batch in batches for part in _once(batch, k)):
            sets = list(part)
            hit = may_hold(wanted.value, np.array([name for name, _ in sets], np.int64))
            rows = [(name, (s[: bound.pair_prefix(len(s))] >> U(32)).astype("<u4").tobytes()) for (name, s), h in zip(sets, hit, strict=True) if h]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "prefix"])

    return run


def _combined(n_buckets: int):
    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for name, prefix in zip(batch.column("id").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                t = np.frombuffer(prefix, "<u4").astype(U)
                keys.append(mix(mix(t[:-1]) + t[1:]))
                ids.append(np.full(len(keys[-1]), name, np.int64))
            if keys:
                yield pack_spread(np.concatenate(keys), np.concatenate(ids), n_buckets, _KEY_BYTES)

    return run


def _own(k: int):
    """Of rows (id, text), those whose text is the class's own, and not another one of its document's id."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            yield batch.filter(pa.array([set_name(s) == ids[i] for i, s in shingle_sets(batch.column("text"), k)], pa.bool_()))

    return run


def _compare(k: int, bound: Bound):
    """The linked pairs among rows (a, b, text_a, text_b)."""

    def run(batches):
        for batch in batches:
            keep = []
            for (_, x), (_, y) in zip(shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k), strict=True):
                keep.append(bound.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def class_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, late, k, component): for each class of docs (doc_id, text) its first document's key and its component's name."""
    bound, n = Bound(num, den), shuffle_partitions(docs.sparkSession)
    texts = docs.select(*key_columns(), text_column().alias("text"))
    parity = ", ".join(f"{s} long" for s in SKETCH)
    rows = texts.mapInArrow(_classes(k), f"{KEY_SCHEMA}, id long, n long, {parity}")
    one = F.min(F.when(~F.col("late"), F.col("k"))), F.min(F.when(F.col("late"), F.col("k")))
    classes = rows.groupBy("id").agg(one[0].alias("k"), one[1].alias("k_late"), *[F.max(c).alias(c) for c in ("n", *SKETCH)])
    classes = checkpoint(classes.withColumn("late", F.col("k").isNull()).withColumn("k", F.coalesce("k", "k_late")).drop("k_late"))
    single = texts.mapInArrow(_single(k, bound, n), SPREAD).groupBy("bucket").applyInArrow(lambda t: key_groups(t, _KEY_BYTES, SMALL), GROUPS)
    single = checkpoint(single.groupBy("lid", "a", "b").agg(F.bool_or("hub").alias("hub")))
    frequent = single.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    extended = texts.mapInArrow(_prefixes(k, bound, mixed_bitmap(frequent, "id")), "id long, prefix binary").join(frequent, "id", "left_semi")
    combined = extended.mapInArrow(_combined(n), SPREAD).groupBy("bucket").applyInArrow(lambda t: key_groups(t, _KEY_BYTES, None), GROUPS)
    found = checkpoint(single.where("b IS NOT NULL").union(combined).groupBy("lid", "a", "b").agg(F.bool_or("hub").alias("hub")))

    def verify(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", *KEY), "id")
        need = checkpoint(need)
        rows = possible(texts, "k", bitmap(need, "k")).join(need, KEY).select("id", "text")
        items = rows.mapInArrow(_own(k), "id long, text string").dropDuplicates(["id"])
        return with_both(pairs, items, "text").mapInArrow(_compare(k, bound), "a long, b long")

    linked = similar_components(found, classes.drop(*KEY), bound, verify)
    return checkpoint(classes.select("id", *KEY).join(linked, "id", "left").select("id", *KEY, F.coalesce("component", "id").alias("component")))


def _firsts(classes: DataFrame) -> DataFrame:
    """(component, late, k, id, n): the first class of each component, and how many it has."""
    least = F.min(F.struct(*KEY, "id")).alias("f")
    return classes.groupBy("component").agg(least, F.count("*").alias("n")).select("component", *[F.col("f").getField(c).alias(c) for c in (*KEY, "id")], "n")


def _names(k: int, text=lambda batch: batch.column("text")):
    """Adds a class's name and its set's size; an empty set is named after its document."""

    def run(batches):
        for batch in batches:
            own = mix(np.asarray(batch.column("k")).view(U) + U(0x27D4EB2F165667C5)).view(np.int64)
            sets = [(set_name(s) if len(s) else int(own[i]), len(s)) for i, s in shingle_sets(text(batch), k)]
            keep = [c for c in batch.schema.names if c != "text"]
            more = [pa.array([s[j] for s in sets], pa.int64()) for j in (0, 1)]
            yield pa.record_batch([*[batch.column(c) for c in keep], *more], names=[*keep, "id", "n"])

    return run


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text): links are num / den similar at least."""
    rows = docs.select(*key_columns(), text_column().alias("text")).mapInArrow(_names(k), f"{KEY_SCHEMA}, id long, n long")
    classes = class_components(docs, k, num, den)
    first = checkpoint(_firsts(classes))
    first_of = F.when(~F.col("first_late"), F.col("first_k"))
    named = spread_join(classes.select("id", "component"), first.select("component", F.col("late").alias("first_late"), F.col("k").alias("first_k")), "component", sizes=first.select("component", "n"))
    own = F.when(~F.col("late"), F.col("k"))
    # The rows of a large class of copies are spread; empty sets have no class and are components by themselves.
    rows = checkpoint(rows)
    linked = spread_join(rows.where("n > 0"), checkpoint(named), "id").select(own.alias("doc_id"), F.col("n").alias("n_shingles"), first_of.alias("component_id"))
    return linked.union(rows.where("n = 0").select(own.alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: that of its first document. Empty texts stay, one for each doc_id.

    The rows meet the verdicts by document and set, so that no large class meets in one task.
    """
    rows = whole_rows(docs).mapInArrow(_names(k, text_of), whole_rows(docs).withColumns({"id": F.lit(0).cast("long"), "n": F.lit(0).cast("long")}).schema)
    keep = _firsts(class_components(docs, k, num, den)).select(*KEY, "id", F.lit(True).alias("keep"))
    rows = rows.join(keep, [*KEY, "id"], "left").where("keep OR n = 0").dropDuplicates([*KEY, "id"])
    return unfolded(rows, docs)


# --- the registered query -------------------------------------------------


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT r, hash(array_to_string(w[i:i + 2], ' ')) AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT r, r AS q FROM t UNION SELECT reach.r, y FROM reach JOIN both_ways ON q = x)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(d.doc_id) AS component_id
FROM t LEFT JOIN n USING (r) JOIN reach USING (r) JOIN t d ON d.r = reach.q GROUP BY t.r, t.doc_id
"""

QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {"op10_jaccard_join": _SQL}
