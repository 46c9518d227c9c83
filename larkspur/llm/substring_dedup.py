"""Removal of repeated word windows by recompression.

Every text is named bottom up (see ``recompression``): runs and pairs of words get symbols,
then runs and pairs of symbols, level by level until one symbol is left.  Names are hashes of
what they stand for, hence global, and copies of a passage have the same symbols inside.

Spark rounds:

1. Symbols of all levels that stand for ``WINDOW`` words or more are exchanged by name.  A
   name that an earlier document has too is a repeat of all its words, which go; the windows
   in such a copy, or in a later copy in the same text, are settled and take no further part.
2. What is left are windows that no shared symbol holds: those of short repeats and of the
   ends of long ones, where symbols differ by their neighbours.  Of the symbols of the first
   level, each that is least in its neighbourhood names the ``GRAM`` words from there;
   copies of a window agree on these but for ``MARGIN`` words at either end, so each window
   holds a name that its copies share.  Names of live windows are exchanged, and those found
   in two documents reveal the windows that may repeat.
3. Only these windows are exchanged, by the hash of their words, and their first document is
   found.

At last each document drops the words of its known symbols, of windows that an earlier
document has, and of windows that it has earlier itself.  The first copy of a window, by
document and place, is never settled, because a copy of the symbol around it would stand
earlier; so no repeat is lost.  A document sends each key once, so no key has more rows than
there are documents, and rows travel packed.

Symbols and windows are compared by 64-bit hashes: n of them have about n * n / 2**65
false matches.

Defined results: a null or blank text has no words and keeps its (empty) hash; documents
with the same doc_id count as one for order, none is earlier than the other; null ids
come last; a text of any length is named and compared as a whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.packed import SCHEMA, by_id, pack, pack_by_id, unpack
from larkspur.llm.recompression import Windows, cover
from larkspur.llm.session import checkpoint, shuffle_partitions
from larkspur.llm.text_hash import U, Words, doc_ngrams, mix, ngrams, slices, utf8

WINDOW = 20
#: Words at each end of a window on which its copies may differ: one of a run, then a symbol of two.
MARGIN = 3
GRAM = 6
#: Neighbourhood of which the least symbol is shared: it and its gram fit into a window less its margins.
REACH = WINDOW - 2 * MARGIN - GRAM + 1
NO_ID = (1 << 63) - 1
_KEY_BYTES = 5
_NEVER = U(0xFFFFFFFFFFFFFFFF)


def first_symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, first word) of the symbols after a round of runs and a round of pairs; symbols stay in their document."""
    n = len(h)
    at = np.arange(n)
    same = np.zeros(n + 1, bool)  # same[i]: word i equals word i - 1
    same[1:n] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    double = same[1:] & ~same[:-1]  # i is a run's first word and i + 1 its second
    double[:-1] &= ~same[2:]
    second = np.append(False, double[:-1])
    name = np.where(double, mix(h * U(3) + U(1)), h)[~second]
    at = at[~second]
    left = (name & U(1)).astype(bool)
    pair = np.zeros(len(name), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (doc[at[1:]] == doc[at[:-1]])
    taken = np.append(False, pair[:-1])
    follow = np.append(name[1:], U(0))
    name = np.where(pair, mix(name * U(5) + follow), name)[~taken]
    return name, at[~taken]


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, keys) of the shared symbols; a key is the hash of the GRAM words from there."""
    h, n = words.hash, len(words.hash)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, U)
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    name, at = first_symbols(h, doc)
    rank = np.full(n, _NEVER)
    rank[at] = mix(name ^ U(0x5851F42D4C957F2D))
    low = np.append(rank, np.full(REACH - 1, _NEVER))
    width = 1
    while width < REACH:  # the least of each REACH positions, from the left one
        step = min(width, REACH - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    high = np.concatenate([np.zeros(REACH - 1, U), low])
    width = 1
    while width < REACH:  # the greatest of these over all neighbourhoods of a position
        step = min(width, REACH - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    whole = np.arange(n) + GRAM <= words.bounds[doc + 1]
    chosen = np.flatnonzero((rank == high[:n]) & (rank != _NEVER) & whole)
    return chosen, ngrams(h, GRAM)[chosen]


def _distinct(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, doc) pairs."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)
    return k[new], d[new]


def _batches(batch: pa.RecordBatch, text: str = "text"):
    """(first row, Words) of slices of a batch's texts."""
    data, offsets = utf8(batch.column(text))
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _send_symbols(window: int, n_buckets: int):
    """Of each document, the names of its symbols of ``window`` words or more."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("k"), np.int64)
            keys, who = [], []
            for a, b, words in _batches(batch):
                name, text = Windows(words, window, [None] * (b - a)).open_names()
                keys.append(name)
                who.append(ids[a:b][text])
            if keys:
                yield pack(np.concatenate(keys), np.concatenate(who), n_buckets)

    return run


def _send_anchors(window: int, n_buckets: int):
    """Of each document, the keys of the anchors that a live window holds."""

    def run(batches):
        for batch in batches:
            ids, known = np.asarray(batch.column("k"), np.int64), batch.column("symbols").to_pylist()
            keys, who = [], []
            for a, b, words in _batches(batch):
                at, key = anchors(words)
                mine = Windows(words, window, known[a:b]).any_live(at + GRAM - window, at)
                k, d = _distinct(key[mine], np.searchsorted(words.bounds, at[mine], "right") - 1)
                keys.append(k)
                who.append(ids[a:b][d])
            if keys:
                yield pack(np.concatenate(keys), np.concatenate(who), n_buckets, _KEY_BYTES)

    return run


def _repeated(n_buckets: int):
    """The keys of a bucket that several documents have, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        k, v = unpack(table, _KEY_BYTES)
        same = np.append(False, k[1:] == k[:-1])
        more = same | np.append(same[1:], False)
        k, v = k[more], v[more]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])) if len(k) else np.zeros(0, bool)
        return pa.Table.from_batches([pack_by_id(k[new], v[new], n_buckets, _KEY_BYTES)])

    return run


def _later(n_buckets: int):
    """The windows of a bucket, dealt by the documents that are not the first to have them."""

    def run(table: pa.Table) -> pa.Table:
        k, v = unpack(table)
        head = np.append(True, k[1:] != k[:-1])
        first = v[np.flatnonzero(head)][np.cumsum(head) - 1]
        return pa.Table.from_batches([pack_by_id(k[v > first], v[v > first], n_buckets)])

    return run


def _by_doc(key_bytes: int):
    """A row for each document of a bucket: all its keys."""

    def run(table: pa.Table) -> pa.Table:
        who, what = by_id(*unpack(table, key_bytes))
        return pa.table({"k": pa.array(who, pa.int64()), "keys": pa.array(what, pa.binary())})

    return run


def _keys_of(keys: bytes | None) -> np.ndarray:
    return np.frombuffer(keys or b"", "<u8")


def _send_windows(window: int, n_buckets: int):
    """Of each document, the distinct live windows around a repeated anchor."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("k"), np.int64)
            lists, known = batch.column("keys").to_pylist(), batch.column("symbols").to_pylist()
            keys, who = [], []
            for a, b, words in _batches(batch):
                at, key = anchors(words)
                live = Windows(words, window, known[a:b]).live
                key = key >> U(64 - 8 * _KEY_BYTES)
                ends = np.searchsorted(at, words.bounds)
                grams, bounds = doc_ngrams(words, window)
                for i in range(b - a):
                    n = bounds[i + 1] - bounds[i]
                    own = slice(ends[i], ends[i + 1])
                    hit = at[own][np.isin(key[own], _keys_of(lists[a + i]))] - words.bounds[i]
                    if n > 0 and len(hit):
                        # windows that hold the whole gram at a hit start from hit + GRAM - window to hit
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, np.clip(hit + GRAM - window, 0, n), 1)
                        np.add.at(edge, np.clip(hit + 1, 0, n), -1)
                        mine = (np.cumsum(edge[:-1]) > 0) & live[words.bounds[i] :][:n]
                        u = np.unique(grams[bounds[i] : bounds[i + 1]][mine])
                        keys.append(u)
                        who.append(np.full(len(u), ids[a + i], np.int64))
            if keys:
                yield pack(np.concatenate(keys), np.concatenate(who), n_buckets)

    return run


def repeated_words(grams: np.ndarray, n_words: int, window: int, later: np.ndarray) -> np.ndarray:
    """Which words of a document stand in windows that it has earlier, or that are in later: those an earlier document has."""
    bad = np.zeros(len(grams), bool)
    order = np.argsort(grams, kind="stable")
    bad[order[1:]] = grams[order[1:]] == grams[order[:-1]]
    if len(later):
        bad |= np.isin(grams, later)
    at = np.flatnonzero(bad)
    return cover(n_words, at, np.full(len(at), window))


def _finish(window: int):
    def run(batches):
        for batch in batches:
            ids, lists, known = (batch.column(c).to_pylist() for c in ("k", "keys", "symbols"))
            n_words, n_removed, sha = [], [], []
            for a, b, words in _batches(batch):
                raw = words.data.tobytes()
                grams, bounds = doc_ngrams(words, window)
                settled = Windows(words, window, known[a:b]).known_words()
                for i in range(b - a):
                    lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                    gone = settled[lo:hi] | repeated_words(grams[bounds[i] : bounds[i + 1]], hi - lo, window, _keys_of(lists[a + i]))
                    kept = np.flatnonzero(~gone) + lo
                    if len(kept) == hi - lo and hi > lo:
                        text = b" ".join(raw[words.start[lo] : words.end[hi - 1]].split())
                    else:
                        text = b" ".join(raw[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True))
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - len(kept))
                    sha.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch(
                [pa.array([None if k == NO_ID else k for k in ids], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs (doc_id, text)."""
    if window < WINDOW:
        raise ValueError(f"the symbols are shared for windows of {WINDOW} words or more")
    n = shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def gathered(sent: DataFrame, found, key_bytes: int) -> DataFrame:
        found = sent.groupBy("bucket").applyInArrow(found(n), SCHEMA)
        return found.groupBy("bucket").applyInArrow(_by_doc(key_bytes), "k long, keys binary")

    symbols = checkpoint(gathered(texts.mapInArrow(_send_symbols(window, n), SCHEMA), _later, 8)).withColumnRenamed("keys", "symbols")
    named = texts.join(symbols, "k", "left")
    shared = gathered(named.mapInArrow(_send_anchors(window, n), SCHEMA), _repeated, _KEY_BYTES)
    later = gathered(named.join(shared, "k").mapInArrow(_send_windows(window, n), SCHEMA), _later, 8)
    return named.join(later, "k", "left").mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


# --- the registered query -------------------------------------------------


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS key FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM t)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY key) AS d, min(i) OVER (PARTITION BY key, r) AS m FROM g) WHERE doc_id > d OR i > m),
gone AS (SELECT DISTINCT r, i + j AS p FROM late, range(0, 20) AS q(j)),
kept AS (
  SELECT t.r, count(gone.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS s
  FROM t, LATERAL (SELECT unnest(t.w) AS word, unnest(range(1, len(t.w) + 1)) AS p) AS x LEFT JOIN gone ON gone.r = t.r AND gone.p = x.p GROUP BY t.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": _SQL}
