"""Quality scores from supervised subword embeddings.

A text's features are its words, the runs of 3 and 5 bytes in it and, for each word that
equals the one 1, 2 or 3 places before it, a sign of that; all are hashed into
``BUCKETS`` vectors.  The vectors are averaged over the text and go to a softmax output;
vectors and output are learned together by stochastic gradient descent in numpy, on the
driver, from at most ``PER_CLASS`` labelled doc_ids a class (those with the least hash),
of each the text with the least hash, whose features, not texts, come there.  Scoring reads every whole text in
tasks: as the output is linear in the average, a feature's part of the log-odds is one
number, and a table of ``BUCKETS`` numbers is all that is broadcast.

Only the text enters a score.  Rows with crc32(doc_id) mod 3 = 1 are held out.

Defined results: null and empty texts get the score of a text without features; a null
doc_id counts as an empty string and is not held out; without usable labels of both
classes every score is 0.5; repeated rows score alike; a text of any length is scored by
all its words; an empty table gives no rows; other columns, of either table, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text_hash import U, Words, mix, slices, utf8

BUCKETS = 1 << 17
DIM = 8
PER_CLASS = 1500
EPOCHS, RATE = 6, 4.0


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature): words, repeats, byte runs."""
    words = Words(data, offsets)
    texts = np.arange(len(offsets) - 1)
    ids, who = [words.hash], [np.repeat(texts, np.diff(words.bounds))]
    for lag in (1, 2, 3):
        again = np.flatnonzero(words.hash[lag:] == words.hash[:-lag]) + lag
        again = again[who[0][again] == who[0][again - lag]]
        ids.append(np.full(len(again), mix(np.array([lag], U))[0]))
        who.append(who[0][again])
    n = len(data)
    owner = np.repeat(texts, np.diff(offsets))
    for size in (3, 5):
        if n >= size:
            h = np.zeros(n - size + 1, U)
            for i in range(size):
                h |= data[i : n - size + 1 + i].astype(U) << U(8 * i)
            same = owner[size - 1 :] == owner[: n - size + 1]
            ids.append((h[same] + U(size)) * U(0x9E3779B97F4A7C15))
            who.append(owner[: n - size + 1][same])
    bucket = np.concatenate([(h >> U(44)).astype(np.int64) & (BUCKETS - 1) for h in ids])
    return bucket, np.concatenate(who)


def _histograms(batches):
    """The features of each text and how often it has them; of a doc_id's like rows in one task only the first is read."""
    seen = set()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        batch = batch.take(pa.array([i for i, d in enumerate(ids) if not (d in seen or seen.add(d))], pa.int64()))
        data, offsets = utf8(batch.column("text"))
        label, key, count = batch.column("quality"), [], []
        for a, b in slices(offsets, 300_000):
            f, who = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                u, c = np.unique(f[who == i], return_counts=True)
                key.append(u.astype(np.int32).tobytes())
                count.append(c.astype(np.float32).tobytes())
        yield pa.record_batch([batch.column("doc_id"), label, pa.array(key, pa.binary()), pa.array(count, pa.binary())], names=["doc_id", "quality", "keys", "counts"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(log-odds of each bucket, log-odds of no features) from rows (label, buckets, counts)."""
    if len({r[0] for r in rows}) < 2:
        return np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount([r[0] for r in rows], minlength=2) / len(rows)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, keys, counts = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(keys):
                continue
            w = counts / counts.sum()
            v = vectors[keys]
            x = w @ v
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / share[y]  # classes count alike
            back = out @ p
            out -= 0.1 * rate * np.outer(x, p)
            bias -= 0.01 * rate * p
            vectors[keys] = v - rate * np.outer(w, back)
    odds = out[:, 1] - out[:, 0]
    return vectors.astype(np.float64) @ odds.astype(np.float64), float(bias[1] - bias[0])


def _score(table):
    def run(batches):
        odds, none = table.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            total = np.zeros(len(offsets) - 1)
            for a, b in slices(offsets, 300_000):
                f, who = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(who, minlength=b - a)
                total[a:b] = np.bincount(who, odds[f], b - a) / np.maximum(n, 1)
            score = 1 / (1 + np.exp(-(total + none)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def held_out():
    """Whether a row is never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = [rows.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    least = texts.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("h").alias("h"))
    found = texts.join(F.broadcast(least), ["doc_id", "h"]).select("doc_id", "quality", "text").mapInArrow(_histograms, "doc_id long, quality int, keys binary, counts binary")
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct("keys", "counts")).alias("f"))  # like rows of other tasks
    data = sorted((r["quality"], bytes(r["f"]["keys"]), bytes(r["f"]["counts"])) for r in one.collect())
    return train([(y, np.frombuffer(k, np.int32), np.frombuffer(c, np.float32)) for y, k, c in data])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text); labels: (doc_id, quality)."""
    table = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(table), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- the registered query -------------------------------------------------


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
