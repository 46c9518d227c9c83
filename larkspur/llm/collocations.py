"""Phrases that occur together more often than their words do, by lang.

Counting every run of up to five words exactly would shuffle all of them; nearly all are
rare.  So count-min sketches come first.  Each task counts its runs in a sketch of ROWS rows
of cells; the sketches are added up cell by cell, and a run is estimated by the least of its
cells, never less than its count.  A first sketch takes words and pairs, a second one longer
runs whose pairs the first one lets through.  A second pass over the texts then counts exactly
those runs that the estimates, and those of the runs within, let through: a run with enough
occurrences is always among them.  Scores and the dropping of phrases within longer ones follow
as joins and aggregations of the frequent runs.

Cells are sized by the bytes of text, up to MOST_CELLS a row: then a task holds ROWS * MOST_CELLS
bytes (for thresholds up to 127, else four times that), and what is broadcast is a bit a cell,
16 MB.  Beyond some 20 GB of text estimates get too high to hold everything rare back, and the
exact pass carries more; results are the same at any size.

Defined results: a null text is empty, a null lang is ``und``; a row counts each time it is
repeated, doc_id is not looked at; a text of any length is read in all its words; equal scores
go by count, then phrase; an empty table, or one without frequent phrases, gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.keys import text_column
from larkspur.llm.links import spread_join
from larkspur.llm.session import checkpoint, shuffle_partitions
from larkspur.llm.text_hash import _ODD, U, mix, slices, utf8

ROWS = 2
#: Cells of a row: one for so many runs, within these bounds.
PER_CELL = 32
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
#: Cells that travel in one row.
_BLOCK = 1 << 16
#: Bytes of text that are worked on at once; one text is never split.
_SLICE = 3_000_000
#: Bytes of text for one task, where that leaves enough tasks for all cores: the fewer tasks, the less they send.
_TASK = 128 << 20
#: Runs that a task adds up before it sends them on.
_HELD = 300_000
#: Langs whose totals are broadcast, a few bytes each.
_LANGS = 10_000
_WORD, _BLANK, _BREAK = 0, 1, 2


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[0x20, 0x09]] = _BLANK
    table[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
    return table


_KIND = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Runs:
    """The words of some texts: their number in ``vocabulary``, lang (by number) and piece; pieces never span texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = _LOWER[data]
        kind = _KIND[data]
        word = kind == _WORD
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads = offsets[1:-1]
        heads = heads[(heads > 0) & (heads < len(data))]
        first[heads], last[heads - 1] = word[heads], word[heads - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[start].astype(np.int64) + row if len(start) else start
        self.lang = langs[row]
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[word])]).dictionary_encode()
        self.vocabulary = words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)

    def hashes(self, langs: list[str]) -> np.ndarray:
        """64 bits for the lang and word at each place."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary.to_pylist()], U) if len(self.vocabulary) else np.zeros(0, U)
        salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], U)
        return mix(own[self.word] ^ salt[self.lang])

    def together(self, m: int) -> np.ndarray:
        """Whether a run of m words starts at each place but the last m - 1."""
        return self.piece[: len(self.piece) - m + 1] == self.piece[m - 1 :] if len(self.piece) >= m else np.zeros(0, bool)


def _runs(batch):
    """(Runs, langs by number) of the texts of a batch, a slice at a time."""
    data, offsets = utf8(batch.column("text"))
    coded = batch.column("lang").dictionary_encode()
    langs, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    for a, b in slices(offsets, _SLICE):
        yield Runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], code[a:b]), langs


def longer(h: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
    """Hashes of runs of m words from those of m - 1 and of words."""
    n = max(0, len(own) - m + 1)
    return mix(h[:n] * _ODD + own[m - 1 : m - 1 + n])


def places(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h >> U(32 * row)) & U(cells - 1)).astype(np.int64)


def passes(h: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate, the least of a run's cells, reaches the threshold; bits: those of all rows' cells that do."""
    out = np.ones(len(h), bool)
    for r in range(ROWS):
        at = places(h, r, cells)
        out &= (bits[r, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _alive(h: np.ndarray, m: int, within: np.ndarray | None, sketches: list):
    """Of the runs of m words: those whose estimate, if a sketch knows m, and whose two runs of m - 1 words pass."""
    n = len(h)
    ok = np.ones(n, bool) if within is None else within[:n] & within[1 : n + 1]
    for orders, bits, cells in sketches:
        if m in orders:
            at = np.flatnonzero(ok)
            ok[at] = passes(h[at], bits.value, cells)
    return ok


def _sketch(orders: range, cells: int, least: int, known: list):
    """A task's sketch of the runs of these orders as rows (block, body); counts stop at the threshold, which loses nothing."""
    kind = np.uint8 if least <= 127 else np.uint32

    def run(batches):
        table = np.zeros((ROWS, cells), kind)
        for batch in batches:
            for runs, langs in _runs(batch):
                own = runs.hashes(langs)
                h, alive = own, None
                for m in range(1, orders.stop):
                    h = h if m == 1 else longer(h, own, m)
                    alive = _alive(h, m, alive, known) & runs.together(m)
                    if m in orders:
                        for r in range(ROWS):
                            at, n = np.unique(places(h[alive], r, cells), return_counts=True)
                            table[r, at] = np.minimum(table[r, at] + n, least)
        step = min(_BLOCK, cells)
        for i, part in enumerate(table.reshape(-1, step)):
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "body"])

    return run


def _merged(least: int):
    """Rows sorted by block: the sum of each block's cells, as a bit for each that reaches the threshold."""
    kind = np.uint8 if least <= 127 else np.uint32

    def bits(block, total):
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    def run(batches):
        now, total = None, None
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                cells = np.frombuffer(body.as_buffer(), kind)
                if block != now:
                    if now is not None:
                        yield bits(now, total)
                    now, total = block, cells.copy()
                else:
                    total = np.minimum(total + cells, kind(least))
        if now is not None:
            yield bits(now, total)

    return run


def few_tasks(texts: DataFrame, size: int, least: int = 0) -> DataFrame:
    """The texts, ``size`` bytes in all, in tasks of some _TASK bytes, or ``least`` if that is more, but no fewer tasks than cores."""
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, size // max(_TASK, least)))


def count_min(texts: DataFrame, orders: range, size: int, least: int, known: list):
    """(orders, broadcast bits of the cells at ``least`` or more, cells of a row) of the sketch merged over all texts.

    The sketches of all tasks together have about as many bytes as the texts, at most.
    """
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(orders) * size // 6 // PER_CELL).bit_length()))
    rows = few_tasks(texts, size, ROWS * cells * (1 if least <= 127 else 4)).mapInArrow(_sketch(orders, cells, least, known), "block int, body binary")
    rows = rows.repartition(shuffle_partitions(texts.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_merged(least), "block int, bits binary")
    bits = np.zeros((ROWS * cells // min(_BLOCK, cells), min(_BLOCK, cells) // 8), np.uint8)
    for r in rows.toLocalIterator():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return orders, texts.sparkSession.sparkContext.broadcast(bits.reshape(ROWS, -1)), cells


def _slice_counts(runs: Runs, langs: list[str], most_words: int, known: list):
    """(langs by number, phrases, n) of a slice, by order: how often each run that passes occurs there."""
    own, v = runs.hashes(langs), max(1, len(runs.vocabulary))
    h, alive, rank, phrase, lang = own, None, None, None, None
    for m in range(1, most_words + 1):
        h = h if m == 1 else longer(h, own, m)
        alive = _alive(h, m, alive, known) & runs.together(m)
        at = np.flatnonzero(alive)
        if not len(at):
            return
        # exact names: the number of the run without its last word, and that word's
        name = (runs.lang[at] if m == 1 else rank[at]) * v + runs.word[at + m - 1]
        _, first, inverse, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        last = runs.vocabulary.take(pa.array(runs.word[at[first] + m - 1]))
        if m == 1:
            phrase, lang = last, runs.lang[at[first]]
        else:
            before = rank[at[first]]
            phrase, lang = pc.binary_join_element_wise(phrase.take(pa.array(before)), last, pa.scalar(b" ", pa.large_binary())), lang[before]
        rank = np.zeros(len(own), np.int64)
        rank[at] = inverse
        yield lang, phrase, n


def _counts(most_words: int, known: list):
    """Rows (lang, phrase, n): the runs that pass, added up over much of a task; an empty phrase counts all words."""

    def rows(total: Counter) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.binary()).view(pa.string()), pa.array(list(total.values()), pa.int64())]
        return pa.record_batch(columns, names=["lang", "phrase", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for runs, langs in _runs(batch):
                for code, n in enumerate(np.bincount(runs.lang, minlength=len(langs)).tolist()):
                    total[langs[code], b""] += n
                for lang, phrase, n in _slice_counts(runs, langs, most_words, known):
                    for code, text, count in zip(lang.tolist(), phrase.to_pylist(), n.tolist(), strict=True):
                        total[langs[code], text] += count
                    if len(total) > _HELD:
                        yield rows(total)
                        total.clear()
        yield rows(total)

    return run


def frequent_runs(docs: DataFrame, least: int, most_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all runs of up to ``most_words`` words that occur ``least`` times or more, (lang, n) words); exact."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_column().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    known: list = []
    for orders in (range(1, min(2, most_words) + 1), range(3, most_words + 1)):
        if len(orders):
            known.append(count_min(texts, orders, size, least, known))
    rows = few_tasks(texts, size).mapInArrow(_counts(most_words, known), "lang string, phrase string, n long")
    counts = checkpoint(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")))
    words = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).alias("words")
    return counts.where("phrase != ''").select("lang", "phrase", words, "f"), counts.where("phrase = ''").select("lang", F.col("f").alias("n"))


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all frequent runs of two words or more: the cut of the lowest score, then the fewest words left."""
    name = lambda phrase: F.concat("lang", F.lit("\n"), phrase)
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = frequent.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), cut).withColumn("head", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k")))
    cuts = checkpoint(cuts.select("lang", "phrase", "a", "k", name(F.col("head")).alias("left"), name(F.substr("phrase", F.length("head") + 2)).alias("right")))
    parts = frequent.select(name(F.col("phrase")).alias("name"), "f")
    for side, to in (("left", "l"), ("right", "r")):
        cuts = spread_join(cuts, parts.select(F.col("name").alias(side), F.col("f").alias(to)), side, by="phrase").drop(side)
    few = totals.limit(_LANGS + 1).count() <= _LANGS
    cuts = cuts.join(F.broadcast(totals), "lang") if few else spread_join(cuts, totals, "lang", by="phrase")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def within_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer frequent run that has the phrase's words in a row."""
    w = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))))
    rows = frequent.where("words > 2").withColumn("w", w).select("lang", "f", F.explode(inner).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases of docs (lang, text).

    Phrases of 2 to ``most_words`` words with ``least`` occurrences; one within a longer phrase that has ``share`` percent of its occurrences is dropped.
    """
    frequent, totals = frequent_runs(docs, least, most_words)
    rows = scored(frequent, totals).join(within_longer(frequent), ["lang", "phrase"], "left")
    rows = rows.where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# --- the registered query -------------------------------------------------


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS MATERIALIZED (
  SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)) GROUP BY ALL HAVING count(*) >= 100
), n AS MATERIALIZED (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
k AS (SELECT lang, phrase, m, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
s AS (SELECT k.lang, k.phrase, a, n, k, x.f AS l, y.f AS r, (1000 * a * n) // (x.f * y.f) AS score FROM k JOIN n USING (lang)
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longer FROM (
  SELECT lang, f, w, m, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS j FROM g WHERE m > 2)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM b LEFT JOIN u USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true) QUALIFY rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": _SQL}
