"""Text compression by the weight of words, as the prompt compressor does it, with the corpus in the model's place.

Texts become tokens and chunks of at most ``budget`` tokens, each closed at the last end token that fits.  A token's weight
is the inverse document frequency of its lower-cased form over the texts that are compressed (a model's keep
probability can be given instead).  Within a chunk the tokens at or above the quantile that leaves ``rate`` of them stay,
and so do forced tokens; a forced token that repeats the one kept before it goes.

The terms of the least weights, up to BROADCAST_TERMS, are broadcast.  All others weigh as much at least, so that they stay
wherever a chunk's quantile is among the broadcast ones; only where it is not are the chunk's other terms looked up, in an
exchange of those terms with the texts that have such a chunk.

Defined results: a null or blank text has no tokens, no chunks and an empty result; equal weights stay or go together, so that
more than ``rate`` may stay; rows are told apart by their key, and of rows with one key the greatest text counts.
"""

from __future__ import annotations

from math import inf, nan

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.rounds import Rounds, checkpoint, spread_join

# What always stays, and where chunks close.
FORCE_TOKENS = ("\n", ".", "!", "?", ",", "、")
CHUNK_END_TOKENS = (".", "\n")
#: Terms whose weights are broadcast (and one in 10,000 of all terms); longer terms than LONGEST characters never are.
BROADCAST_TERMS = 200_000
LONGEST = 256
#: Keys of several rows up to which they are broadcast.
BROADCAST_KEYS = 100_000
#: Bytes of the tokens that a task judges at once, if they are of several texts.
BYTES_AT_ONCE = 1 << 21
TOKENS = r"([\p{L}\p{N}&&[\u0000-⺀]]+|\n|[^\s])"


def tokens(text: Column) -> Column:
    """Runs of letters and digits below U+2E80, newlines, and every other character that is no blank by itself."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(1))


def in_a_string(words: Column) -> Column:
    """Tokens with a space between two, which no token has; null if there are none."""
    return F.nullif(F.array_join(words, " "), F.lit(""))


def chunk_starts(ends: np.ndarray, lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The first places of the chunks of texts of some lengths that lie end to end, and the number of each text's chunks.

    ends: whether a token is an end token.  A chunk that is full ends after its last end token, or where it is full if it has none.
    """
    last = np.maximum.accumulate(np.where(ends, np.arange(len(ends)), -1))
    starts, counts, at, stop = [], [], 0, 0
    for n in lengths.tolist():
        stop, before = stop + n, len(starts)
        while at < stop:
            starts.append(at)
            end = last[at + budget - 1] if at + budget < stop else stop - 1
            at = int(end) + 1 if end >= at else at + budget
        counts.append(len(starts) - before)
    return np.array(starts, np.int64), np.array(counts, np.int64)


def once(rows: DataFrame) -> tuple[DataFrame, int]:
    """(key, text) with a row a key, and how many of them have tokens; only the keys are exchanged, and the texts of keys that several rows have."""
    full = F.count_if(F.col("text").rlike(r"\n|\S"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), full.alias("full"))
    most, some = keys.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("full"), F.lit(0))).first()
    if most <= 1:
        return rows, some
    again = checkpoint(keys.where("n > 1").select(F.col("key").alias("again")))
    few = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    same = rows["key"].eqNullSafe(again["again"])
    texts = rows.join(few, same, "left_anti").unionAll(rows.join(few, same, "left_semi").groupBy("key").agg(F.max("text").alias("text")))
    return texts, texts.agg(full).first()[0]


def weights(counts: DataFrame, texts: int, given: DataFrame | None) -> DataFrame:
    """(term, n, weight) of (term, n) texts of each term: the inverse document frequency, or what is given (term, weight) and else 0."""
    if given is not None:
        return counts.join(given, "term", "left").select("term", "n", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return counts.withColumn("weight", F.round(F.log(1 + (F.lit(texts) - F.col("n") + 0.5) / (F.col("n") + 0.5)), 9))


def _parts(batch: pa.RecordBatch):
    """Slices of a batch with so many bytes of tokens at most, a text at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("words")), 0).to_numpy(), dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class _Judged:
    """The tokens of some texts (words, terms; both as strings), end to end, and which of them stay.

    known: some terms and their weights; rest: the weight of all others, NaN if it is only known to be no less.  A chunk is open if its quantile is
    among the latter.
    """

    def __init__(self, part: pa.RecordBatch, known: tuple[pa.Array, np.ndarray], rest: float, rate: float, force: tuple[str, ...], ends: tuple[str, ...], budget: int):
        words, terms = (pc.split_pattern(part.column(c), " ") for c in ("words", "terms"))
        self.lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        encoded = words.flatten().dictionary_encode()
        self.words, self.code = encoded.dictionary, encoded.indices.to_numpy()
        first = np.empty(len(self.words), np.int64)
        first[self.code[::-1]] = np.arange(len(self.code) - 1, -1, -1)
        self.terms = terms.flatten().take(pa.array(first))  # a word's term is the same wherever it is
        at = pc.fill_null(pc.index_in(self.terms, known[0]), -1).to_numpy()
        self.own = np.append(known[1], rest)[at][self.code]
        isin = lambda chosen: pc.is_in(self.words, pa.array(chosen, pa.string())).to_numpy(zero_copy_only=False)[self.code]
        self.forced = isin(force)
        starts, self.chunks = chunk_starts(isin(ends), self.lengths, budget)
        self.sizes = np.diff(np.append(starts, len(self.own)))
        places, least = np.floor(self.sizes * (1 - rate) + 1e-9).astype(np.int64), np.full(len(starts), -inf)
        for i in np.flatnonzero((places > 0) & (places < self.sizes)).tolist():
            least[i] = np.partition(self.own[starts[i] : starts[i] + self.sizes[i]], places[i])[places[i]]  # NaN is last
        self.open = np.isnan(least)
        heavy = (self.own >= np.repeat(least, self.sizes)) | np.isnan(self.own)
        self.stays = (heavy & np.repeat(places < self.sizes, self.sizes)) | self.forced
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def open_texts(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.chunks)[self.open], minlength=len(self.lengths)) > 0


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _asks(known, *options):
    """(key, words, terms, text) -> (key, text, terms) of the texts with open chunks, and the distinct terms there of unknown weight."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                judged = _Judged(part, known.value, nan, *options)
                texts = np.flatnonzero(judged.open_texts())
                if not len(texts):
                    continue
                asked = np.repeat(judged.open, judged.sizes) & np.isnan(judged.own)
                terms = judged.terms.dictionary_encode()
                kinds = len(terms.dictionary)
                pairs = np.unique(judged.of[asked] * kinds + terms.indices.to_numpy()[judged.code[asked]])
                n = np.bincount(pairs // kinds, minlength=part.num_rows)[texts]
                key, text = (part.column(c).take(pa.array(texts)) for c in ("key", "text"))
                yield pa.record_batch([key, text, _lists(n, terms.dictionary.take(pa.array(pairs % kinds)))], names=["key", "text", "terms"])

    return run


def _compressed(known, rest: float, drop: bool, labels: bool, schema: pa.Schema, *options):
    """(key, words, terms[, asked, weights]: more that is known) -> rows of results; if rest is NaN, of the texts without open chunks."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                more = [part.column(c).flatten() for c in part.schema.names[3:]]
                both = (pa.concat_arrays([known.value[0], more[0]]), np.append(known.value[1], more[1])) if more else known.value
                judged = _Judged(part, both, rest, *options)
                places = np.flatnonzero(judged.stays)
                if drop:
                    code, of = judged.code[places], judged.of[places]
                    again = np.append(False, (code[1:] == code[:-1]) & (of[1:] == of[:-1]))[: len(places)] & judged.forced[places]
                    places = places[~again]
                kept = np.bincount(judged.of[places], minlength=part.num_rows)
                joined = pc.binary_join(_lists(kept, judged.words.take(pa.array(judged.code[places]))), " ")
                marks = pa.nulls(part.num_rows, schema.field("labels").type)
                if labels:
                    each = pa.StructArray.from_arrays([judged.words.take(pa.array(judged.code)), pa.array(judged.stays)], names=["word", "kept"])
                    marks = _lists(judged.lengths, each).cast(schema.field("labels").type)
                numbers = [pa.array(x, pa.int32()) for x in (judged.lengths, judged.chunks, kept)]
                out = pa.record_batch([part.column("key"), *numbers, joined, marks], schema=pa.schema([part.schema.field("key"), *list(schema)[1:]]))
                yield out.filter(pa.array(~judged.open_texts())) if rest != rest else out

    return run


def compress(docs: DataFrame, key: str, text: str, rate: float = 0.8, force: tuple[str, ...] = FORCE_TOKENS, ends: tuple[str, ...] = CHUNK_END_TOKENS, budget: int = 512, drop_consecutive: bool = True, given: DataFrame | None = None, labels: bool = True) -> DataFrame:
    """(key, n_tokens, n_chunks, n_kept, compressed, labels) of docs (key, text); given: (term, weight) in place of the corpus's.

    labels: array of (word, kept) of all tokens in order, null if they are not asked for; compressed: the kept ones, a space between two.
    docs is read several times, and has to give the same rows each time; its texts are neither exchanged nor written unless they are open.
    """
    if not 0 < rate <= 1:
        raise ValueError("rate is above 0 and at most 1")
    if budget < 1:
        raise ValueError("a chunk has a token at least")
    options = (rate, tuple(force), tuple(ends), budget)
    share = docs.sparkSession.sparkContext.broadcast
    split = lambda df, *more: df.withColumn("all", tokens(F.col("text"))).select("key", in_a_string(F.col("all")).alias("words"), in_a_string(F.transform("all", F.lower)).alias("terms"), *more)
    texts, some = once(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = dict(texts.dtypes)["key"]
    out = f"key {kind}, n_tokens int, n_chunks int, n_kept int, compressed string, labels array<struct<word: string, kept: boolean>>"
    fields = pa.schema([("key", pa.null()), *[(c, pa.int32()) for c in ("n_tokens", "n_chunks", "n_kept")], ("compressed", pa.string()), ("labels", pa.list_(pa.struct([("word", pa.string()), ("kept", pa.bool_())])))])
    with Rounds(docs.sparkSession) as files:
        terms = texts.select(F.explode(F.array_distinct(F.transform(F.array_distinct(tokens(F.col("text"))), F.lower))).alias("term"))
        counts = files.write(terms.groupBy("term").agg(F.count("*").alias("n")))
        own = weights(counts, some, given) if given is None else files.write(weights(counts, some, given))
        long = F.min(F.when(F.length("term") > LONGEST, F.col("weight")))
        total, distinct, rest, bound = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.max("weight"), long).first()
        if distinct > BROADCAST_TERMS:
            least = own.agg(F.percentile_approx("weight", BROADCAST_TERMS / distinct, 10_000)).first()[0]
            bound = least if bound is None else min(least, bound)
        light = (own if bound is None else own.where(F.col("weight") < bound)).select("term", "weight").toArrow()
        known = share((light["term"].cast(pa.string()).combine_chunks(), light["weight"].to_numpy()))
        judge = lambda df, rest: df.mapInArrow(_compressed(known, rest, drop_consecutive, labels, fields, *options), out)
        got = judge(split(texts), 0.0 if bound is None else nan)
        if bound is not None:
            opened = files.write(split(texts, "text").mapInArrow(_asks(known, *options), f"key {kind}, text string, terms array<string>"))
            if not opened.isEmpty():
                asked = opened.select("key", F.explode("terms").alias("term"))
                heavy = own.where((F.col("weight") >= bound) & (F.col("weight") < rest))  # what is not found weighs as much as the rest
                found = spread_join(asked, heavy.select("term", "weight"), ["term"], heavy.select("term", "n"), total, "key")
                lists = found.groupBy(F.col("key").alias("of")).agg(F.collect_list("term").alias("asked"), F.collect_list("weight").alias("weights"))
                ready = opened.select("key", "text").join(lists, F.col("key").eqNullSafe(F.col("of")), "left")
                got = got.unionAll(checkpoint(judge(split(ready, "asked", "weights"), rest)))
    return got.withColumnRenamed("key", key)
