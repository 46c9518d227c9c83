"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Tokenising is one pass in which each distinct word-like chunk is encoded once a
worker, named by a 64-bit hash of its bytes.  Packing needs only how many pieces there are of each length: at most
``capacity`` counts reach the driver, however large the corpus.  The driver plans
bins with multiplicities over these counts; pieces then find their place by their
rank among the pieces of their length, which Spark numbers in salted groups.

Best-two-fit: a bin is filled greedily with the largest piece that fits; then its
smallest piece gives way to the two unpacked pieces that fill the gap best, if they
fill more than it did.  The same bin is laid as often as the counts allow.

Defined results: a null or empty text is one piece of the end id alone; a text of any
length is tokenised whole; a null doc_id is kept as null; repeated rows are packed each
by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.session import checkpoint, shuffle_partitions
from larkspur.llm.text_hash import U, byte_values, mix, powers, slices, utf8

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Unicode white space, as the vocabulary's splitting pattern has it, in UTF-8.
_WS_1 = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_WS_2 = (0xC285, 0xC2A0)
_WS_3 = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)
#: Distinct chunks that a worker keeps; beyond that it starts anew.
_CACHED = 400_000
_SLICE = 200_000


@lru_cache(1)
def _ascii_blanks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(_WS_1)] = True
    return table


def _blanks(data: np.ndarray) -> np.ndarray:
    """1 at the first byte of a white-space character, 2 at its other bytes, else 0."""
    out = _ascii_blanks()[data].astype(np.uint8)
    for lead in np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))) if data.max(initial=0) > 0xC1 else ():
        two = int.from_bytes(data[lead : lead + 2].tobytes(), "big")
        three = int.from_bytes(data[lead : lead + 3].tobytes(), "big")
        if two in _WS_2 or three in _WS_3:
            out[lead] = 1
            out[lead + 1 : lead + (2 if two in _WS_2 else 3)] = 2
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of some texts start: a word with one space before it, or white space up to there.

    White space ends every token of the vocabulary's pattern, so that chunks can be encoded one by one.
    """
    n = len(data)
    blank = _blanks(data)
    head = np.zeros(n + 1, bool)  # a text's first byte
    head[offsets] = True
    white, before = blank > 0, np.concatenate([[False], blank[:-1] > 0])
    run = white & (blank == 1) & (~before | head[:n])
    word = ~white & (before | head[:n])
    after_space = np.concatenate([[False], data[:-1] == 0x20]) & ~head[:n]
    start = run | (word & ~after_space)
    # The last white space before a word stands alone, or with the word if it is a space.
    last = np.flatnonzero(word & before & ~head[:n]) - 1
    while len(back := np.flatnonzero(blank[last] == 2)):
        last[back] -= 1
    start[last] = True
    return np.flatnonzero(start)


# Fixed value: the splitting pattern of byte-level vocabularies.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_pairs(path: str):
    """The file's byte pair encoding as a function from a text to ids, run by tiktoken, which is some times faster.

    None where the file says more than that: another kind of model, a normaliser, other splitting, or merges whose
    products are not numbered in the order of the merges.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or made[:1] == [-1]:
        return None
    import tiktoken

    # bytes as characters: the printable ones stand for themselves, the others for 256 and up in turn
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    if len(ranks) != len(made) + 256:
        return None
    return tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids of texts, as the tokenizer file gives them, with each distinct chunk encoded once.

    Chunks are looked up by 64-bit hashes in an open table, whole slices of texts at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = _byte_pairs(path)
        self._clear()

    def _clear(self) -> None:
        self.n = 0
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.off = np.zeros(1 << 16, np.int64)
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys, self.rows = np.zeros(size, U), np.full(size, -1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is not known."""
        mask = U(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        out = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            out[open_] = self.rows[at[open_]]
            open_ = open_[(self.keys[at[open_]] != h[open_]) & (out[open_] >= 0)]
        return out

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        for x, row in zip(h.tolist(), rows.tolist(), strict=True):
            at = x & mask
            while self.rows[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.rows[at] = x, row

    def _learn(self, h: np.ndarray, chunks: list[str]) -> None:
        if 2 * (self.n + len(chunks)) > len(self.keys):
            at = self.rows >= 0
            keys, rows = self.keys[at], self.rows[at]
            self._table(1 << int(4 * (self.n + len(chunks))).bit_length())
            self._put(keys, rows)
        first = self.n
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for ids in map(self.plain, part) if self.plain else (e.ids for e in self.tok.encode_batch(part, add_special_tokens=False)):
                if self.n_flat + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
                if self.n + 2 > len(self.off):
                    self.off = np.concatenate([self.off, np.zeros(len(self.off), np.int64)])
                self.flat[self.n_flat : self.n_flat + len(ids)] = ids
                self.n_flat += len(ids)
                self.n += 1
                self.off[self.n] = self.n_flat
        self._put(h, np.arange(first, self.n))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts, text i has ids[bounds[i]:bounds[i + 1]]."""
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            # an added token's string may join white space across chunks
            parts = [np.array(self.tok.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        if self.n > _CACHED:
            self._clear()
        start = chunk_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = np.diff(np.append(start, len(data)))
        place = np.arange(len(data)) - np.repeat(start, size)
        h = mix(np.add.reduceat(byte_values()[data] * powers(int(size.max()))[place], start) + size.astype(U))
        rows = self._find(h)
        new = np.flatnonzero(rows < 0)
        if len(new):
            some, first = np.unique(h[new], return_index=True)
            first = new[first]
            self._learn(some, [raw[s : s + n].decode() for s, n in zip(start[first].tolist(), size[first].tolist(), strict=True)])
            rows = self._find(h)
        lens = self.off[rows + 1] - self.off[rows]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.off[rows] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        enc = _encoder(tokenizer)
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for lo, hi in slices(offsets, _SLICE):
                ids, bounds = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                # every document ends with the end id
                n = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (np.cumsum(n) - n)[doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(doc + lo)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) for bins that together hold counts[length] pieces of each length."""
    left = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(left)
    bins = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        at = bisect_right(lengths, gap) - 1
        while at >= 0:  # greedy: the largest that fits
            k = lengths[at]
            n = min(left[k], gap // k)
            if n:
                used[k] = n
                gap -= n * k
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        if gap and used:
            small = min(used)
            free = lambda k: left[k] - used.get(k, 0)
            best, pair = small, None
            lo, hi = 0, bisect_right(lengths, gap + small) - 1
            while lo <= hi:  # two pointers: the fullest pair of unpacked pieces
                a, b = lengths[lo], lengths[hi]
                if not free(b) or a + b > gap + small:
                    hi -= 1
                elif free(a) < (2 if lo == hi else 1):
                    lo += 1
                else:
                    if a + b > best:
                        best, pair = a + b, (a, b)
                    lo += 1
            if pair:
                used[small] -= 1
                for k in pair:
                    used[k] = used.get(k, 0) + 1
                used = {k: n for k, n in used.items() if n}
        times = min(left[k] // n for k, n in used.items())
        bins.append((times, sorted(used.items(), reverse=True)))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                lengths.remove(k)
    return bins


def _table(bins) -> np.ndarray:
    """Rows (key, first sequence, copies, offset), by key = length << 40 | first rank."""
    rows, cursor, sequence = [], {}, 0
    for times, items in bins:
        offset = 0
        for k, n in items:
            rows.append((k << 40 | cursor.get(k, 0), sequence, n, offset))
            cursor[k] = cursor.get(k, 0) + n * times
            offset += k * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = checkpoint(tokenised(docs, tokenizer, capacity, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(_table(plan_bins(counts, capacity)))
    # Ranks within a length: numbered within salted groups, then moved by the sizes of the groups before.
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * shuffle_partitions(spark))).alias("salt")
    salted = pieces.select("*", salt)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])

    def place(batches):
        t = table.value
        for b in batches:
            length, rank = (np.asarray(b.column(n), np.int64) for n in ("length", "rank"))
            row = t[np.searchsorted(t[:, 0], length << 40 | rank, "right") - 1]
            at = rank - (row[:, 0] & ((1 << 40) - 1))
            keep = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*keep, pa.array(row[:, 1] + at // row[:, 2]), pa.array(row[:, 3] + at % row[:, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


# --- the registered query -------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
